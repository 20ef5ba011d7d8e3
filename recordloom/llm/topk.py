"""Exact top-k search by a three-phase uniform threshold.

Vectors are scored by the inner product of their integer components floor(256 * x). The components
are cut into SLICES runs; the score is the sum of one partial score per slice, so each slice of each
partition is a list of partial scores.

1. Every partition gathers, for each query and slice, its k largest partial scores and the whole
   scores of those rows. The k-th largest of a query's whole scores (each row once) can't exceed the
   k-th largest of all: it is a safe cutoff.
2. The cutoff c is broadcast. A row with a score of c or more has a partial score of c / SLICES or
   more in some slice; every partition collects those rows.
3. The remaining slices of the collected rows are resolved exactly; rows that reach the cutoff are
   kept, and a last aggregation ranks them, ties to the smaller id.

Queries go in blocks of QUERY_BLOCK vectors, so what is broadcast (a block and its cutoffs) and what
a task holds are bounded whatever the number of queries; candidates are never shuffled. Each block is
a job over all candidates. A partition sends at most its own k best entries of a query: no other of
its rows can be among the k best.

Edge cases: vectors that are null, or hold null or non-finite components, take no part; an empty
vector scores 0; vectors shorter than the longest count as padded with zeros; rows with a null id
take no part; the own row of a query is every row with its id, and of repeated query ids the first
by vector is used; repeated candidates rank one after the other; scores beyond a long are clipped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SLICES = 4
QUERY_BLOCK = 4096
ROWS = 2048  # candidate rows in one matrix
_LONG = 2**63 - 1


def _usable(column: str):
    c = F.col(column)
    return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def integers(vectors: list, width: int) -> np.ndarray:
    """floor(256 * x), x as double; Python integers where a double isn't exact enough."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    with np.errstate(over="ignore"):
        out = np.floor(256.0 * out)
    if not np.isfinite(out).all():
        whole = lambda x: math.floor(256.0 * x) if math.isfinite(256.0 * x) else int(x) * 256
        out = np.array([[whole(float(x)) for x in v] + [0] * (width - len(v)) for v in vectors], dtype=object)
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if their products can't lose a unit, else as Python integers."""
    if a.dtype != object and b.dtype != object and np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) < 2**53:
        return a, b
    whole = lambda m: m if m.dtype == object else np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape)
    return whole(a), whole(b)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k largest, in any order."""
    k = min(k, scores.shape[1])
    if scores.dtype == object:
        return np.array([sorted(range(len(r)), key=lambda j: -r[j])[:k] for r in scores], dtype=int).reshape(len(scores), k)
    return np.argpartition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k :]


def _matrices(batches, width):
    for batch in batches:
        ids, vectors = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for at in range(0, len(ids), ROWS):
            yield ids[at : at + ROWS], integers(vectors[at : at + ROWS], width)


def _slices(width: int) -> list[slice]:
    edges = [width * s // SLICES for s in range(SLICES + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _batch(ids, query, score):
    clip = [max(-_LONG - 1, min(_LONG, int(x))) for x in score]
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(clip, pa.int64())], names=["query_id", "vec_id", "score"])


_ENTRY = "query_id long, vec_id long, score long"


def _trim(query, ids, score, k):
    """The k best entries of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    query = query[order]
    order = order[np.arange(len(order)) - np.searchsorted(query, query, side="left") < k]
    return order


def _kept(parts, k: int):
    """One batch with the k best entries per query of all (query number, id, score) arrays; trims as it goes."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > 1 << 20:
            held = [_select(held, k)]
            size = len(held[0][0]) // 2
    return _select(held, k) if held else None


def _select(held, k):
    query, ids, score = (np.concatenate(x) for x in zip(*held))
    order = _trim(query, ids, score, k)
    return query[order], ids[order], score[order]


def _scored(q, c, i, j):
    score = np.zeros(len(i), dtype=q.dtype)
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        score[s] = (q[i[s]] * c[j[s]]).sum(axis=1)
    return score


def _gather(shared, k: int, width: int):
    """Phase 1: the whole scores of the rows in each slice's list of k."""

    def lists(batches, qids, queries):
        for ids, rows in _matrices(batches, width):
            q, c = _exact(queries, rows)
            seen = np.zeros((len(qids), len(ids)), dtype=bool)
            for part in _slices(width):
                np.put_along_axis(seen, _best(q[:, part] @ c[:, part].T, k), True, axis=1)
            i, j = np.nonzero(seen & (qids[:, None] != ids[None, :]))
            yield i, ids[j], _scored(q, c, i, j)

    def run(batches):
        qids, queries = shared.value
        if (out := _kept(lists(batches, qids, queries), k)) is not None:
            yield _batch(out[1], qids[out[0]], out[2])

    return run


def _collect(shared, cutoffs, k: int, width: int):
    """Phases 2 and 3: rows with a partial score at the uniform threshold, then those whose whole score reaches the cutoff."""

    def entries(batches, qids, queries, low):
        need = np.array([low.get(int(x), -np.inf) for x in qids], dtype=object)
        for ids, rows in _matrices(batches, width):
            q, c = _exact(queries, rows)
            limit = need if q.dtype == object else need.astype(float)
            found = np.zeros((len(qids), len(ids)), dtype=bool)
            for part in _slices(width):
                found |= ((q[:, part] @ c[:, part].T) * SLICES >= limit[:, None]).astype(bool)
            i, j = np.nonzero(found & (qids[:, None] != ids[None, :]))
            score = _scored(q, c, i, j)
            keep = (score >= limit[i]).astype(bool)
            yield i[keep], ids[j[keep]], score[keep]

    def run(batches):
        qids, queries = shared.value
        if (out := _kept(entries(batches, qids, queries, cutoffs.value), k)) is not None:
            yield _batch(out[1], qids[out[0]], out[2])

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the k best of `candidates` of each row of `queries` (vec_id, embedding)."""
    spark = queries.sparkSession
    take = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & _usable("embedding"))
    asked, rows = take(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), take(candidates)
    width = max(rows.agg(F.max(F.size("embedding"))).first()[0] or 0, asked.agg(F.max(F.size("embedding"))).first()[0] or 0)
    found = None
    for block in _query_blocks(asked, width):
        shared = spark.sparkContext.broadcast(block)
        first = rows.mapInArrow(_gather(shared, k, width), _ENTRY)
        # A row may be in several slices' lists; each row counts once towards the cutoff.
        lists = first.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_set(F.struct("score", "vec_id")), asc=False), 1, k).alias("best"))
        low = {r.query_id: r.low for r in lists.where(F.size("best") >= k).select("query_id", F.element_at("best", -1)["score"].alias("low")).collect()}
        entries = rows.mapInArrow(_collect(shared, spark.sparkContext.broadcast(low), k, width), _ENTRY)
        found = entries if found is None else found.unionAll(entries)
    if found is None:
        found = spark.createDataFrame([], _ENTRY)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _query_blocks(asked: DataFrame, width: int):
    ids, vectors = [], []
    for vec_id, v in asked.toLocalIterator():
        ids.append(vec_id)
        vectors.append(v)
        if len(ids) == QUERY_BLOCK:
            yield np.array(ids, dtype=np.int64), integers(vectors, width)
            ids, vectors = [], []
    if ids:
        yield np.array(ids, dtype=np.int64), integers(vectors, width)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows.where(F.col("vec_id") % 50 == 0), rows, 5)


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
