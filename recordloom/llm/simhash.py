"""SimHash near-duplicates by multi-index hashing.

A text is lower-cased (A-Z), cut into words, and each shingle of 4 words (repeats included) hashed by
XXH64 with seed 42; a fingerprint bit is set if it is set in more than half of the hashes. Equal
fingerprints collapse first, so exact copies never meet as pairs. Distinct fingerprints are cut into
segments. If two differ in at most 4 bits, then for 3 segments one of the first two differs in at most
1 bit, or the third in none: each fingerprint looks up the 22 + 22 + 1 values of those balls in the
tables of segment values (for more than 2^24 distinct fingerprints 2 segments with balls of radius 2
and 1, so that a table's buckets stay short). Candidates of a bucket are verified over all 64 bits.
Large buckets are searched breadth-first from one unvisited member at a time, so they give a spanning
forest rather than all pairs: links inside a bucket are never lost, only implied. Components come from
alternating large-star and small-star rounds over the links; each round is checkpointed.

Edge cases: null or empty texts, or texts without words, have fingerprint zero and link like others;
texts of fewer than 4 words are one shingle; an empty table gives no rows; repeated rows are repeated
documents; a null doc_id is never a component's id unless the component has no other; very long texts
are hashed whole. near_dedup keeps every document that has no id, and one row of those that share one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import annotate, cut, table, texts

SHINGLE, BITS, SEED = 4, 4, 42
FEW = 48  # buckets of up to so many members are compared pair by pair
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= size:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1).tolist()
        starts = [0, *(e + 1 for e in ends)]
        one = xxhash.xxh64_intdigest
        hashes = [one(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with fp, the signed fingerprint."""
    return annotate(docs, ["text"], lambda text: [[fingerprint(t) for t in text]], "fp long")


def plan(n: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each segment, by the pigeonhole rule for BITS = 4."""
    return [(0, 21, 1), (21, 21, 1), (42, 22, 0)] if n <= 1 << 24 else [(0, 32, 2), (32, 32, 1)]


def _masks(bits: int, radius: int) -> np.ndarray:
    ones = [np.uint64(1) << np.uint64(b) for b in range(bits)]
    out = [np.uint64(0)]
    if radius >= 1:
        out += ones
    if radius >= 2:
        out += [a | b for k, a in enumerate(ones) for b in ones[:k]]
    return np.array(out, dtype=np.uint64)


def _probes(segments):
    """Rows (key, fp, home): each fingerprint under every value of its segments' balls; home marks its own value, the table entry."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(at, 4096).to_numpy().view(np.uint64)
                for number, (first, bits, radius) in enumerate(segments):
                    own = (fps >> np.uint64(first)) & np.uint64((1 << bits) - 1)
                    masks = _masks(bits, radius)
                    keys = (own[:, None] ^ masks[None, :]) | (np.uint64(number) << np.uint64(bits))
                    home = np.broadcast_to(masks == 0, keys.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fps, len(masks)).view(np.int64)), pa.array(home.ravel())], names=["key", "fp", "home"])

    return run


def _near(a, b):
    return np.bitwise_count(a ^ b) <= BITS


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of distinct fingerprints under the distance bound."""
    left, right, rest = [], [], fps
    while len(rest):
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            front = queue.pop()
            for node in front:
                hit = _near(rest, node)
                if hit.any():
                    found = rest[hit]
                    rest = rest[~hit]
                    left.append(np.repeat(node, len(found)))
                    right.append(found)
                    queue.append(found)
    none = np.array([], dtype=np.uint64)
    return np.concatenate([*left, none]), np.concatenate([*right, none])


def _links(keys: np.ndarray, fps: np.ndarray, home: np.ndarray):
    """Verified links among whole buckets, sorted by key."""
    starts = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    group = np.repeat(np.arange(len(starts)), sizes)
    tables = np.add.reduceat(home.astype(np.int64), starts) if len(starts) else sizes
    small = home & (sizes[group] > 1) & (sizes[group] <= FEW)
    row = np.nonzero(small)[0]
    count = sizes[group[row]]
    a = np.repeat(row, count)
    b = np.repeat(starts[group[row]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    hit = (a != b) & _near(fps[a], fps[b]) & (~home[b] | (a < b))
    out = [(fps[a[hit]], fps[b[hit]])]
    for g in np.nonzero((sizes > FEW) & (tables > 0))[0]:
        out.append(forest(fps[starts[g] : starts[g] + sizes[g]]))
    return (np.concatenate(x) for x in zip(*out))


def _verify(batches):
    """Links of the buckets of a partition sorted by key; the last bucket of a batch waits for the next."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        new = (batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False))
        if not len(new[0]):
            continue
        held.append(new)
        if held[0][0][0] == new[0][-1]:  # all of one bucket so far
            continue
        whole = tuple(np.concatenate(x) for x in zip(*held))
        last = np.searchsorted(whole[0], whole[0][-1])
        yield _pairs(*_links(*(x[:last] for x in whole)))
        held = [tuple(x[last:] for x in whole)]
    if held:
        yield _pairs(*_links(*(np.concatenate(x) for x in zip(*held))))


def _pairs(a, b):
    a, b = a.view(np.int64), b.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])


def links(prints: DataFrame) -> DataFrame:
    """u > v: links between distinct fingerprints (column fp), enough to connect all that are connected."""
    probes = prints.select("fp").mapInArrow(_probes(plan(prints.count())), "key long, fp long, home boolean")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return probes.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_verify, "u long, v long").distinct()


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One large-star or small-star round over edges u > v."""
    if small:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
    else:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) of all nodes of edges u > v."""
    state, edges = None, cut(edges)
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        state = now
        edges = cut(_star(_star(edges, False), True))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id among all documents linked directly or through others."""
    rows = cut(fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    root = components(links(prints))
    linked = prints.join(root, prints.fp == root.node)
    low = linked.groupBy("root").agg(F.min("first").alias("low"))
    moved = linked.join(low, "root").select("fp", "low")
    # Written, so that both sides of the last join are plain exchanges: Spark can then split a fingerprint that many documents have.
    name = cut(prints.join(moved, "fp", "left").select("fp", F.coalesce("low", "first").alias("component_id")))
    return rows.join(name, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, groups=near_groups) -> DataFrame:
    """docs without those that groups() links to a document of a smaller doc_id; their columns unchanged."""
    kept = groups(docs).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi")
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id"))
    named = named.withColumn("__row", one).where("__row = 1").select(*docs.columns)
    return named.unionAll(docs.where(F.col("doc_id").isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(texts(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
