"""Substring dedup on bytes: removes each byte covered by a 50-byte string that also starts in a document of smaller id.

Texts are UTF-8 bytes; matches never cross documents; strings are judged on the input. Segments that several documents share
are brought together by name (repeats.py). Those of a bucket of names become run-length indexes of about INDEX_BYTES of text each
(runindex.py), through which the segments are streamed; windows whose match reaches 50 bytes and a smaller document are removed.
Names are the least hash of a window's 20-byte strings.

Edge cases: null and empty texts and texts of fewer than 50 bytes lose nothing; documents without an id, or
of equal ids, are no smaller than each other; what is left may cut a character in two, so it is returned as bytes; an empty
table gives no rows; columns of the input named like an added one are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, table, texts
from .repeats import Items, covered_counts, least_grams, mixed, without_repeats
from .runindex import RunIndex, joined

WINDOW, K = 50, 20
INDEX_BYTES = 1 << 20  # text of one index
_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64))


class Bytes(Items):
    window = WINDOW

    def __init__(self, text: pa.Array):
        self.data, self.starts = binary(text)
        self.n, self.raw = len(self.data), self.data.tobytes()

    def names(self, a: int, b: int) -> np.ndarray:
        return least_grams(_LETTERS[self.data[a : b + WINDOW - 1]], K, WINDOW)

    def part(self, first: int, count: int) -> bytes:
        return self.raw[first : first + count + WINDOW - 1]


def _parts(order: np.ndarray, names: np.ndarray, least: np.ndarray, sizes: np.ndarray):
    """(segments to index, segments to stream): those of names that several documents have, in parts of about INDEX_BYTES."""
    names = names[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), names[1:] != names[:-1]]))
    ends = np.append(first[1:], len(order))
    held, size = [], 0
    for a, b in zip(first.tolist(), ends.tolist()):
        mine = order[a:b]
        if least[mine[0]] == least[mine[-1]]:
            continue
        own = int(sizes[mine].sum()) + len(mine)
        if held and size + own > INDEX_BYTES:
            yield held, held
            held, size = [], 0
        if own <= INDEX_BYTES:
            held, size = held + mine.tolist(), size + own
            continue
        # A name of more than one part: each is streamed against each.
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes[mine] + 1) // INDEX_BYTES)) + 1
        for part in np.split(mine, cuts):
            yield part.tolist(), mine.tolist()
    if held:
        yield held, held


def judge(segments: list[bytes], names: np.ndarray, least: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    hit: dict[int, np.ndarray] = {}
    for indexed, streamed in _parts(np.lexsort((least, names)), names, least, sizes):
        index = RunIndex([segments[k] for k in indexed], least[indexed], WINDOW)
        for at in range(0, len(streamed), 20_000):
            some = streamed[at : at + 20_000]
            queries, starts = joined([segments[k] for k in some])
            found = index.least_documents(queries, starts, sizes[some])
            smaller = found < np.repeat(least[some], sizes[some] + 1)
            before = np.concatenate([[0], np.cumsum(smaller)])
            touched = np.flatnonzero(before[starts + sizes[some]] > before[starts])
            for k, s in ((some[t], int(starts[t])) for t in touched.tolist()):
                mine = smaller[s : s + len(segments[k]) - WINDOW + 1]
                hit[k] = hit[k] | mine if k in hit else mine.copy()
    out = {}
    for k, mask in hit.items():
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
        out[k] = [(a, b - a) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
    return out


def finish(items: Bytes, covered: np.ndarray) -> list[pa.Array]:
    size, removed, runs = covered_counts(items, covered)
    offsets = np.concatenate([[0], np.cumsum(size - removed)]).astype(np.int32)
    kept = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(items.data[~covered].tobytes())])
    return [pa.array(size), pa.array(removed), pa.array(runs), kept]


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (binary)."""
    return without_repeats(docs, lambda blocks, text_at: Bytes, judge, finish, "n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeats(texts(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS s FROM d, unnest(range(1, length(h) // 2 - 48)) AS t(i) WHERE length(h) >= 100),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT w.doc_id, i FROM w JOIN f USING (s) WHERE first < w.doc_id),
p AS (SELECT doc_id, p, substr(h, 2 * p - 1, 2) AS b FROM d, unnest(range(1, length(h) // 2 + 1)) AS t(p)),
g AS (SELECT p.doc_id, p, b, coalesce(max(c.i) OVER (PARTITION BY p.doc_id ORDER BY p), -50) > p - 50 AS gone FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.p = c.i),
k AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), FALSE) AS begins FROM g),
a AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans, string_agg(b, '' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""
