"""Substring dedup on words: removes each word covered by a window of 13 that also starts in a document of smaller id.

Words are runs of bytes other than space and \\t to \\r, unchanged; windows are judged on the input.
Method: recompression, a Spark round over all blocks for each of its rounds, names every window by one of its interior symbols
(symbols.py); segments under names that documents share are brought together (repeats.py), and their windows are verified as whole words.

Edge cases: null and empty texts and texts of fewer than 13 words lose nothing; documents without an id, or of
equal ids, are no smaller than each other; an empty table gives no rows; columns of the input named like an added one are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, table, texts
from .repeats import CHUNK, Items, covered_counts, unpacked, without_repeats
from .symbols import COINS, ROUNDS, joined_pairs, spelled, window_names

WINDOW = 13
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True


class Words(Items):
    """data: the words of all texts, each with a space after it."""

    window = WINDOW

    def __init__(self, text: pa.Array, coins: tuple[int, ...] = ()):
        self.coins = coins
        data, offsets = binary(text)
        blank = _BLANK[data]
        ends = ~blank  # of words: the byte after is blank, or the text ends
        ends[:-1] &= blank[1:]
        edge = offsets[1:][np.diff(offsets) > 0] - 1
        ends[edge] = ~blank[edge]
        # Each word byte once, and a space after each word's last.
        times = (~blank).astype(np.int8) + ends
        out = np.repeat(data, times)
        kind = np.int32 if len(data) < 1 << 30 else np.int64
        places = np.cumsum(times, dtype=kind)
        last = places[ends] - 1  # of the spaces
        out[last] = 32
        self.data, self.raw = out, out.tobytes()
        self.begin = np.concatenate([np.zeros(1, kind), last + 1])  # of each word, and the end
        self.n = len(last)
        self.starts = np.concatenate([np.zeros(1, kind), np.cumsum(ends, dtype=kind)])[offsets].astype(np.int64)

    def tokens(self, a: int, b: int) -> np.ndarray:
        begin = self.begin[a : b + 1]
        return spelled(self.data[begin[0] : begin[-1]], begin - begin[0])

    def names(self, a: int, b: int) -> np.ndarray:
        return window_names(self.tokens(a, b + WINDOW - 1), WINDOW, self.coins)

    def part(self, first: int, count: int) -> bytes:
        return self.raw[self.begin[first] : self.begin[first + count + WINDOW - 1] - 1]


def rounds(blocks: DataFrame, text_at: int) -> Callable[[pa.Array], Words]:
    """Words with the coins of all rounds, each settled by the pairs of all documents."""
    coins: tuple[int, ...] = ()
    columns = [f"c{bit}" for bit in COINS]
    while len(coins) < ROUNDS:

        def count(batches, coins=coins):
            for batch in batches:
                total = np.zeros(len(COINS), np.int64)
                for data in batch.column(1):
                    items = Words(unpacked(data).column(text_at))
                    for a in range(0, items.n, CHUNK):
                        total += joined_pairs(items.tokens(a, min(a + CHUNK, items.n)), coins)
                yield pa.RecordBatch.from_arrays([pa.array([n]) for n in total.tolist()], names=columns)

        sums = blocks.mapInArrow(count, ", ".join(f"{c} long" for c in columns)).agg(*[F.sum(c) for c in columns]).first()
        coins += (max(COINS, key=lambda bit: (sums[bit - COINS[0]] or 0, -bit)),)
    return functools.partial(Words, coins=coins)


def judge(segments: list[bytes], names: np.ndarray, least: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Windows of the segments of a name, in order of documents, against those of smaller documents, word for word."""
    order = np.lexsort((least, names))
    name, count = names[order], len(order)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, count), bool), name[1:] != name[:-1]]))
    out: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(first.tolist(), np.append(first[1:], count).tolist()):
        if least[order[a]] == least[order[b - 1]]:
            continue
        known: dict[bytes, int] = {}
        for k in order[a:b].tolist():
            segment, doc, spans = segments[k], int(least[k]), []
            begin = [0, *(np.flatnonzero(np.frombuffer(segment, np.uint8) == 32) + 1).tolist(), len(segment) + 1]
            for i in range(len(begin) - WINDOW):
                if known.setdefault(segment[begin[i] : begin[i + WINDOW] - 1], doc) < doc:
                    if spans and sum(spans[-1]) == i:
                        spans[-1] = spans[-1][0], spans[-1][1] + 1
                    else:
                        spans.append((i, 1))
            if spans:
                out[k] = spans
    return out


def finish(items: Words, covered: np.ndarray) -> list[pa.Array]:
    size, removed, _ = covered_counts(items, covered)
    sizes = np.diff(items.begin)
    data = items.data[np.repeat(~covered, sizes)].tobytes()
    ends = np.concatenate([[0], np.cumsum(np.where(covered, 0, sizes))])[items.starts].tolist()
    kept = [data[a : max(a, b - 1)] for a, b in zip(ends, ends[1:])]
    return [pa.array(size), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())]


def drop_passages(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_removed and kept (the words left, joined by a space)."""
    return without_repeats(docs, rounds, judge, finish, "n_words long, n_removed long, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_passages(texts(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s FROM d, unnest(range(1, len(w) - 11)) AS t(i) WHERE len(w) >= 13),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM (SELECT w.doc_id, i FROM w JOIN f USING (s) WHERE first < w.doc_id)),
p AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
k AS (SELECT p.doc_id, count(c.p) AS n_removed, string_agg(word, ' ' ORDER BY p.p) FILTER (WHERE c.p IS NULL) AS kept FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.p = c.p GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
