"""Benchmark decontamination: a prefix-filtered set join over item-sized windows.

Shingles are the words of a benchmark window (13 consecutive words, or the whole item if it has
fewer). Words are ordered by their rarity over all documents. For full containment the necessary
prefix of a window is its rarest word: a document that holds the window holds that word. The join
therefore looks up every document word among the windows' prefix words, keeps a position only if
the window fits around it (length and positional bound), and compares all its words.

The benchmark is read in blocks of about BLOCK_WORDS words; longer items are cut, and overlap by a window but one word. A block's
words, once each, and four numbers for each window are broadcast, so what is broadcast is bounded whatever the
benchmark's size or its items', and more blocks mean more narrow passes over the documents. No pass shuffles the documents; only word counts of a block's vocabulary move.

Edge cases: a null or empty text has no words (n_words 0, not contaminated); items without words
make no window; items with equal windows count each, rows of one item_id once; an item with a null id marks
words as hit but is in no item list; an empty benchmark hits nothing; repeated documents are judged
each; columns of the input with the names of added columns are replaced.
"""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotate, col, cut, table, texts, without

WINDOW = 13
MIN_SHARE = 20  # contaminated if at least one word in 20 is hit
BLOCK_WORDS = 1 << 20
_ADDED = ["n_words", "n_hit", "hit_items", "n_items", "contaminated"]

# Word characters are 0-9, a-z after lower-casing, and all beyond ASCII.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows_of(seq: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    return [tuple(seq[i : i + size]) for i in range(max(1, len(seq) - size + 1))] if seq else []


def _blocks(benchmark: DataFrame, window: int):
    """Lists of (item, its words or a part of them)."""
    block, held = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        seq = words(text)
        for at in range(0, max(1, len(seq) - window + 1), BLOCK_WORDS):
            part = seq[at : at + BLOCK_WORDS + window - 1]
            block.append((item, part))
            held += len(part)
            if held >= BLOCK_WORDS:
                yield block
                block, held = [], 0
    if block:
        yield block


def _rarity(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Occurrences of each vocabulary word over all documents; one row per word and task is shuffled."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        wanted, total = known.value, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(filter(wanted.__contains__, words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


class Prefixes:
    """Windows of a block by their rarest word: for each, its part of an item, its place there, its length and the word's place in it."""

    def __init__(self, parts: list[list[bytes]], rarity: dict[bytes, int], window: int):
        numbers: dict[bytes, int] = {}
        self.parts = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in part), np.int32, len(part)) for part in parts]
        self.words = list(numbers)
        rank = np.empty(len(numbers), dtype=np.int64)  # by rarity, then the word
        rank[sorted(range(len(numbers)), key=lambda k: (rarity.get(self.words[k], 0), self.words[k]))] = np.arange(len(numbers))
        known = np.fromiter((rarity.get(w, 0) > 0 for w in self.words), bool, len(numbers))
        rows = []
        for number, part in enumerate(self.parts):
            if not len(part):
                continue
            size = min(window, len(part))
            views = np.lib.stride_tricks.sliding_window_view(rank[part], size)
            at = views.argmin(axis=1)
            place = np.arange(len(at))
            first = part[place + at]
            every = known[part]
            # A window with a word that no document has occurs in none.
            keep = np.lib.stride_tricks.sliding_window_view(every, size).all(axis=1)
            rows.append(np.stack([first[keep], np.full(int(keep.sum()), number), place[keep], np.full(int(keep.sum()), size), at[keep]]))
        table = np.concatenate(rows, axis=1) if rows else np.zeros((5, 0), np.int64)
        table = table[:, np.argsort(table[0], kind="stable")]
        self.windows = table[1:].astype(np.int32)
        self.ends = np.searchsorted(table[0], np.arange(len(numbers) + 1)).astype(np.int32)

    @functools.cached_property
    def ready(self) -> tuple[dict[bytes, int], list[bool], list[list[int]]]:
        """Numbers of the words, which of them start a look-up, and the parts' words; made once in a Python worker."""
        return {w: k for k, w in enumerate(self.words)}, (np.diff(self.ends) > 0).tolist(), [p.tolist() for p in self.parts]


def _probe(seq: list[bytes], prefixes: Prefixes, hits: set[int], items: set[int]) -> None:
    """Adds the words of seq that lie in an occurring window, and the parts of items that have these."""
    numbers, starts, parts = prefixes.ready
    ids, n = [numbers.get(w, -1) for w in seq], len(seq)
    for p, k in enumerate(ids):
        if k >= 0 and starts[k]:
            for part, place, size, at in prefixes.windows[:, prefixes.ends[k] : prefixes.ends[k + 1]].T.tolist():
                start = p - at
                if start >= 0 and start + size <= n and ids[start : start + size] == parts[part][place : place + size]:
                    hits.update(range(start, start + size))
                    items.add(part)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: int = MIN_SHARE) -> DataFrame:
    """docs with n_words, n_hit, hit_items (sorted array), n_items and contaminated."""
    context = docs.sparkSession.sparkContext
    out = without(docs, _ADDED)
    state = out.select("*", F.lit(None).cast("array<int>").alias("__hits"), F.lit(None).cast("array<string>").alias("__items"), F.lit(0).cast("long").alias("__n"))
    number = -1
    for number, block in enumerate(_blocks(benchmark, window)):
        vocabulary = {w for _, part in block for w in part}
        prefixes = Prefixes([part for _, part in block], _rarity(docs, vocabulary), window)
        shared = context.broadcast((prefixes, [item for item, _ in block]))

        def run(text, hits, items, shared=shared):
            prefixes, ids = shared.value
            got_hits, got_items, sizes = [], [], []
            for t, h, i in zip(text, hits, items):
                seq, found = words(t), set()
                h = set(h or ())
                _probe(seq, prefixes, h, found)
                got_hits.append(sorted(h))
                got_items.append(sorted({*(i or ()), *(ids[x] for x in found if ids[x] is not None)}))
                sizes.append(len(seq))
            return [got_hits, got_items, sizes]

        if number:
            state = cut(state)
        state = annotate(state, ["text", "__hits", "__items"], run, "__hits array<int>, __items array<string>, __n long")
    if number < 0:
        state = annotate(state, ["text"], lambda text: [[len(words(t)) for t in text]], "__n long")
    n_hit = F.when(F.col("__hits").isNull(), F.lit(0)).otherwise(F.size("__hits")).cast("long")
    items = F.coalesce(F.col("__items"), F.array().cast("array<string>"))
    return state.select(*[col(c) for c in out.columns], F.col("__n").alias("n_words"), n_hit.alias("n_hit"), items.alias("hit_items"), F.size(items).cast("long").alias("n_items"), ((n_hit > 0) & (min_share * n_hit >= F.col("__n"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold any benchmark window, however small its share of them, in their own columns."""
    own = [c for c in docs.columns if c.lower() in _ADDED]
    renamed = docs.select(*[col(c).alias(f"__own_{c}" if c in own else c) for c in docs.columns])
    kept = decontaminate(renamed, benchmark).where("n_hit = 0")
    return kept.select(*[col(f"__own_{c}").alias(c) if c in own else col(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(texts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, array_to_string(list_slice(w, i, i + 12), ' ') AS win, least(len(w), 13) AS n FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
m AS (SELECT DISTINCT doc_id, i, dw.n AS n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
k AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""
