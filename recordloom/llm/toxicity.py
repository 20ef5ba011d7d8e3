"""Toxicity: Levenshtein automata over a lexicon trie, and context windows that tell quotation from abuse.

The lexicon is learned: words, and word beginnings (stem*), that are far likelier in toxic than in
other labelled documents and follow several different words there, which words of a copied passage
don't. Its trie is intersected with the Levenshtein automaton of one edit: a state is the set of trie
nodes within an edit, made when first met and kept, so a word costs one step per letter and most end
after a few. Terms of five letters or more may be misspelled by an edit; misspellings that are
ordinary words of clean documents are exempt. A hit inside quotation marks (which open and close on its line, within QUOTE
characters of it), or with a reporting verb among WINDOW words on either side, counts as quoted. A logistic model turns counts of exact, misspelled and quoted hits
and their density into the score.

Labels, languages, sources and ids are no inputs of a score. Documents whose crc32(doc_id as text)
mod 3 is 1 are held out of training. Training reads at most SAMPLE labelled documents, those with the
smallest hash of their id, and keeps the TERMS terms of the highest odds; all documents are scored, whole, in one narrow pass with a small broadcast.

Edge cases: null and empty texts have no hits and the score of the bias; without toxic labels the
lexicon is empty and all scores are the training share; repeated labels of a document count as toxic
if any is; labels other than 0 and 1, or of null ids, are ignored; a null doc_id is not held out.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotate, cut, table, texts

SAMPLE = 20_000  # labelled documents that the model is fitted on, at most
TERMS = 3_000  # terms of the lexicon, at most
MIN_CONTEXTS, MIN_ODDS = 5, 20.0
FUZZY = 5  # letters from which a term may be misspelled
CUTOFF = 0.7
WINDOW = 6  # words on either side
QUOTE = 200  # characters on either side in which quotation marks are looked for

_WORD = re.compile(r"[^\W_]+")
_OPEN, _CLOSE = "\"“„«‘", "\"”“»’"
_REPORT = frozenset("said says called calls wrote quote quoted quotes dit disait sagte nannte dijo llamó".split())


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class _State(dict):
    """A set of (trie node, edits) with its transitions, made when first asked for."""

    __slots__ = ("machine", "members", "best")

    def __init__(self, machine, members: dict[int, int]):
        super().__init__()
        self.machine, self.members = machine, members
        ends = [(e, machine.ends[n]) for n, e in members.items() if machine.ends[n]]
        self.best = 2 if any(e == 0 for e, _ in ends) else 1 if any(e and k >= FUZZY for e, k in ends) else 0

    def __missing__(self, letter):
        found = self[letter] = self.machine.step(self, letter)
        return found


class Lexicon:
    """Trie of terms, run as an automaton: match() gives 2 for a term, 1 for a misspelled one, 0 for others."""

    def __init__(self, terms: list[str], exempt: set[str] = frozenset()):
        self.exempt = exempt
        self.nodes: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]
        self.stems: set[int] = set()
        for term in terms:
            node = 0
            for letter in term.rstrip("*"):
                node = self._child(node, letter)
            if term.endswith("*"):
                self.stems.add(node)
            else:
                self.ends[node] = len(term)
        self.states: dict[tuple, _State] = {}
        self.dead = self._state({})
        self.start = self._state(self._closed({0: 0}))

    def _child(self, node: int, letter: str) -> int:
        if letter not in self.nodes[node]:
            self.nodes[node][letter] = len(self.nodes)
            self.nodes.append({})
            self.ends.append(0)
        return self.nodes[node][letter]

    def _state(self, members: dict[int, int]) -> _State:
        key = tuple(sorted(members.items()))
        if key not in self.states:
            if len(self.states) > 200_000:  # start afresh rather than grow with the input
                self.states.clear()
            self.states[key] = _State(self, members)
        return self.states[key]

    def _closed(self, members: dict[int, int]) -> dict[int, int]:
        """With the nodes that a skipped letter of the term reaches."""
        for node, edits in list(members.items()):
            if not edits:
                for child in self.nodes[node].values():
                    members.setdefault(child, 1)
        return members

    def step(self, state: _State, letter: str) -> _State:
        out: dict[int, int] = {}
        for node, edits in state.members.items():
            child = self.nodes[node].get(letter)
            if child is not None:
                out[child] = min(edits, out.get(child, 9))
            if not edits:
                out.setdefault(node, 1)
                for other in self.nodes[node].values():
                    out.setdefault(other, 1)
        return self._state(self._closed(out)) if out else self.dead

    def match(self, word: str) -> int:
        state, dead = self.start, self.dead
        for letter in word:
            state = state[letter]
            if state is dead:
                break
        if state.best == 2 or self.stems and self._stem(word):
            return 2
        return 1 if state.best and word not in self.exempt else 0

    def _stem(self, word: str) -> bool:
        node = 0
        for letter in word:
            node = self.nodes[node].get(letter)
            if node is None:
                return False
            if node in self.stems:
                return True
        return False


def _quoted(text: str, start: int, end: int, near: list[str]) -> bool:
    if any(w in _REPORT for w in near):
        return True
    line = text[text.rfind("\n", 0, start) + 1 : start][-QUOTE:]
    tail = text[end : end + QUOTE].split("\n")[0]
    for a, b in zip(_OPEN, _CLOSE):
        opened = line.count(a) % 2 == 1 if a == b else line.rfind(a) > line.rfind(b)
        if opened and b in tail:
            return True
    return False


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """log counts of exact, misspelled and quoted hits, and hits per hundred words."""
    text = text or ""
    words = words_of(text)
    hits = {w: k for w in set(words) if (k := lexicon.match(w))}
    if not hits:
        return [0.0] * 4
    exact = fuzzy = quoted = 0
    low = text if len(text.lower()) != len(text) else text.lower()
    for n, m in enumerate(_WORD.finditer(low)):
        if kind := hits.get(m[0].lower(), 0):
            if _quoted(text, *m.span(), words[max(0, n - WINDOW) : n + WINDOW + 1]):
                quoted += 1
            elif kind == 2:
                exact += 1
            else:
                fuzzy += 1
    return [math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(100 * (exact + fuzzy) / len(words))]


def _learned(batches):
    """(word, word before or null, toxic documents, others) of each task's documents; words and stems, once a document."""
    for batch in batches:
        rows: dict[tuple[str, str | None], list[int]] = {}
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen, before = {}, ""
            for w in words_of(text):
                seen.setdefault(w, before)
                for size in (4, 5, 6):
                    if len(w) > size:
                        seen.setdefault(w[:size] + "*", before)
                before = w
            for w, left in seen.items():
                rows.setdefault((w, left if toxic else None), [0, 0])[1 - toxic] += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([b for _, b in rows], pa.string()), pa.array([x[0] for x in rows.values()], pa.int64()), pa.array([x[1] for x in rows.values()], pa.int64())], names=["word", "before", "toxic", "clean"])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and bias (last) by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], set[str], list[float]]:
    """(terms, exempt words, weights with the bias last)."""
    spark = docs.sparkSession
    key = F.col("doc_id").cast("long")
    training = F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) != 1, F.lit(False))
    known = labels.where(F.col("toxic").isin(0, 1) & training).groupBy(key.alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = cut(texts(docs).join(F.broadcast(chosen), "doc_id").select("toxic", "text"))  # at most `sample` documents, read three times
    n_toxic, n_all = chosen.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    share = min(max(n_toxic / n_all, 0.01), 0.5) if n_all else 0.1
    bias = [0.0, 0.0, 0.0, 0.0, math.log(share / (1 - share))]
    if not n_toxic:
        return [], set(), bias
    counts = rows.mapInArrow(_learned, "word string, before string, toxic long, clean long").groupBy("word", "before").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    words = cut(counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count("before").alias("contexts")))
    odds = ((F.col("toxic") + 0.5) / F.lit(n_toxic + 1.0)) / ((F.col("clean") + 0.5) / F.lit(n_all - n_toxic + 1.0))
    best = words.where((F.col("contexts") >= MIN_CONTEXTS) & (odds >= MIN_ODDS)).orderBy(odds.desc(), "word").limit(TERMS)
    terms = [r.word for r in best.select("word").collect()]
    first = spark.sparkContext.broadcast(terms)

    def benign(batches):
        lexicon = Lexicon(first.value)
        for batch in batches:
            found = [w for w in batch.column(0).to_pylist() if lexicon.match(w) == 1]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["word"])

    # At most the words within an edit of a term: bounded by the lexicon.
    exempt = {r.word for r in words.where((F.col("clean") > 0) & ~F.col("word").endswith("*") & (odds < MIN_ODDS)).select("word").mapInArrow(benign, "word string").collect()}
    model = spark.sparkContext.broadcast((terms, exempt))

    def measured(batches):
        lexicon = Lexicon(*model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t, lexicon) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=["toxic", "x"])

    got = rows.mapInArrow(measured, "toxic int, x array<double>").collect()
    x, y = np.array([r.x for r in got]).reshape(-1, 4), np.array([r.toxic for r in got], dtype=float)
    weights = logistic(x, y)
    # A misspelled hit says no more than an exact one, and no less than two thirds of it where training has few.
    weights[1] = min(max(weights[1], weights[0] * 2 / 3), weights[0])
    weights[:2] = np.maximum(weights[:2], 0)
    weights[3] = max(weights[3], 0)
    return terms, exempt, [float(w) for w in weights]


_lexicons: dict[str, Lexicon] = {}


def _lexicon(name: str, terms: list[str], exempt: set[str]) -> Lexicon:
    """The automaton of a model; a Python worker keeps the last one for all its tasks."""
    if name not in _lexicons:
        _lexicons.clear()
        _lexicons[name] = Lexicon(terms, exempt)
    return _lexicons[name]


def score_with(docs: DataFrame, model: tuple) -> DataFrame:
    """docs with score (0 to 1)."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(text):
        terms, exempt, weights = shared.value
        lexicon = _lexicon(name, terms, exempt)
        out = []
        for t in text:
            z = sum(w * x for w, x in zip(weights, features(t, lexicon))) + weights[-1]
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return [out]

    return annotate(docs, ["text"], run, "score double")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_with(docs, fit(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """docs below the cutoff, in their own columns."""
    rated = annotate_score(docs, fit(docs, labels))
    return rated.where(F.col("__toxicity") < cutoff).select(*docs.columns)


def annotate_score(docs: DataFrame, model: tuple) -> DataFrame:
    """docs with __toxicity, so that a column named score stays."""
    renamed = docs.withColumnRenamed("score", "__score") if "score" in docs.columns else docs
    rated = score_with(renamed, model).withColumnRenamed("score", "__toxicity")
    return rated.withColumnRenamed("__score", "score") if "__score" in rated.columns else rated


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = score(texts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return rated.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
