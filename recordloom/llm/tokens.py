"""Token-ID output: files of independent zstandard frames with a trailing seek table.

A file holds documents in order. Layout, integers little-endian:

    frame*            zstandard frames, each of whole documents' ids as unsigned 32-bit integers
    skippable frame   magic 0x184D2A5E, length, then the seek table:
      per frame       compressed bytes u32, raw bytes u32, crc32 of the raw bytes u32, documents u32
      per document    key i64 (its number; NULL_KEY for null), ids u32, crc32 of its ids u32
      footer          frames u32, documents u64, ids u64, magic b"TKSEEK\\r\\n"

Any zstandard tool can stream a file; a reader takes the footer and decompresses only the frames that
hold the documents asked for, checking each frame's checksum. The last byte is a line end because
Spark's text writer, which puts one file per row in any store that Hadoop can reach, ends rows so.

Documents are range-partitioned by doc_id, so files in the order of their task and number hold ascending ids; a task encodes
its range and starts a new file beyond FILE_BYTES of ids, so files and memory are bounded. Only the
text moves, once. The first id's position follows from the files' totals.

Edge cases: null and empty texts have the end id alone; a null doc_id sorts first; documents that share an id stand
in the order of a hash of their text, then of the text; repeated rows are repeated documents; an empty table writes no document, and reads back as no rows; a document of any length is one piece of one frame.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary, cut, gone_at_exit, parts_of, shared_dir, table, texts
from .symbols import spelled

END_ID = 2
FRAME_BYTES = 1 << 18
FILE_BYTES = 1 << 24
SLOTS = 1 << 21  # of a Python worker's table of known words
PART = 1 << 17  # bytes of text that are cut into words at once; a longer text is a part of its own
NULL_KEY = -(2**63)
_FAR = "\u0250"  # letters, digits and white space before it are the same in all versions of Unicode in use
# Fixed values of byte-level tokenizer files: the pattern of pieces (with classes up to _FAR), and the letters that stand for bytes.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_PIECE = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LETTERS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_GAPS = ("  ", " \n", "\n ", "\n\n")

# Fixed values of the file format.
_SKIP, _MAGIC = 0x184D2A5E, b"TKSEEK\r\n"
_FRAME, _DOC, _FOOT = struct.Struct("<IIII"), struct.Struct("<qII"), struct.Struct("<IQQ8s")


class Words:
    """A hash table of known words, by two 64-bit hashes: where their ids are in a pool, and how many. It starts afresh when half full."""

    WHOLE = (1 << 32) - 1  # instead of a number of ids: texts with the word are encoded whole

    def __init__(self, slots: int = SLOTS):
        self.slots = slots  # a power of two
        self.clear()

    def clear(self) -> None:
        self.one, self.two = np.zeros((2, self.slots), dtype=np.uint64)  # both 0: free
        self.at, self.count = np.zeros((2, self.slots), dtype=np.uint32)
        self.pool, self.end, self.used = np.zeros(1 << 16, dtype=np.uint32), 0, 0

    def _start(self, one: np.ndarray) -> np.ndarray:
        return (one & np.uint64(self.slots - 1)).astype(np.int64)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The slot of each word; -1 for new ones."""
        place, left = self._start(one), np.arange(len(one))
        out = np.full(len(one), -1)
        while len(left):
            a, b = self.one[place], self.two[place]
            same = (a == one[left]) & (b == two[left])
            out[left[same]] = place[same]
            more = ~same & ((a != 0) | (b != 0))
            left, place = left[more], (place[more] + 1) & (self.slots - 1)
        return out

    def learn(self, one: np.ndarray, two: np.ndarray, ids: list[bytes | None]) -> None:
        """Adds different new words with their ids; None: texts with it are encoded whole."""
        sizes = np.fromiter((self.WHOLE if x is None else len(x) // 4 for x in ids), np.int64, len(ids))
        flat = np.frombuffer(b"".join(x for x in ids if x), "<u4")
        if self.end + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.end], np.zeros(max(len(self.pool), len(flat)), np.uint32)])
        self.pool[self.end : self.end + len(flat)] = flat
        held = np.where(sizes == self.WHOLE, 0, sizes)
        at = self.end + np.cumsum(held) - held
        self.end, self.used = self.end + len(flat), self.used + len(ids)
        place, left = self._start(one), np.arange(len(one))
        while len(left):
            free = np.flatnonzero((self.one[place] == 0) & (self.two[place] == 0))
            _, first = np.unique(place[free], return_index=True)
            won = free[first]
            slot, word = place[won], left[won]
            self.one[slot], self.two[slot], self.at[slot], self.count[slot] = one[word], two[word], at[word], sizes[word]
            rest = np.ones(len(left), dtype=bool)
            rest[won] = False
            left, place = left[rest], place[rest]
            # Those that met a taken slot move on; those that lost a free one find it taken next.
            place = np.where((self.one[place] != 0) | (self.two[place] != 0), (place + 1) & (self.slots - 1), place)


def _alone(word: str) -> bool:
    """Whether the borders of a word stand: other white space at an end of it may join the space beside it."""
    return word == "\n" or word.strip() == word.removeprefix(" ")


class Encoder:
    """Ids of texts by a tokenizer file, as little-endian bytes; words, with the single space or line end before them, are encoded once.

    The file's pre-tokenizer never joins characters over the border between a non-space and a single
    space or line end that a non-space follows, so those words can be encoded apart. Texts with other
    white space runs, or that hold an added token's string, are encoded whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.newline = self._ids("\n")
        self.known = Words()
        form = json.loads(self.tokenizer.to_str())
        before = form["pre_tokenizer"] or {}
        usual = before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before["use_regex"]
        self.bare = Tokenizer(self.tokenizer.model) if usual and form["normalizer"] is None and form["post_processor"] is None else None

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _cut_ids(self, text: str) -> bytes:
        """The same for a text without far characters, cut by the file's usual pre-tokenizer here, which takes half the time."""
        pieces = "\0".join(_PIECE.findall(text)).encode().decode("latin-1").translate(_LETTERS).split(_LETTERS[0])
        return np.array(self.bare.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _found(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of many words from one text of lines: a line end after a non-space and before a word or its space is a token of its own."""
        near, far = [], []
        for w in words:
            if w == "\n":
                yield w, self.newline
            else:
                (near if self.bare and (w.isascii() or max(w) < _FAR) and "\0" not in w else far).append(w)
        for some, ids_of in [(w[at : at + 5000], f) for w, f in ((near, self._cut_ids), (far, self._ids)) for at in range(0, len(w), 5000)]:
            data = ids_of("\n".join(some))
            cuts = (np.flatnonzero(np.frombuffer(data, dtype="<u4") == np.frombuffer(self.newline, dtype="<u4")[0]) * 4).tolist() if len(self.newline) == 4 else []
            if len(cuts) != len(some) - 1:
                yield from ((w, self._ids(w)) for w in some)
            else:
                yield from ((w, data[a:b]) for w, a, b in zip(some, [0, *(c + 4 for c in cuts)], [*cuts, len(data)]))

    def _cut(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, where words begin, then the end; number of words before each text, then of all; whether a text may be encoded by words).

        A word has the single space before it; a line end is one. Not by words: empty texts, texts with white space at an end or two
        such characters in a row, texts that hold an added token's string.
        """
        data, ends = binary(text)
        line = data == 10
        gap = line | (data == 32)
        begins = gap.copy()
        begins[1:] |= line[:-1]
        size = np.diff(ends)
        some = size > 0
        begins[ends[:-1][some]] = True
        fine = some.copy()
        fine[some] = ~gap[ends[:-1][some]] & ~gap[ends[1:][some] - 1]
        twice = np.flatnonzero(gap[1:] & gap[:-1])
        fine[np.searchsorted(ends, twice, side="right") - 1] = False
        for token in self.added:
            fine &= ~pc.match_substring(text, token).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(begins)
        return data, np.append(at, len(data)), np.searchsorted(at, ends), fine

    def _places(self, data: np.ndarray, begin: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Slots of the wanted words; new ones are encoded."""
        one, two = spelled(data, begin)[wanted], spelled(~data, begin)[wanted]
        if self.known.used * 2 > self.known.slots:
            self.known.clear()
        place = self.known.find(one, two)
        new = np.flatnonzero(place < 0)
        if len(new):
            _, first = np.unique(one[new], return_index=True)
            first = new[first]
            raw, where = data.tobytes(), np.flatnonzero(wanted)[first]
            words = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(begin[where].tolist(), begin[where + 1].tolist())]
            ids = dict(self._found([w for w in words if _alone(w)]))
            if 2 * (self.known.used + len(words)) > self.known.slots:
                # The part alone must fit: the table grows for it.
                while 4 * (len(words) + 1) > self.known.slots:
                    self.known.slots *= 2
                self.known.clear()
                return self._places(data, begin, wanted)
            self.known.learn(one[first], two[first], [ids.get(w) for w in words])
            place[new] = self.known.find(one[new], two[new])
            if (place < 0).any():  # words with one hash in common: the others come in the next turn
                return self._places(data, begin, wanted)
        return place

    def encode(self, batch: pa.Array) -> Iterator[bytes]:
        """Ids of each text."""
        texts = batch.fill_null("")
        for text in parts_of(texts, PART):
            data, begin, before, fine = self._cut(text)
            counts = np.diff(before)
            wanted = np.repeat(fine, counts)
            place = self._places(data, begin, wanted) if wanted.any() else np.zeros(0, np.int64)
            sizes = np.zeros(len(wanted), dtype=np.int64)
            sizes[wanted] = self.known.count[place]
            odd = sizes == Words.WHOLE
            if odd.any():
                fine[np.searchsorted(before, np.flatnonzero(odd), side="right") - 1] = False
                sizes[odd] = 0
            start = np.zeros(len(wanted), dtype=np.int64)
            start[wanted] = self.known.at[place]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            flat = self.known.pool[np.repeat(start - (ends - sizes), sizes) + np.arange(total)].astype("<u4").tobytes()
            cuts = (4 * np.concatenate([[0], ends])[before]).tolist()
            for k, ok in enumerate(fine.tolist()):
                if ok:
                    yield flat[cuts[k] : cuts[k + 1]]
                else:
                    whole = text[k].as_py()
                    yield self._ids(whole) if whole else b""


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_file(docs: Iterable[tuple[int | None, bytes]]) -> bytes:
    """One file of (key, ids as bytes), without its last byte, which the row's end adds."""
    squeeze = zstandard.ZstdCompressor(level=1, write_checksum=True)
    frames, table, body, raw, n, size = [], [], [], [], 0, 0
    total = 0

    def close():
        nonlocal raw, n, size
        if n:
            data = b"".join(raw)
            packed = squeeze.compress(data)
            body.append(packed)
            frames.append(_FRAME.pack(len(packed), len(data), zlib.crc32(data), n))
        raw, n, size = [], 0, 0

    for key, ids in docs:
        raw.append(ids)
        n += 1
        size += len(ids)
        total += len(ids) // 4
        table.append(_DOC.pack(NULL_KEY if key is None else key, len(ids) // 4, zlib.crc32(ids)))
        if size >= FRAME_BYTES:
            close()
    close()
    seek = b"".join([*frames, *table, _FOOT.pack(len(frames), len(table), total, _MAGIC)])
    return b"".join([*body, struct.pack("<II", _SKIP, len(seek)), seek])[:-1]


class TokenFile:
    """Reader of one file's bytes."""

    def __init__(self, data: bytes):
        n_frames, n_docs, self.total, magic = _FOOT.unpack_from(data, len(data) - _FOOT.size)
        if magic != _MAGIC:
            raise ValueError("not a token file: its last bytes are no seek table")
        at = len(data) - _FOOT.size - n_docs * _DOC.size - n_frames * _FRAME.size
        self.data, self.frames, self.docs = data, [], []
        start, first = 0, 0
        for k in range(n_frames):
            packed, raw, crc, n = _FRAME.unpack_from(data, at + k * _FRAME.size)
            self.frames.append((start, packed, raw, crc, first, n))
            start, first = start + packed, first + n
        at += n_frames * _FRAME.size
        for k in range(n_docs):
            key, n, crc = _DOC.unpack_from(data, at + k * _DOC.size)
            self.docs.append((None if key == NULL_KEY else key, n, crc))

    def frame(self, number: int) -> bytes:
        start, packed, raw, crc, *_ = self.frames[number]
        data = zstandard.ZstdDecompressor().decompress(self.data[start : start + packed], max_output_size=max(raw, 1))
        if zlib.crc32(data) != crc:
            raise ValueError(f"frame {number} is damaged")
        return data

    def read(self, wanted: set | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(key, ids as bytes) of the documents in wanted, or of all; other frames stay compressed."""
        for number, (*_, first, n) in enumerate(self.frames):
            held = self.docs[first : first + n]
            if wanted is None or any(key in wanted for key, *_ in held):
                data, at = self.frame(number), 0
                for key, size, crc in held:
                    ids = data[at : at + 4 * size]
                    at += 4 * size
                    if wanted is None or key in wanted:
                        if zlib.crc32(ids) != crc:
                            raise ValueError(f"document {key} is damaged")
                        yield key, ids


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Writes token files of docs (doc_id, text) below path, in ascending doc_id order."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    end = struct.pack("<I", end_id)

    def run(batches):
        encode = encoder(tokenizer).encode
        held, size = [], 0
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(keys), 500):
                for key, ids in zip(keys[at : at + 500], encode(rows.slice(at, 500))):
                    held.append((key, ids + end))
                    size += len(ids) + 4
                    if size >= FILE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([write_file(held)], pa.binary())], names=["value"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([write_file(held)], pa.binary())], names=["value"])

    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text").asc_nulls_first()]  # documents that share an id are spread, and stand in one order
    files = docs.repartitionByRange(parts, *by[:2]).sortWithinPartitions(*by).select("doc_id", "text").mapInArrow(run, "value binary")
    files.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def read_tokens(spark: SparkSession, path: str, wanted: set | None = None) -> DataFrame:
    """file, place (in the file), doc_id, n_tokens, start (in the file), ids of token files below path."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = TokenFile(data.as_py())
                at, places = 0, {}
                for place, (key, n, _) in enumerate(held.docs):
                    places.setdefault(key, []).append((place, at))
                    at += n
                rows = [(name, *places[key].pop(0), key, len(ids) // 4, ids) for key, ids in held.read(wanted)]
                for k in range(0, len(rows), 1000):
                    cols = list(zip(*rows[k : k + 1000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["file", "place", "start", "doc_id", "n_tokens", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, place long, start long, doc_id long, n_tokens long, ids binary")


def with_starts(rows: DataFrame) -> DataFrame:
    """Rows of read_tokens (file, start, n_tokens, others) with `start` counted over all files.

    Files stand in the order of their task and of their number in it, as numbers. Tasks' totals, a row a task, are
    added up on the driver; those of a task's files by a window over the task. rows are read twice.
    """
    spark = rows.sparkSession
    number = lambda pattern: F.regexp_extract("file", pattern, 1).cast("long")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total")).select("file", "total", number(r"part-(\d+)-[^/]*$").alias("task"), F.coalesce(number(r"-c(\d+)[^/]*$"), F.lit(0)).alias("number"))
    tasks, at = [], 0
    for task, total in sorted((r.task, r.total) for r in files.groupBy("task").agg(F.sum("total").alias("total")).collect()):
        tasks.append((task, at))
        at += total
    before = Window.partitionBy("task").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    own = files.select("file", "task", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    base = own.join(spark.createDataFrame(tasks, "task long, base long"), "task").select("file", (F.col("base") + F.col("before")).alias("base"))
    return rows.join(base, "file").withColumn("start", F.col("base") + F.col("start")).drop("base")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark, "tokens")
    gone_at_exit(spark, path)
    write_tokens(texts(table(spark, sf_dir, "documents")), path, public_tokenizers.path("byte_bpe_50k.json"))
    rows = cut(read_tokens(spark, path).select("file", "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")))
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
