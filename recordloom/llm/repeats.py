"""Windows of a fixed length that also start in a document with a smaller id: shared by the byte and the word operators.

1. Documents are packed, as whole rows, into blocks of about BLOCK_BYTES of text (Arrow, zstandard), which are checkpointed,
   so that later passes see the same blocks even when executors are lost.
2. Every window gets a 64-bit name that depends on its items alone (least_grams, symbols.py). Consecutive windows
   of one name are a run. A block sends the sorted differences of its distinct names, a few bytes each, to buckets of names.
3. A bucket answers each block with two bits a name: whether documents of different ids hold it, and whether it is hot (more
   than HOT runs hold it).
4. A block sends each different segment (the text of a run) of a shared name once, whatever the number of its documents, with
   the least of their ids. Windows of hot names go one by one, each under a hash of all of it, so that the windows of a
   very common name spread over all buckets.
5. A bucket finds each segment's least document, and judges that document's windows against the other segments of the name
   (`judge`); all other documents of the segment lose all of it. Blocks get these answers in the order they asked in.

A row of an exchange is what one block and one bucket have to say to each other. Hashes only say what is compared with what:
segments are compared whole, windows within them by `judge`. Rows without an id are neither compared nor changed; rows that share an id aren't
smaller than each other.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, without

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BLOCK_BYTES = 8 << 20  # text of a block; a longer text is a block of its own
CHUNK = 1 << 17  # items whose windows are named at once
PIECE = 256  # windows of a segment at most: longer runs (of one letter, say) are cut
HOT = 4096  # runs of a name from which its windows go one by one
_BITS = 40  # of a name that are sent, besides its bucket


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MULTIPLIER
    return x ^ (x >> np.uint64(29))


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over each run of width values, from runs of doubling length."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = best(x[: len(x) - step], x[step:])
        done += step
    return x


def _grams(letters: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of each run of k letters, from runs of doubling length."""
    power, width, runs = MULTIPLIER, 1, letters  # runs: hashes of `width` letters; power: MULTIPLIER ** width
    done, out = 0, None  # out: hashes of the first `done` letters
    while True:
        if k & width:
            out = runs if out is None else out[: len(runs) - done] * power + runs[done:]
            done += width
        if done == k:
            return out
        runs = runs[: len(runs) - width] * power + runs[width:]
        power, width = power * power, width * 2


def least_grams(letters: np.ndarray, k: int, window: int) -> np.ndarray:
    """The name of each window: the least of the hashes of its runs of k letters (64-bit names of items)."""
    if len(letters) < window:
        return np.array([], dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = _grams(letters, k)
    return _slide(mixed(h), window - k + 1, np.minimum)


class Items:
    """The texts of a block as items: bytes, or words. Subclasses set window, n (items), starts (first item of each text, then n)."""

    window: int
    n: int
    starts: np.ndarray

    def names(self, a: int, b: int) -> np.ndarray:
        """Names of the windows that start at items a to b - 1."""
        raise NotImplementedError

    def part(self, first: int, count: int) -> bytes:
        """The text of `count` consecutive windows."""
        raise NotImplementedError

    def runs(self, known: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first window, windows, name, text number) of each run of a name within a text that is known."""
        found, starts = [], self.starts
        # Windows that would cross the end of a text, or lie in one that isn't known, are none.
        none = np.zeros(self.n + 1, dtype=np.int8)
        last = np.maximum(starts[1:] - self.window + 1, starts[:-1])
        last = np.where(known, last, starts[:-1])
        some = last < starts[1:]
        np.add.at(none, last[some], 1)
        np.add.at(none, starts[1:][some], -1)
        valid = np.cumsum(none, dtype=np.int8)[: self.n] == 0
        begins = np.zeros(self.n + 1, dtype=bool)
        begins[starts] = True
        for a in range(0, self.n - self.window + 1, CHUNK):
            b = min(a + CHUNK, self.n - self.window + 1)
            ok = valid[a:b]
            if not ok.any():
                continue
            names = self.names(a, b)
            change = begins[a:b].copy()
            change[0] = True
            change[1:] |= (names[1:] != names[:-1]) | (ok[1:] != ok[:-1])
            first = np.flatnonzero(change)
            count = np.diff(np.append(first, b - a))
            keep = ok[first]
            found.append((first[keep] + a, count[keep], names[first[keep]]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        first, count, name = (np.concatenate(x) for x in zip(*found))
        pieces = -(-count // PIECE)
        if (pieces > 1).any():
            at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first, count, name = np.repeat(first, pieces) + at * PIECE, np.minimum(np.repeat(count, pieces) - at * PIECE, PIECE), np.repeat(name, pieces)
        return first, count, name, np.searchsorted(starts, first, side="right") - 1


def _pack(text_at: int):
    """Rows (block, data): consecutive rows of a task, up to BLOCK_BYTES of text."""

    def run(batches):
        from pyspark import TaskContext

        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block():
            sink = pa.BufferOutputStream()
            whole = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_table(whole)
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "data"])

        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, before + BLOCK_BYTES - size, side="right")))
                held.append(batch.slice(at, stop - at))
                size += int(ends[stop - 1]) - before
                at = stop
                if size >= BLOCK_BYTES or at < batch.num_rows:
                    yield block()
                    held, size, number = [], 0, number + 1
        if held:
            yield block()

    return run


def unpacked(data: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks().to_batches()[0]


def _keyed(name: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket, then some bits of a name."""
    return (name % np.uint64(buckets)) << np.uint64(_BITS) | (name >> np.uint64(64 - _BITS))


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, where groups of equal keys start in it)."""
    order = np.argsort(keys, kind="stable")
    some = keys[order]
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(some)), bool), some[1:] != some[:-1]]))


def _cells(buckets: np.ndarray):
    """(bucket, first, end) of each run of equal buckets."""
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(buckets)), bool), buckets[1:] != buckets[:-1]]))
    return zip(buckets[first].tolist(), first.tolist(), np.append(first[1:], len(buckets)).tolist())


def _squeezed(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(bytes(memoryview(a)) if isinstance(a, np.ndarray) else a for a in arrays))


def _plain(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _binary(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), kinds)], names=names)


_TO_BUCKET, _TO_BLOCK = "bucket int, block long, said binary", "block long, bucket int, said binary"
_KINDS = {"bucket": pa.int32(), "block": pa.int64(), "said": pa.binary()}


def _rows(rows: list[tuple], form: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in form.split(", ")]
    return _binary(rows, names, [_KINDS[n] for n in names])


def _blocks_of(batches, ids_at: int, text_at: int, items_of: Callable, more: int = 0):
    """(block, whole batch, its ids, items, runs, further columns) of each row of the batches."""
    for batch in batches:
        for k in range(batch.num_rows):
            docs = unpacked(batch.column(1)[k])
            ids, known = docs.column(ids_at).fill_null(0).cast(pa.int64()).to_numpy(), docs.column(ids_at).is_valid().to_numpy(zero_copy_only=False)
            items = items_of(docs.column(text_at))
            yield batch.column(0)[k].as_py(), docs, ids, items, items.runs(known), [batch.column(2 + m)[k] for m in range(more)]


def _names_sent(ids_at, text_at, items_of, buckets):
    """To each bucket: a block's names there, ascending, with whether texts of several ids have it and its runs."""

    def run(batches):
        for block, _, ids, _, (_, _, name, doc), _ in _blocks_of(batches, ids_at, text_at, items_of):
            keys = _keyed(name, buckets)
            order, at = _groups(keys)
            if not len(at):
                continue
            own = ids[doc[order]]
            several = np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at)
            told = np.minimum(np.diff(np.append(at, len(order))), 127).astype(np.uint8) | several.astype(np.uint8) << 7
            keys = keys[order][at]
            low, rows = keys & np.uint64((1 << _BITS) - 1), []
            for bucket, a, b in _cells((keys >> np.uint64(_BITS)).astype(np.int64)):
                steps = np.diff(low[a:b], prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _BITS // 8]
                rows.append((bucket, block, _squeezed(np.ascontiguousarray(steps.T), told[a:b])))
            yield _rows(rows, _TO_BUCKET)

    return run


def _by_bucket(batches):
    """(bucket, [(block, said)]) of rows that are sorted by bucket."""
    held, now = [], None
    for batch in batches:
        for bucket, block, said in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append((block, said))
    if held:
        yield now, held


def _names_judged(batches):
    """To each block: bits for its names of a bucket: shared ones, then hot ones."""
    width = _BITS // 8 + 1
    for bucket, held in _by_bucket(batches):
        keys, told = [], []
        for _, said in held:
            planes = np.frombuffer(_plain(said), np.uint8).reshape(width, -1)
            steps = sum(planes[k].astype(np.uint64) << np.uint64(8 * k) for k in range(width - 1))
            keys.append(np.cumsum(steps, dtype=np.uint64))
            told.append(planes[-1])
        sizes = [len(x) for x in keys]
        keys, told = np.concatenate(keys), np.concatenate(told)
        order, at = _groups(keys)
        blocks = np.diff(np.append(at, len(order)))
        shared = (blocks > 1) | (np.maximum.reduceat(told[order], at) > 127)
        hot = shared & (np.add.reduceat((told[order] & 127).astype(np.int64), at) > HOT)
        back = np.empty((2, len(order)), bool)
        back[:, order] = np.repeat([shared, hot], blocks, axis=1)
        rows, a = [], 0
        for (block, _), size in zip(held, sizes):
            part = back[:, a : a + size]
            a += size
            if part[0].any():
                rows.append((block, bucket, _squeezed(np.packbits(part, axis=1))))
        yield _rows(rows, _TO_BLOCK)


class _Asked:
    """A block's segments of shared names, in an order that the same block always has, and where they are."""

    def __init__(self, items: Items, runs, found: pa.Scalar, buckets: int):
        self.items, (self.first, self.count, self.name, self.doc) = items, runs
        keys = _keyed(self.name, buckets)
        order, at = _groups(keys)
        state = np.zeros((2, len(at)), bool)
        said = {x["bucket"]: x["said"] for x in found.as_py() or ()}
        for bucket, a, b in _cells((keys[order][at] >> np.uint64(_BITS)).astype(np.int64)):
            if bucket in said:
                bits = np.frombuffer(_plain(said[bucket]), np.uint8).reshape(2, -1)
                state[:, a:b] = np.unpackbits(bits, axis=1, count=b - a)
        each = np.empty((2, len(order)), bool)
        each[:, order] = np.repeat(state, np.diff(np.append(at, len(order))), axis=1)
        self.runs = np.flatnonzero(each[0])
        hot = each[1][self.runs]
        number: dict[bytes, int] = {}
        part = items.part
        self.segment = np.fromiter((number.setdefault(part(f, c), len(number)) for f, c in zip(self.first[self.runs].tolist(), self.count[self.runs].tolist())), np.int64, len(self.runs))
        self.texts = list(number)
        place = np.zeros(len(number), dtype=np.int64)
        place[self.segment[::-1]] = self.runs[::-1]
        self.hot = np.zeros(len(number), dtype=bool)
        self.hot[self.segment] = hot
        self.place, self.names = place, self.name[place]

    def entries(self, ids: np.ndarray):
        """(texts, names, least ids) to send; those of hot segments are single windows."""
        least = np.full(len(self.texts), np.iinfo(np.int64).max)
        np.minimum.at(least, self.segment, ids[self.doc[self.runs]])
        texts = [t for t, h in zip(self.texts, self.hot.tolist()) if not h]
        names, mins = self.names[~self.hot], least[~self.hot]
        self.single: dict[bytes, int] = {}  # window -> entry
        lows: list[int] = []
        self.windows: list[list[int]] = []  # of each hot segment, its windows' entries
        for s in np.flatnonzero(self.hot).tolist():
            first, low, mine = int(self.first[self.place[s]]), int(least[s]), []
            for k in range(int(self.count[self.place[s]])):
                e = self.single.setdefault(self.items.part(first + k, 1), len(lows))
                if e == len(lows):
                    lows.append(low)
                else:
                    lows[e] = min(lows[e], low)
                mine.append(e)
            self.windows.append(mine)
        single = np.fromiter(map(xxhash.xxh3_64_intdigest, self.single), np.uint64, len(lows))
        return texts + list(self.single), np.concatenate([names, single]), np.concatenate([mins, np.array(lows, dtype=np.int64)])

    def hits(self, ids: np.ndarray, least: np.ndarray, spans: dict[int, list[tuple[int, int]]]):
        """(first window, windows) of each hit; least: smallest document of each entry; spans: hits in it."""
        own = ids[self.doc[self.runs]]
        entry = np.cumsum(~self.hot) - 1
        hot = self.hot[self.segment]
        plain = np.flatnonzero(~hot)
        e = entry[self.segment[plain]]
        whole = own[plain] > least[e]
        runs = self.runs[plain]
        found = [(self.first[runs[whole]], self.count[runs[whole]])]
        told = np.zeros(len(least), dtype=bool)
        told[list(spans)] = True
        rest = np.flatnonzero(~whole & told[e])
        some = [(f + a, n) for f, x in zip(self.first[runs[rest]].tolist(), e[rest].tolist()) for a, n in spans[x]]
        found.append(tuple(np.array(x, dtype=np.int64) for x in zip(*some)) if some else (np.zeros(0, np.int64),) * 2)
        # Of hot segments, window by window; lows: the least document of each window of each such segment.
        sizes = np.fromiter(map(len, self.windows), np.int64, len(self.windows))
        lows = least[int((~self.hot).sum()) + np.fromiter((e for mine in self.windows for e in mine), np.int64, int(sizes.sum()))]
        at, rank, runs = np.cumsum(sizes) - sizes, np.cumsum(self.hot) - 1, np.flatnonzero(hot)
        for some in (runs[k : k + 20_000] for k in range(0, len(runs), 20_000)):
            n = self.count[self.runs[some]]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit = lows[np.repeat(at[rank[self.segment[some]]], n) + k] < np.repeat(own[some], n)
            found.append(((np.repeat(self.first[self.runs[some]], n) + k)[hit], np.ones(int(hit.sum()), np.int64)))
        return tuple(np.concatenate(x) for x in zip(*found))


def _segments_sent(ids_at, text_at, items_of, buckets):
    """To each bucket: a block's segments there: sizes, names and least ids, then texts."""

    def run(batches):
        for block, _, ids, items, runs, (found,) in _blocks_of(batches, ids_at, text_at, items_of, 1):
            texts, names, least = _Asked(items, runs, found, buckets).entries(ids)
            bucket = (names % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows = []
            for number, a, b in _cells(bucket[order]):
                part = order[a:b]
                some = [texts[k] for k in part.tolist()]
                head = np.array([len(some)], "<u4"), np.fromiter(map(len, some), "<u4", len(some)), names[part].astype("<u8"), least[part].astype("<i8")
                rows.append((number, block, _squeezed(*head, *some)))
            yield _rows(rows, _TO_BUCKET)

    return run


def _segments_judged(judge):
    """To each block: least documents of its segments, then (segment, first window, windows) of the hits of those documents."""

    def run(batches):
        for bucket, held in _by_bucket(batches):
            number: dict[bytes, int] = {}
            asked, names, ids = [], [], []
            for _, said in held:
                data = _plain(said)
                n = int.from_bytes(data[:4], "little")
                sizes = np.frombuffer(data, "<u4", n, 4)
                names.append(np.frombuffer(data, "<u8", n, 4 + 4 * n))
                ids.append(np.frombuffer(data, "<i8", n, 4 + 12 * n))
                at, mine = 4 + 20 * n, []
                for size in sizes.tolist():
                    mine.append(number.setdefault(data[at : at + size], len(number)))
                    at += size
                asked.append(np.array(mine, dtype=np.int64))
            least, name = np.full(len(number), np.iinfo(np.int64).max), np.zeros(len(number), np.uint64)
            for mine, i, x in zip(asked, ids, names):
                np.minimum.at(least, mine, i)
                name[mine] = x
            spans = judge(list(number), name, least)
            del number
            rows = []
            for (block, _), mine, i in zip(held, asked, ids):
                own = np.flatnonzero(i == least[mine]).tolist() if spans else ()
                some = [(k, a, n) for k, s in zip(own, mine[own].tolist()) for a, n in spans.get(s, ())] if spans else []
                rows.append((block, bucket, _squeezed(np.array([len(mine)], "<u4"), least[mine].astype("<i8"), np.array(some, dtype="<u4"))))
            yield _rows(rows, _TO_BLOCK)

    return run


def _finished(ids_at, text_at, items_of, buckets, finish, kept, schema):
    def run(batches):
        for _, docs, ids, items, runs, (found, replies) in _blocks_of(batches, ids_at, text_at, items_of, 2):
            covered = np.zeros(items.n, dtype=bool)
            if found.is_valid:
                asked = _Asked(items, runs, found, buckets)
                _, names, _ = asked.entries(ids)
                least, spans = np.full(len(names), np.iinfo(np.int64).max), {}
                bucket = (names % np.uint64(buckets)).astype(np.int64)
                order, said = np.argsort(bucket, kind="stable"), {x["bucket"]: x["said"] for x in replies.as_py() or ()}
                for number, a, b in _cells(bucket[order]):
                    data = _plain(said[number])
                    least[order[a:b]] = np.frombuffer(data, "<i8", b - a, 4)
                    for k, at, n in np.frombuffer(data, "<u4", -1, 4 + 8 * (b - a)).reshape(-1, 3).tolist():
                        spans.setdefault(int(order[a + k]), []).append((at, n))
                first, count = asked.hits(ids, least, spans)
                edges = np.zeros(items.n + 1, dtype=np.int32)
                np.add.at(edges, first, 1)
                np.add.at(edges, first + count + items.window - 1, -1)
                covered = np.cumsum(edges)[: items.n] > 0
            made = finish(items, covered)
            whole = pa.RecordBatch.from_arrays([*[docs.column(k) for k in kept], *made], names=[f.name for f in schema])
            for at in range(0, whole.num_rows, 2000):
                yield whole.slice(at, 2000)

    return run


def covered_counts(items: Items, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items, covered items, maximal covered runs) of each text."""
    kind = np.int32 if len(covered) < 1 << 31 else np.int64
    total = np.concatenate([np.zeros(1, kind), np.cumsum(covered, dtype=kind)])
    begins = covered.copy()
    begins[1:] &= ~covered[:-1]
    edge = items.starts[:-1][np.diff(items.starts) > 0]
    begins[edge] = covered[edge]
    runs = np.concatenate([np.zeros(1, kind), np.cumsum(begins, dtype=kind)])
    return np.diff(items.starts), *(np.diff(x[items.starts]).astype(np.int64) for x in (total, runs))


def without_repeats(docs: DataFrame, prepared: Callable, judge: Callable, finish: Callable, added: str) -> DataFrame:
    """docs with the columns of the DDL schema `added`, which replace any of those names.

    prepared(blocks, place of the text column) gives what makes Items of an Arrow array of texts. judge(texts, names, least documents) gives {segment: [(first window, windows)]}, the windows
    of a segment that also lie in one of the same name with a smaller least document. finish(items, covered) makes the arrays of `added`.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = docs.columns
    ids_at, text_at = names.index("doc_id"), names.index("text")
    new = T.StructType.fromDDL(added)
    base = without(docs, [f.name for f in new]).columns
    kept = [k for k, c in enumerate(names) if c in base]
    schema = T.StructType([*[docs.schema[k] for k in kept], *new])
    blocks = cut(docs.mapInArrow(_pack(text_at), "block long, data binary"))
    given = ids_at, text_at, prepared(blocks, text_at), buckets

    def answered(said: DataFrame, judged: Callable, column: str) -> DataFrame:
        dealt = said.repartition(buckets // 4, "bucket").sortWithinPartitions("bucket")
        back = dealt.mapInArrow(judged, _TO_BLOCK)
        return back.groupBy("block").agg(F.collect_list(F.struct("bucket", "said")).alias(column)).hint("shuffle_hash")

    found = answered(blocks.mapInArrow(_names_sent(*given), _TO_BUCKET), _names_judged, "found")
    asking = blocks.join(found, "block", "left")
    replies = answered(asking.where("found IS NOT NULL").mapInArrow(_segments_sent(*given), _TO_BUCKET), _segments_judged(judge), "replies")
    return asking.join(replies, "block", "left").mapInArrow(_finished(*given, finish, kept, schema), schema)
