"""Near duplicates by SimHash and multi-index hashing, verified by the Jaccard similarity of five-word shingles, at 0.8 or more.

A text is lower-cased (A-Z), cut into words, and its shingles of 5 words are hashed by XXH64; a text of
fewer words is one shingle. Texts of the same words collapse first, so exact copies never meet as pairs.
The fingerprint is a SimHash of the set of shingles, as wide as a similarity of 0.8 needs: a bit is set if
it is set in more than half of the shingles' hashes, and two sets at 0.8 differ in each bit with a
probability of 0.15 (DIFFER at the most, for sets of 4 and 5). Its first SIGN bits are compared; the
others are the segments of the multi-index, so many and so wide as plan() says for the number of texts.
Texts that agree in a segment share a bucket; there, all that differ in at most APART of the SIGN bits (TINY
for sets of 5 or less), and whose sets' sizes allow for 0.8, are grouped, directly or through others. A pair at 0.8 is in no group with a probability of about MISS for
sets of 4 and 5, and of 1e-8 or less for others. Segments are read some at a time, to bound what is moved
at once. Groups that have texts in common make a cluster, whose sets of shingle hashes meet in one task: no
link is made on fingerprints alone, each is verified by the exact Jaccard similarity of the two whole sets.
In a cluster of more than HELD texts the sets meet group by group instead: those of the first segments, then
of all others that aren't within one component of the links found by then. The sets are searched
breadth-first from one unvisited member at a time, so that they give a spanning forest of the links rather
than all pairs. Sets of less than 4 shingles are similar at 0.8 to none but their copies. Components come from
simhash.components.

Edge cases: null or empty texts, or texts without words, are copies of each other and near nothing else;
an empty table gives no rows; repeated rows are repeated documents; a null doc_id is never a component's
id unless the component has no other; very long texts are hashed whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import annotate, cut

SHINGLE, SEED = 5, 42
SIGN, APART, TINY = 384, 100, 116  # bits that are compared, how many of them may differ, and that for sets of 5 or less
DIFFER, MISS = 0.1875, 1e-6
LEAST = 4  # shingles of a set that can be near another
FIRST, ROUND = 8, 32  # segments that are read at once, at first and later
HELD, SENT = 4096, 1 << 20  # texts of a cluster that one task compares whole; texts that are looked up by a broadcast
PART = 255  # shingles whose bits are added up at once, in bytes
WHOLE = 512  # texts of a bucket that are compared all with all at once
BATCH, SLICE, PACK = 4096, 1 << 13, 32  # texts that are spread at once; lookups of a slice, and of a packed row at the least, on average
_RANDOM = np.random.default_rng(SEED)
_PLUS = _RANDOM.integers(0, 1 << 63, 2048, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(simhash._LOWER).split()


def key(text: str | None) -> int:
    """The hash of the text's words as a signed 64-bit integer; copies share it."""
    return xxhash.xxh64_intdigest(b" ".join(_words(text)), SEED + 1) - (1 << 63)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted."""
    words = _words(text)
    if not words:
        return np.array([], dtype=np.uint64)
    joined, n = b" ".join(words), len(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends)]
    one = xxhash.xxh64_intdigest
    return np.unique(np.array([one(joined[a:b], SEED) for a, b in zip(starts, ends[min(n, SHINGLE) - 1 :])], dtype=np.uint64))


def plan(n: int) -> tuple[int, int]:
    """(bits of a segment, segments) for n texts: some 100 unlike texts a bucket, and a pair at 0.8 misses all segments with MISS."""
    bits = min(26, max(8, math.ceil(math.log2(max(n, 1))) - 7))
    return bits, math.ceil(math.log(MISS) / math.log1p(-((1 - DIFFER) ** bits)))


def fingerprint(hashes: np.ndarray, bits: int) -> bytes | None:
    """The SimHash of the set, `bits` wide; none for a set that is near no other."""
    if len(hashes) < LEAST:
        return None
    words = -(-bits // 64)
    count = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(hashes), PART):
        x = hashes[at : at + PART, None] + _PLUS[:words]  # SplitMix64, one stream a word
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        count += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(count[:bits] * 2 > len(hashes)).tobytes()


def near(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b with `both` members in common have a Jaccard similarity of 0.8 or more."""
    return 5 * both >= 4 * (a + b - both)


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (positions) of a spanning forest of non-empty sets under near()."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    mine = np.zeros(len(kinds), dtype=bool)
    rest, owner = np.arange(len(sets)), np.repeat(np.arange(len(sets)), sizes)
    out = []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        keep = np.isin(owner, rest)
        flat_rest, owner_rest = flat[keep], owner[keep]
        while queue and len(rest):
            node = queue.pop()
            own = flat[bounds[node] : bounds[node + 1]]
            mine[own] = True
            both = np.bincount(owner_rest[mine[flat_rest]], minlength=len(sets))[rest]
            mine[own] = False
            hit = near(both, sizes[node], sizes[rest])
            if hit.any():
                found = rest[hit].tolist()
                rest = rest[~hit]
                keep = np.isin(owner_rest, rest)
                flat_rest, owner_rest = flat_rest[keep], owner_rest[keep]
                out += [(node, x) for x in found]
                queue += found
    return out


def _verify(batches):
    """Verified links u > v of the buckets of a partition sorted by bucket; the last bucket of a batch waits for the next."""
    held_key, held = None, []

    def done():
        sets = [np.frombuffer(s, dtype=np.uint64) for _, s in held]
        pairs = [(held[a][0], held[b][0]) for a, b in forest(sets)]
        return pa.RecordBatch.from_arrays([pa.array([f(p) for p in pairs], pa.int64()) for f in (max, min)], names=["u", "v"])

    for batch in batches:
        for bucket, member, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if bucket != held_key and held:
                yield done()
                held = []
            held_key = bucket
            held.append((member, data))
    if held:
        yield done()


def _row() -> np.dtype:
    return np.dtype([("bucket", "<u4"), ("key", "<i8"), ("size", "<u4"), ("sign", "<u8", (SIGN // 64,))])


def _spread(bits: int, first: int, last: int, slices: int):
    """Rows (slice, packed rows of _row) of the buckets of segments first to last; a slice holds whole buckets."""

    def run(batches):
        powers = 1 << np.arange(bits, dtype=np.uint32)
        number = np.arange(last - first, dtype=np.uint32) << np.uint32(bits)
        for batch in (whole.slice(at, BATCH) for whole in batches for at in range(0, whole.num_rows, BATCH)):
            prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            cells = np.unpackbits(prints, axis=1)[:, SIGN + first * bits : SIGN + last * bits].reshape(batch.num_rows, last - first, bits)
            rows = np.empty((batch.num_rows, last - first), dtype=_row())
            rows["bucket"] = cells @ powers + number
            rows["key"] = batch.column(0).to_numpy()[:, None]
            rows["size"] = batch.column(2).to_numpy()[:, None]
            rows["sign"] = np.ascontiguousarray(prints[:, : SIGN // 8]).view("<u8")[:, None, :]
            rows = rows.ravel()
            place = (rows["bucket"] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(slices)
            order = np.argsort(place, kind="stable")
            rows, place = rows[order], place[order]
            starts = np.nonzero(np.concatenate([[True], place[1:] != place[:-1]]))[0]
            blobs = [rows[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(rows)])]
            yield pa.RecordBatch.from_arrays([pa.array(place[starts].astype(np.int32)), pa.array(blobs, pa.binary())], names=["slice", "rows"])

    return run


def _apart(sign: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Differing bits of signs, whose words are the first axis."""
    parts = [sum(np.bitwise_count(x ^ y) for x, y in zip(sign[at : at + 3], signs[at : at + 3])) for at in range(0, len(sign), 3)]  # 192 bits fit a byte
    return sum(x.astype(np.uint16) for x in parts)


def _alike(sign: np.ndarray, signs: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
    """Whether sets of these signs and sizes may be similar at 0.8 to the set of this sign and size."""
    low, high = np.minimum(size, sizes), np.maximum(size, sizes)
    return (_apart(sign, signs) <= np.where(low > 5, APART, TINY)) & (5 * low >= 4 * high)


def groups(signs: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Positions of the sets that are alike by signs (a row each) and sizes, directly or through others."""
    rest, out, words = np.arange(len(signs)), [], np.ascontiguousarray(signs.T)
    if len(signs) <= WHOLE:
        rest = np.nonzero((_apart(words[:, :, None], words[:, None, :]) <= TINY).sum(axis=1) > 1)[0]
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        group = queue[:]
        while queue and len(rest):
            node = queue.pop()
            hit = _alike(words[:, node, None], words[:, rest], sizes[node], sizes[rest])
            found, rest = rest[hit].tolist(), rest[~hit]
            group += found
            queue += found
        if len(group) > 1:
            out.append(np.array(group))
    return out


def _grouped(batches):
    """Rows (bucket, key, low) of the groups of each bucket, low the least key; a group is named by its members, so that equal ones are one."""
    rows = np.frombuffer(b"".join(x for batch in batches for x in batch.column(1).to_pylist()), _row())
    rows = rows[np.argsort(rows["bucket"], kind="stable")]
    keys, sizes, signs = np.ascontiguousarray(rows["key"]), rows["size"].astype(np.int64), np.ascontiguousarray(rows["sign"])
    starts = np.nonzero(np.diff(rows["bucket"].astype(np.int64), prepend=-1))[0]
    named = {}
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
        for group in groups(signs[a:b], sizes[a:b]) if b - a > 1 else ():
            found = np.sort(keys[a:b][group])
            named[xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)] = found
    if named:
        sizes = [len(x) for x in named.values()]
        lows = [x[0] for x in named.values()]
        columns = [np.repeat(np.fromiter(named, np.int64), sizes), np.concatenate(list(named.values())), np.repeat(lows, sizes)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "key", "low"])


def members(prints: DataFrame, bits: int, first: int, last: int) -> DataFrame:
    """bucket, key, low: groups of two or more alike sets of prints (key, bits, size) that share one of the segments first to last.

    Tasks and slices, whose product is the number of packed rows, go by the number of lookups, not by that of partitions.
    """
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = prints.where("bits is not null").select("key", "bits", "size")
    n = wide.count()
    slices = max(1, min(math.ceil(n * (last - first) / SLICE), BATCH * (last - first) // PACK))
    rows = wide.coalesce(max(1, math.ceil(n / BATCH))).mapInArrow(_spread(bits, first, last, slices), "slice int, rows binary")
    return rows.repartition(parts, "slice").mapInArrow(_grouped, "bucket long, key long, low long").distinct()


def _sets(batches):
    """key, hashes of the rows (key, text) whose text has that key."""
    for batch in batches:
        found = [(k, shingles(t).tobytes()) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if key(t) == k]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], names=["key", "hashes"])


def _verified(members: DataFrame, sets: DataFrame) -> DataFrame:
    """u > v: verified links of the groups members (bucket, key)."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filled = members.join(sets, "key").select("bucket", "key", "hashes")
    dealt = filled.repartition(parts, F.xxhash64("bucket"))  # by the plain column, Spark may drop it after a broadcast join and then read mappers' rows, which splits buckets
    return dealt.sortWithinPartitions("bucket").mapInArrow(_verify, "u long, v long").distinct()


def _edges(root: DataFrame) -> DataFrame:
    return root.where("node <> root").select(F.greatest("node", "root").alias("u"), F.least("node", "root").alias("v"))


def components(docs: DataFrame, prints: DataFrame, bits: int, segments: int) -> DataFrame:
    """node, root: the components of the keys of prints (key, doc, bits, size) that have a verified link."""
    spark = docs.sparkSession
    found = []
    for first, last in zip([0, *range(FIRST, segments, ROUND)], [FIRST, *range(FIRST + ROUND, segments + ROUND, ROUND)]):
        found.append(cut(members(prints, bits, first, min(last, segments))))
        spark.sparkContext._jvm.System.gc()  # Spark deletes the shuffles that nothing refers to
    every = found[0]
    for x in found[1:]:
        every = every.unionAll(x)
    cluster = cut(simhash.components(every.where("key > low").select(F.col("key").alias("u"), F.col("low").alias("v")).distinct()))
    wanted = prints.join(cluster, prints.key == cluster.node).select("key", F.col("doc").alias("__doc"))
    if cluster.count() <= SENT:
        wanted = F.broadcast(wanted)
    sets = cut(docs.join(wanted, docs.doc_id.eqNullSafe(F.col("__doc"))).select("key", "text").mapInArrow(_sets, "key long, hashes binary").dropDuplicates(["key"]))
    size = cluster.groupBy("root").agg(F.count("*").alias("n"))
    large = cut(cluster.join(size.where(F.col("n") > HELD).select("root"), "root").select(F.col("node").alias("key")))
    small = cluster.join(size.where(F.col("n") <= HELD).select("root"), "root").select(F.col("root").alias("bucket"), F.col("node").alias("key"))
    if not large.count():
        return simhash.components(_verified(small, sets))
    begun = found[0].join(large, "key").select("bucket", "key")
    root = cut(simhash.components(_verified(small.unionAll(begun), sets)))
    later = cut(every.select("bucket", "key").distinct().join(large, "key"))
    named = later.join(root, later.key == root.node, "left").groupBy("bucket").agg(F.min(F.coalesce("root", "key")).alias("low"), F.max(F.coalesce("root", "key")).alias("high"))
    across = later.join(named.where("low < high").select("bucket"), "bucket").select("bucket", "key")
    return simhash.components(_edges(root).unionAll(_verified(across, sets)).distinct())


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, key, component_id: the smallest doc_id among all documents linked directly or through others."""
    docs = docs.select("doc_id", "text")
    bits, segments = plan(docs.count())

    width = SIGN + bits * segments

    def measure(text):
        sets = [shingles(t) for t in text]
        return [[key(t) for t in text], [fingerprint(x, width) for x in sets], [len(x) for x in sets]]

    rows = cut(annotate(docs, ["text"], measure, "key long, bits binary, size int").select("doc_id", "key", "bits", "size"))
    prints = cut(rows.groupBy("key").agg(F.min("doc_id").alias("doc"), F.first("bits").alias("bits"), F.first("size").alias("size")))
    root = components(docs, prints, bits, segments)
    linked = prints.select("key", "doc").join(root, prints.key == root.node)
    low = linked.groupBy("root").agg(F.min("doc").alias("low"))
    moved = linked.join(low, "root").select("key", "low")
    name = prints.select("key", "doc").join(moved, "key", "left").select("key", F.coalesce("low", "doc").alias("component_id"))
    return rows.select("doc_id", "key").join(name, "key").select("doc_id", "key", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """docs without those that are linked to a document of a smaller doc_id; their columns unchanged."""
    return simhash.near_dedup(docs, near_groups)
