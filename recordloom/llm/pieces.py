"""SentencePiece encoding and decoding over a relational lattice.

Text is escaped as the model does (a leading space mark, each space a mark), and cut into units where
no piece can cross: before a run of marks and around line ends. The lattice is built once for each
distinct unit: its substrings of up to the longest piece's length are exploded and equi-joined to the
piece table (broadcast: tens of thousands of rows, MAX_PIECES at most), and matches are edges. Units are
distinct by a hash partitioning on the unit, which explode and broadcast join keep, so grouping a unit's
edges needs no further shuffle. A Spark `aggregate` folds Viterbi over end positions, a second one walks
back. Characters without a piece are edges of their own that become byte pieces. Ties go to the later
start, then the larger id. Edges of a unit are collected in a hash table of up to GROUPS units, rather than sorted.

Units are cut, and told apart by two 64-bit hashes, for many texts at once. Documents are then put together from the units' ids. If the packed units (a 64-bit hash, an offset, ids)
take at most MAX_PACKED bytes and no two hashes are equal, they are broadcast; else a relational join
on the unit and an ordered aggregation by document do the same.

Scores that add up are the rule of unigram models. A file of BPE type holds merge ranks as scores, and
the highest sum isn't what such a model means (on test texts it agrees for 40 % of distinct units). For
those files (whole-number scores, none positive) the fold over the same edges joins neighbours by rank:
`aggregate` holds a unit's borders, as bits, and drops, again and again, the border inside the best edge over two
neighbours, the leftmost of equals, until none is left. Units of more than LONG characters, for which
that is quadratic, are joined from a heap in Python with the same result.

Edge cases: null and empty texts have no ids; an empty table gives no rows; repeated rows and null
doc_ids are kept as they are; a text that holds the mark itself decodes to a space there; very
long texts and very long units are encoded whole; columns ids and n_pieces of the input are replaced.
"""

from __future__ import annotations

import contextlib
import heapq
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotate, binary, cut, parts_of, table, texts
from .symbols import spelled

MARK = "▁"
MAX_PIECES = 1 << 20
MAX_PACKED = 160 << 20
SEEN = 1 << 21  # slots of a task's table of units that it has sent
GROUPS = 1 << 16
PART = 1 << 18  # bytes of text that are cut at once; a longer text is a part of its own
LONG = 61  # characters of a unit that the fold by rank takes: its borders are the bits of a long
_UNIT = re.compile(f"\\n|{MARK}*[^{MARK}\\n]+|{MARK}+")


class Model:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        if n > MAX_PIECES:
            raise ValueError(f"{n} pieces: more than {MAX_PIECES}")
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.pieces = [(self.names[i], i, float(sp.get_score(i))) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.longest = max(len(p) for p, _, _ in self.pieces)
        self.unknown = min(s for _, _, s in self.pieces) - 10.0
        self.unk_id = sp.unk_id()
        self.ranked = all(s <= 0 and s == int(s) for _, _, s in self.pieces)
        rank = {s: k for k, s in enumerate(sorted({s for _, _, s in self.pieces}, reverse=True))}
        self.rows = [(p, i, s, rank[s]) for p, i, s in self.pieces]
        bad = [p for p, _, _ in self.pieces if "\n" in p or MARK in p.lstrip(MARK)]
        if bad:
            raise ValueError(f"pieces that cross units: {bad[:3]}")


def escape(text: str | None) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def units_of(text: str | None) -> list[str]:
    return _UNIT.findall(escape(text))


def cut_units(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the escaped texts, a space in place of each mark; where units begin, then the end; number of units before each text, then of all)."""
    text = pc.replace_substring(text.fill_null(""), MARK, " ")
    data, ends = binary(pc.if_else(pc.equal(pc.binary_length(text), 0), "", pc.binary_join_element_wise(" ", text, "")))
    line, space = data == 10, data == 32
    begins = line.copy()
    begins[1:] |= line[:-1]
    space[1:] &= data[:-1] != 32
    begins |= space
    begins[ends[:-1][np.diff(ends) > 0]] = True
    at = np.flatnonzero(begins)
    return data, np.append(at, len(data)), np.searchsorted(at, ends)


def _distinct(batches):
    """Units of the documents; a task leaves out those that it still knows to have sent."""
    sent = np.zeros((2, SEEN), dtype=np.uint64)
    for batch in batches:
        for text in parts_of(batch.column(0), PART):
            data, begin, _ = cut_units(text)
            if len(begin) < 2:
                continue
            one, two = spelled(data, begin), spelled(~data, begin)
            _, first, back = np.unique(one, return_index=True, return_inverse=True)
            first = np.concatenate([first, np.flatnonzero(two != two[first][back])])
            slot = (one[first] >> np.uint64(40)).astype(np.int64) % SEEN
            new = first[(sent[0, slot] != one[first]) | (sent[1, slot] != two[first])]
            sent[0, slot], sent[1, slot] = one[first], two[first]
            raw = data.tobytes()
            units = pa.array([raw[a:b] for a, b in zip(begin[new].tolist(), begin[new + 1].tolist())], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pc.replace_substring(units, " ", MARK)], names=["unit"])


def _best(n, edges):
    """best[i]: (score, start, ids) of the best path to i; a fold over end positions."""
    entry = "struct<score:double,start:int,id:int,ids:array<int>>"
    zero = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start"), F.lit(0).alias("id"), F.array().cast("array<int>").alias("ids"))).cast(f"array<{entry}>")

    def step(best, i):
        ending = F.filter(edges, lambda e: e["end"] == i)
        paths = F.transform(ending, lambda e: F.struct((F.get(best, e["start"])["score"] + e["score"]).alias("score"), e["start"].alias("start"), e["id"].alias("id"), e["ids"].alias("ids")))
        return F.concat(best, F.array(F.array_max(paths))).cast(f"array<{entry}>")

    return F.aggregate(F.sequence(F.lit(1), n), zero, step)


def _walk(n, best):
    """ids of the best path, from its end."""
    state = F.struct(n.alias("at"), F.array().cast("array<int>").alias("ids"))

    def step(s, i):
        edge = F.get(best, i)
        return F.when(s["at"] == i, F.struct(edge["start"].alias("at"), F.concat(edge["ids"], s["ids"]).alias("ids"))).otherwise(s)

    return F.aggregate(F.sequence(n, F.lit(1), F.lit(-1)), state, step, lambda s: s["ids"])


def _merged(unit, edges):
    """ids after joining neighbours by rank; a fold over at most n - 1 joins.

    An edge is (key, ends, span): key is rank, start, length and id, so that the least is the best and leftmost (or minus the place of a
    character without a piece), ends and span the bits of its two borders and of all from one to the other. The state holds the borders
    left and the edges that may still join: an edge joins two neighbours if it has three of them, its ends
    among these.
    """
    n = F.char_length(unit)
    kept = lambda e, borders: borders.bitwiseAND(e["ends"]) == e["ends"]
    inside = lambda e, borders: F.bit_count(borders.bitwiseAND(e["span"]))

    def step(s, _):
        choice = F.array_min(F.filter(s["edges"], lambda e: inside(e, s["borders"]) == 3))
        joined = lambda c: F.transform(F.array(s["borders"].bitwiseAND(F.bitwise_not(c["span"])).bitwiseOR(c["ends"])), lambda b: F.struct(b.alias("borders"), F.filter(s["edges"], lambda e: kept(e, b) & (inside(e, b) > 2)).alias("edges")))
        after = lambda c: F.when(c.isNull(), F.struct(s["borders"].alias("borders"), F.slice(s["edges"], 1, 0).alias("edges"))).otherwise(F.get(joined(c), F.lit(0)))
        return F.when(F.size(s["edges"]) == 0, s).otherwise(F.get(F.transform(F.array(choice), after), F.lit(0)))

    many = F.filter(edges, lambda e: F.bit_count(e["span"]) > 2)
    first = F.struct((F.expr(f"shiftleft(2L, char_length({unit}))") - F.lit(1)).cast("long").alias("borders"), many.alias("edges"))
    borders = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), first, step, lambda s: s["borders"])
    left = F.get(F.transform(F.array(borders), lambda b: F.filter(edges, lambda e: kept(e, b) & (inside(e, b) == 2))), F.lit(0))
    return F.transform(F.sort_array(F.transform(left, lambda e: F.struct(e["ends"], e["key"]))), lambda e: e["key"])


def merge(unit: str, pieces: dict[str, tuple[int, float]], spelled: dict[int, int], unknown: int) -> list[int]:
    """ids of a unit by rank, from a heap."""
    n = len(unit)
    end, prev, alive = [i + 1 for i in range(n)], [i - 1 for i in range(n)], [True] * n
    heap: list[tuple[float, int, int]] = []

    def offer(i, j):
        if i >= 0 and j < n and (found := pieces.get(unit[i : end[j]])):
            heapq.heappush(heap, (-found[1], i, end[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j < n and alive[j] and end[j] == stop:
            alive[j], end[i] = False, stop
            if stop < n:
                prev[stop] = i
            offer(prev[i], i)
            offer(i, stop)
    out: list[int] = []
    i = 0
    while i < n:
        part = unit[i : end[i]]
        out += [pieces[part][0]] if part in pieces else [spelled.get(b, unknown) for b in part.encode("utf-8", "surrogatepass")]
        i = end[i]
    return out


def _merge_long(model: Model):
    pieces, spelled, unknown = {p: (i, s) for p, i, s in model.pieces}, model.bytes, model.unk_id

    def run(batches):
        for batch in batches:
            units = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([merge(u, pieces, spelled, unknown) for u in units], pa.list_(pa.int32()))], names=["unit", "ids"])

    return run


@contextlib.contextmanager
def _grouping(spark: SparkSession):
    """Edges of GROUPS units are held at once; Spark's default of 128 sorts all edges."""
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, GROUPS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lattice(units: DataFrame, model: Model) -> DataFrame:
    """unit, ids of each row of units (unit: distinct, not empty)."""
    spark = units.sparkSession
    pieces = spark.createDataFrame(model.rows, "name string, id int, score double, rank int")
    # A long is looked up several times faster than a string; names are compared after it.
    hashed = len({xxhash.xxh64_intdigest(p.encode(), 42) for p, *_ in model.rows}) == len(model.rows)
    key_of = F.xxhash64 if hashed else F.col
    n = F.char_length("unit")
    short = units.where(n <= LONG) if model.ranked else units
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts = short.repartition(parts, "unit").select("unit", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    spans = starts.select("unit", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("start") + model.longest, n))).alias("end"))
    spans = spans.withColumn("piece", F.substring("unit", F.col("start") + 1, F.col("end") - F.col("start")))
    met = spans.withColumn("key", key_of("piece")).join(F.broadcast(pieces.withColumn("key", key_of("name"))), "key", "left")
    same = F.col("name") == F.col("piece")
    found = met.where(same | (F.col("end") == F.col("start") + 1)).withColumns({c: F.when(same, F.col(c)) for c in ("id", "score", "rank")})
    table_of_bytes = F.array(*[F.lit(model.bytes.get(b, model.unk_id)) for b in range(256)])

    def spelled(piece):
        code = F.hex(F.encode(piece, "UTF-8"))
        return F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda k: F.get(table_of_bytes, F.conv(F.substring(code, k, F.lit(2)), 16, 10).cast("int")))

    if model.ranked:
        key = F.coalesce(F.expr("shiftleft(CAST(rank AS long), 32) | shiftleft(CAST(start AS long), 26) | shiftleft(end - start, 20) | id"), -F.col("start").cast("long") - 1)
        found = found.groupBy("unit").agg(F.collect_list(key).alias("found"))
        start, length = "IF(k < 0, -k - 1, shiftright(k, 26) & 63)", "IF(k < 0, 1, shiftright(k, 20) & 63)"
        edge = f"named_struct('key', k, 'ends', shiftleft(1L, CAST({start} AS int)) | shiftleft(1L, CAST({start} + {length} AS int)), 'span', shiftleft(shiftleft(2L, CAST({length} AS int)) - 1, CAST({start} AS int)))"
        edges = found.select("unit", F.expr(f"transform(found, k -> {edge})").alias("edges"))
        keys = edges.select("unit", _merged("unit", F.col("edges")).alias("keys"))
        plain = F.transform("keys", lambda k: k.bitwiseAND(F.lit(MAX_PIECES - 1)).cast("int"))
        mixed = F.flatten(F.transform("keys", lambda k: F.when(k >= 0, F.array(k.bitwiseAND(F.lit(MAX_PIECES - 1)).cast("int"))).otherwise(spelled(F.substring(F.col("unit"), (-k).cast("int"), F.lit(1))))))
        ids = F.when(F.array_min("keys") >= 0, plain).otherwise(mixed)
        return keys.select("unit", ids.alias("ids")).unionAll(units.where(n > LONG).mapInArrow(_merge_long(model), "unit string, ids array<int>"))
    ids = F.when(F.col("id").isNotNull(), F.array("id")).otherwise(spelled(F.col("piece")))
    edge = F.struct("end", "start", F.coalesce("score", F.lit(model.unknown)).alias("score"), F.coalesce("id", F.lit(-1)).alias("id"), ids.alias("ids"))
    edges = found.groupBy("unit").agg(F.collect_list(edge).alias("edges"))
    best = edges.select("unit", _best(n, F.col("edges")).alias("best"))
    return best.select("unit", _walk(n, F.col("best")).alias("ids"))


def _hashes(units: pa.Array) -> np.ndarray:
    data, ends = binary(pc.replace_substring(units, MARK, " "))
    return spelled(data, ends)


def _pack(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            part = batch.slice(at, 20_000)
            ids = part.column(1)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (_hashes(part.column(0)), np.diff(ids.offsets.to_numpy()).astype("<u2"), ids.flatten().to_numpy().astype("<i4"))], names=["hashes", "sizes", "ids"])


def _short(ids: np.ndarray) -> np.ndarray:
    return ids.astype(np.uint16) if ids.max(initial=0) < 1 << 16 else ids


def _packed(known: DataFrame):
    """(sorted hashes, offsets, sizes, ids) of all units as arrays; None if they're over MAX_PACKED bytes or two hashes are equal."""
    size = known.agg(F.count("*"), F.sum(F.size("ids")), F.max(F.size("ids"))).first()
    if not size[0] or 12 * size[0] + 4 * size[1] > MAX_PACKED or size[2] >= 1 << 16:
        return None
    parts = [(np.frombuffer(r.hashes, "<u8"), np.frombuffer(r.sizes, "<u2"), _short(np.frombuffer(r.ids, "<i4"))) for r in known.mapInArrow(_pack, "hashes binary, sizes binary, ids binary").toLocalIterator()]
    hashes, sizes, ids = (np.concatenate(x) for x in zip(*parts))
    del parts
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[:-1].astype(np.uint32)
    order = np.argsort(hashes)
    hashes = hashes[order]
    if (hashes[1:] == hashes[:-1]).any():
        return None
    return hashes, offsets[order], sizes[order], ids


class _Table:
    """Places of hashes, all known, among sorted ones: from a directory of their first bits, a step at a time."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, bits = hashes, max(1, int(len(hashes)).bit_length() - 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.uint32)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        place = self.first[(wanted >> self.shift).astype(np.int64)].astype(np.int64)
        rest = np.flatnonzero(self.hashes[place] != wanted)
        while len(rest):
            place[rest] += 1
            rest = rest[self.hashes[place[rest]] != wanted[rest]]
        return place


class _Spelling:
    """Bytes of all pieces in one array, from which many texts are gathered at once."""

    def __init__(self, names: list[bytes]):
        self.data = np.frombuffer(b"".join(names), np.uint8)
        self.sizes = np.array([len(x) for x in names], dtype=np.int32)
        self.starts = np.cumsum(self.sizes, dtype=np.int32) - self.sizes

    def texts(self, ids: np.ndarray, counts: list[int]) -> list[str]:
        """Texts of consecutive runs of ids, without the leading space."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes, dtype=np.int64)
        places = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        places += np.arange(len(places))
        data = self.data[places].tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])].tolist()
        return [data[a:b].decode("utf-8", "replace")[1:] for a, b in zip(cuts, cuts[1:])]


class _Shared:
    """A broadcast with a number of its own, by which workers know it."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def _assemble(docs: DataFrame, packed, names, decoded: str) -> DataFrame:
    shared = _Shared(docs.sparkSession.sparkContext.broadcast((packed, names)))

    def run(text):
        (hashes, offsets, sizes, ids), spelling = shared.value
        find = _table(shared.id, hashes)
        out, counts, back = [], [], []
        for part in parts_of(text, PART):
            data, begin, before = cut_units(part)
            places = find(spelled(data, begin)) if len(begin) > 1 else np.zeros(0, np.int64)
            n = sizes[places].astype(np.int64)
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            gathered = ids[np.repeat(offsets[places] - (ends - n), n) + np.arange(total)].astype(np.int32)
            mine = np.diff(np.concatenate([[0], ends])[before])
            out.append(gathered)
            counts.append(mine)
            at = 0
            for k in range(0, len(mine) if spelling else 0, 10):
                some = mine[k : k + 10]
                back += spelling.texts(gathered[at : at + some.sum()], some.tolist())
                at += some.sum()
        flat, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out, counts))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat.astype(np.int32)))
        return [lists, pa.array(counts.astype(np.int64)), *([pa.array(back, pa.string())] if spelling else [])]

    return annotate(docs, ["text"], run, "ids array<int>, n_pieces long" + (f", {decoded} string" if decoded else ""), raw=True)


_tables: dict[str, _Table] = {}


def _table(number: str, hashes: np.ndarray) -> _Table:
    """The table of a broadcast; a Python worker keeps the last one for all its tasks."""
    if number not in _tables:
        _tables.clear()
        _tables[number] = _Table(hashes)
    return _tables[number]


def _joined(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The same by joins: for vocabularies of any size."""
    numbered = cut(docs.select("*", F.monotonically_increasing_id().alias("__row")))
    split = annotate(numbered.select("__row", "text"), ["text"], lambda text: [[units_of(t) for t in text]], "units array<string>")
    places = split.select("__row", F.posexplode("units").alias("place", "unit")).join(known, "unit")
    whole = places.groupBy("__row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "ids"))), lambda x: x["ids"])).alias("ids"))
    out = numbered.drop("ids", "n_pieces").join(whole, "__row", "left").drop("__row")
    return out.withColumn("ids", F.coalesce("ids", F.array().cast("array<int>"))).withColumn("n_pieces", F.size("ids").cast("long"))


def encode(docs: DataFrame, model_path: str, decoded: str = "") -> DataFrame:
    """docs with ids (array<int>) and n_pieces (long); with `decoded`, also what decoding the ids gives, in a column of that name."""
    model = Model(model_path)
    units = cut(docs.select("text").mapInArrow(_distinct, "unit string").distinct())
    with _grouping(docs.sparkSession):
        known = cut(lattice(units, model))
    packed = _packed(known)
    names = _Spelling(_bytes_of(model)) if decoded else None
    if packed is None:
        out = _joined(docs, known)
        return _decoded(out, names, decoded) if decoded else out
    return _assemble(docs, packed, names, decoded)


def _bytes_of(model: Model) -> list[bytes]:
    spelled = {i: b for b, i in model.bytes.items()}
    return [bytes([spelled[i]]) if i in spelled else name.replace(MARK, " ").encode() for i, name in enumerate(model.names)]


def _decoded(rows: DataFrame, spelling: _Spelling, added: str) -> DataFrame:
    return annotate(rows, ["ids"], lambda ids: [[spelling.texts(np.array(x or (), dtype=np.int64), [len(x or ())])[0] for x in ids]], f"{added} string")


def decode(rows: DataFrame, model_path: str, added: str = "decoded") -> DataFrame:
    """rows (with ids) with their text."""
    return _decoded(rows, _Spelling(_bytes_of(Model(model_path))), added)


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, n_pieces, ids, round_trip (decoding gives the text) with the public model."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    out = encode(texts(docs), path, "decoded")
    return out.select("doc_id", "n_pieces", "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
