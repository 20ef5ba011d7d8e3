"""The dataset: a DataFrame with a contiguous position per row, a version, and mutations that keep both."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MissingDataset, NonUniqueKey
from ..functions.values import POS, fitting, flat_field, named, value_key

_ROW, _PART, _START, _FROM, _TO, _KEY = (f"__recordloom_{x}" for x in ("row", "part", "start", "from", "to", "key"))
LITERALS = 200  # keys that a plan holds as literals; more are joined


def durable(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared folder that the session names."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it's unset, a local folder, but only if driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/recordloom-checkpoints"


def with_positions(df: DataFrame, keys: list[str] | None = None, order: list[Column] | None = None) -> tuple[DataFrame, int]:
    """df with positions from 0 in the order of keys or of `order` (else as read), and its number of rows.

    Rows are written once, so that their partitions stay put; positions are each partition's start,
    from one small count, plus the row's place in it. No row passes through a single task. The starts, a row a
    partition, are joined.
    """
    base = df.drop(POS)
    order = order or [named(k) for k in keys or ()]
    ordered = df.orderBy(*order).drop(POS) if order else base
    held = durable(ordered).select("*", F.monotonically_increasing_id().alias(_ROW))
    part = F.shiftrightunsigned(_ROW, 33)
    starts, at = [], 0
    for p, n in sorted((r[0], r[1]) for r in held.groupBy(part).agg(F.count("*")).collect()):
        starts.append((p, at))
        at += n
    table = df.sparkSession.createDataFrame(starts, f"{_PART} long, {_START} long")
    placed = held.join(F.broadcast(table), part == F.col(_PART))
    return placed.select(*[named(c) for c in base.columns], (F.col(_START) + F.col(_ROW).bitwiseAND(F.lit((1 << 33) - 1))).alias(POS)), at


def among(frame: DataFrame, column: Column, values: list, kind: T.DataType, inside: bool = True) -> DataFrame:
    """Rows whose column is one of the values (or isn't; null is none of them); many values are joined, not listed in the plan."""
    if len(values) <= LITERALS:
        return frame.where(column.isin(values) if inside else column.isNull() | ~column.isin(values))
    table = frame.sparkSession.createDataFrame([(v,) for v in values], T.StructType([T.StructField(_KEY, kind)]))
    return frame.join(table, column == F.col(_KEY), "left_semi" if inside else "left_anti")


class Store:
    """A versioned dataset; engines of a facade share one."""

    CUT_AFTER = 20  # mutations after which the plan is cut

    def __init__(self, data: DataFrame | None = None, keys: list[str] | None = None):
        self.version, self.frame = 0, None
        self.count: int | None = 0  # None: not counted
        self._listeners: list[Callable] = []
        self._since_cut = 0
        if data is not None:
            self._load(data, keys)

    def _load(self, data: DataFrame, keys=None) -> None:
        if POS in data.columns:  # positions are the caller's: contiguous from 0
            self.frame, self.count = data, data.count()
        else:
            self.frame, self.count = with_positions(data, keys)

    @property
    def spark(self) -> SparkSession:
        return self.need().sparkSession

    def need(self) -> DataFrame:
        if self.frame is None:
            raise MissingDataset("no dataset: pass data to the constructor or to data()")
        return self.frame

    def filled(self, operation: str) -> DataFrame:
        """The dataset, if it's known to hold a row or hasn't been counted."""
        if self.frame is None or self.count == 0:
            raise MissingDataset(f"{operation}: no dataset in memory")
        return self.frame

    def rows(self) -> DataFrame:
        """The dataset in its order, without positions."""
        return self.need().orderBy(POS).drop(POS)

    def subscribe(self, listener: Callable[[dict], None]) -> Callable[[], None]:
        self._listeners.append(listener)
        return lambda: self._listeners.remove(listener) if listener in self._listeners else None

    def _changed(self, frame: DataFrame, count: int, event: dict) -> None:
        self._since_cut += 1
        if self._since_cut >= self.CUT_AFTER:
            frame, self._since_cut = durable(frame), 0
        self.frame, self.count = frame, count
        self.version += 1
        for listener in list(self._listeners):
            listener(event)

    def _counted(self) -> int:
        if self.count is None:
            self.count = self.need().count()
        return self.count

    def _at(self, positions) -> dict[int, dict]:
        """Rows at some positions, for events; none are read if nobody listens."""
        if not self._listeners or not positions:
            return {}
        frame = among(self.need(), F.col(POS), sorted(positions), T.LongType())
        return {r[POS]: {k: v for k, v in r.asDict().items() if k != POS} for r in frame.collect()}

    def replace(self, data: DataFrame, keys: list[str] | None = None) -> None:
        self._load(data, keys)
        self._since_cut = 0
        self._changed(self.frame, self.count, {"type": "data", "data": self.rows()})

    def clear(self) -> None:
        frame = self.need().limit(0)
        self._changed(frame, 0, {"type": "clear_data", "data": frame.drop(POS)})

    def add(self, items: DataFrame | list) -> None:
        """Appends rows in their order; none change nothing."""
        frame = self.need()
        schema = T.StructType([f for f in frame.schema if f.name != POS])
        if not isinstance(items, DataFrame):
            items = self.spark.createDataFrame([tuple(x.get(n) for n in schema.names) for x in items], schema)
        more, n = with_positions(items)
        if n:
            start = self._counted()
            more = more.withColumn(POS, F.col(POS) + start)
            self._changed(frame.unionByName(more, allowMissingColumns=True), start + n, {"type": "add", "items": more.orderBy(POS).drop(POS), "count": n, "start_index": start})

    def update(self, field: str, row: dict) -> None:
        """Replaces the last row whose key is row[field]; no such row, or a null key, changes nothing."""
        frame, key = self.need(), row.get(field)
        found = flat_field(frame, field)
        values = fitting([key], found[1]) if found and key is not None else []
        if not values:
            return
        at = frame.where(found[0] == F.lit(values[0])).agg(F.max(POS)).first()[0]
        if at is None:
            return
        schema = T.StructType([f for f in frame.schema if f.name != POS])
        new = self.spark.createDataFrame([tuple(row.get(n) for n in schema.names)], T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])).withColumn(POS, F.lit(at).cast("long"))
        before = self._at([at]).get(at)
        self._changed(frame.where(F.col(POS) != at).unionByName(new), self.count, {"type": "update", "field": field, "index": at, "previous_item": before, "next_item": {n: row.get(n) for n in schema.names}})

    def delete(self, field: str, values) -> None:
        """Deletes the row of each value; each time, the last row moves into the hole."""
        frame = self.need()
        wanted = list(values) if isinstance(values, (list, tuple, set)) else [values]
        found = flat_field(frame, field)
        fits = fitting([v for v in wanted if v is not None], found[1]) if found else []
        if not fits:
            return
        hits = among(frame, found[0], fits, found[1])
        held = hits.groupBy(found[0].alias("value")).agg(F.count("*").alias("n"), F.max(POS).alias("at")).collect()
        if many := sorted((str(r.value) for r in held if r.n > 1)):
            raise NonUniqueKey(f"delete by {field}: several rows hold {', '.join(many)}")
        places = {value_key(r.value): r.at for r in held}
        wanted = {places[value_key(v)]: v for v in fits if value_key(v) in places}
        steps = swap_steps(list(wanted), self._counted())
        if not steps:
            return
        removed, moved = swap_pop(list(wanted), self.count)
        rows = self._at({x for row, _, mover, _ in steps for x in (row, mover) if x is not None})
        entries = [{"value": wanted[row], "removed_item": rows.get(row), "removed_index": hole, "moved_item": rows.get(mover), "moved_from_index": last} for row, hole, mover, last in steps]
        event = {"type": "remove", "field": field, **entries[0]} if not isinstance(values, (list, tuple, set)) else {"type": "remove_many", "field": field, "entries": entries}
        kept = among(frame, F.col(POS), sorted(removed), T.LongType(), inside=False)
        if moved:
            pairs = kept.sparkSession.createDataFrame(sorted(moved.items()), f"{_FROM} long, {_TO} long")  # as many as values given
            kept = kept.join(pairs, F.col(POS) == F.col(_FROM), "left").withColumn(POS, F.coalesce(_TO, POS)).drop(_FROM, _TO)
        self._changed(kept, self.count - len(removed), event)


def swap_steps(positions: list[int], count: int) -> list[tuple[int, int, int | None, int | None]]:
    """(removed row, its place then, the row that moves there, that row's place) of each delete, rows by old position."""
    occupant: dict[int, int] = {}
    place: dict[int, int] = {}
    gone: set[int] = set()
    out = []
    for row in positions:
        if row in gone:
            continue
        hole, last = place.get(row, row), count - 1
        mover = occupant.get(last, last)
        gone.add(row)
        if mover != row:
            occupant[hole], place[mover] = mover, hole
        out.append((row, hole, mover, last) if mover != row else (row, hole, None, None))
        count -= 1
    return out


def swap_pop(positions: list[int], count: int) -> tuple[set[int], dict[int, int]]:
    """(removed rows, moved rows and their new positions), both by old position, of one delete after the other."""
    steps = swap_steps(positions, count)
    removed = {row for row, *_ in steps}
    place = {mover: hole for _, hole, mover, _ in steps if mover is not None}
    return removed, {r: p for r, p in place.items() if r not in removed and r != p}


def all_of(conditions: list[Column]) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))
