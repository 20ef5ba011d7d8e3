"""Search, filter and sort engines over a store, their previous-result sessions, and the facade that joins them."""

from __future__ import annotations

import warnings
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadOption, MissingEngine
from ..functions.values import POS, flat_field, normal_query, text_fields, utf16_length
from ..operators import predicates as P
from ..operators import text as X
from ..operators.ordering import Key, columns, descriptors_of, order_of
from ..sources.store import Store, durable, with_positions

HISTORY = 12
RESULTS = 32  # plans of filter results that are kept for repeated criteria


class Result:
    """A lazy result: rows with positions, and the columns that order them. Its identity names it in sessions."""

    def __init__(self, owner, frame: DataFrame, order: list[Key], window: tuple[int, int | None] = (0, None)):
        self.owner, self.rows, self.order, self.window = owner, frame, order, window

    def frame(self) -> DataFrame:
        """The rows in order, within the window, without internal columns."""
        out = self.rows.orderBy(*columns(self.order))
        offset, limit = self.window
        if offset:
            out = out.offset(offset)
        if limit is not None:
            out = out.limit(limit)
        return out.drop(POS)

    def settled(self) -> tuple[DataFrame, list[Key]]:
        """Rows and order for a further step; a window is applied first."""
        offset, limit = self.window
        if not offset and limit is None:
            return self.rows, self.order
        out = self.rows.orderBy(*columns(self.order)).offset(offset)
        return (out if limit is None else out.limit(limit)), self.order

    def collect(self):
        return self.frame().collect()

    def filter(self, criteria) -> Result:
        return self.owner.filter(self, criteria)

    def sort(self, descriptors) -> Result:
        return self.owner.sort(self, descriptors)

    def search(self, *query, **window) -> Result:
        return self.owner.search(*query, **window)

    def add(self, items):
        return self.owner.add(items)

    def update(self, field, row):
        return self.owner.update(field, row)

    def delete(self, field, values):
        return self.owner.delete(field, values)

    def data(self, data, keys=None):
        return self.owner.data(data, keys)

    def origin(self) -> DataFrame:
        return self.owner.origin()

    def clear_data(self, *kind) -> Result:
        """Clears the owner's dataset; this result stays as it was."""
        self.owner.clear_data(*kind)
        return self

    def clear_indexes(self, *kind) -> Result:
        self.owner.clear_indexes(*kind)
        return self


class _Engine:
    def __init__(self, data=None, fields=(), nested_fields=(), store: Store | None = None, keys=None):
        self.store = store or Store(data, keys)
        self.fields = tuple(fields)
        self.nested = tuple(f for f in nested_fields if "." in f)

    def all(self) -> Result:
        return Result(self, self.store.need(), [(F.col(POS), False)])

    def source(self, given) -> Result:
        """A result or an ad-hoc DataFrame as a Result."""
        if isinstance(given, Result):
            return given
        frame = given if POS in given.columns else with_positions(given)[0]
        return Result(self, frame, [(F.col(POS), False)])

    def origin(self) -> DataFrame:
        return self.store.rows()

    def add(self, items):
        self.store.add(items)
        return self

    def update(self, field, row):
        self.store.update(field, row)
        return self

    def delete(self, field, values):
        self.store.delete(field, values)
        return self

    def data(self, data, keys=None):
        self.store.replace(data, keys)
        return self

    def clear_data(self):
        self.store.clear()
        return self

    def clear_indexes(self):
        """Drops what is kept for repeated calls; answers never depend on it."""
        return self


class SearchEngine(_Engine):
    kind = "search"

    def __init__(self, data=None, fields=(), nested_fields=(), min_query_length=1, filter_by_previous_result=False, silent=False, gram_index=False, **rest):
        """gram_index: searches of 2 letters or more in a flat configured field go through a table of its grams, written at the first one."""
        super().__init__(data, fields, nested_fields, **rest)
        self.shortest, self.narrowing, self.silent, self.gram_index = min_query_length, filter_by_previous_result, silent, gram_index
        self._grams: dict[str, tuple[int, DataFrame]] = {}
        self.reset_stats()
        self.warned: OrderedDict[tuple, str] = OrderedDict()
        self.reset_search_state()

    def reset_search_state(self):
        self._previous: tuple[str, Result, int] | None = None
        return self

    def clear_indexes(self):
        self._grams.clear()
        return self

    def _candidates(self, rows: DataFrame, field: str, query: str) -> DataFrame:
        """rows, or those of them that hold the query's grams in the field."""
        if not self.gram_index or field not in self.fields or not flat_field(rows, field) or len(query) < X.SIZES[0]:
            return rows
        if self._grams.get(field, (None,))[0] != self.store.version:
            self._grams[field] = self.store.version, durable(X.grams(self.store.need(), field))
        return rows.join(X.gram_candidates(self._grams[field][1], query), POS, "left_semi")

    def reset_stats(self):
        self._stats: dict[str, list[int]] = {}

    def stats(self) -> dict:
        indexed, fallback = (sum(s[k] for s in self._stats.values()) for k in (0, 1))
        total = indexed + fallback
        return {"total": total, "indexed": indexed, "fallback": fallback, "rate": fallback / total if total else 0.0, "scopes": {k: {"indexed": a, "fallback": b} for k, (a, b) in self._stats.items()}}

    def warnings(self) -> list[str]:
        return list(self.warned.values())

    def _record(self, scope: str, indexed: bool, query: str, reason: str, narrowed: bool) -> None:
        """Counts a search; one over all rows of the dataset, not of a narrowing, also warns."""
        self._stats.setdefault(scope, [0, 0])[not indexed] += 1
        if not indexed and not narrowed and not self.silent and utf16_length(query) >= 2 and (scope, query, reason) not in self.warned:
            self.warned[scope, query, reason] = f"search on {scope} for {query!r} scans all rows: {reason}"
            warnings.warn(self.warned[scope, query, reason], stacklevel=4)

    def search(self, *args, limit: int | None = None, offset: int = 0) -> Result:
        """search(query) over all fields, or search(field, query)."""
        field, raw = (None, args[0]) if len(args) == 1 else args
        query = normal_query(raw)
        windowed = limit is not None or bool(offset)
        window = (max(0, int(offset)), None if limit is None else max(0, int(limit)))
        whole = self.all()
        if window[1] == 0:
            return Result(self, whole.rows.limit(0), whole.order)
        if not query or utf16_length(query) < self.shortest:
            return Result(self, whole.rows, whole.order, window)
        base = self._narrowed(query)
        found = self._find(field, query, base or whole, base is not None)
        if self.narrowing and not windowed:
            self._previous = (query, found, self.store.version)
        return Result(self, found.rows, found.order, window) if windowed else found

    def _narrowed(self, query: str) -> Result | None:
        if not self.narrowing or not self._previous:
            return None
        before, result, version = self._previous
        if version == self.store.version and before in query:
            return result
        self._previous = None
        return None

    def _find(self, field: str | None, query: str, base: Result, narrowed: bool) -> Result:
        rows, long = base.rows, utf16_length(query) >= 2
        by_row = [(F.col(POS), False)]
        if field is not None:
            known = field in self.fields or field in self.nested
            if not known and self.fields and long and not narrowed:
                return Result(self, rows.limit(0), by_row)
            self._record(field, known and long, query, "too short" if known else "field isn't configured", narrowed)
            return Result(self, self._candidates(rows, field, query).where(X.matches(rows, field, query, self.nested)), by_row)
        configured = [*self.fields, *self.nested]
        fields = configured or text_fields(rows)
        self._record("*", bool(configured) and long, query, "too short" if configured else "no fields are configured", narrowed)
        found = rows.where(X.matches_any(rows, fields, query, self.nested))
        if narrowed and not self.nested:
            return Result(self, found, base.order)
        if not configured or not long:
            return Result(self, found, by_row)
        return Result(self, found, [(X.rank(rows, fields, query, self.nested), False), *by_row])


class FilterEngine(_Engine):
    kind = "filter"

    def __init__(self, data=None, fields=(), nested_fields=(), filter_by_previous_result=False, **rest):
        super().__init__(data, fields, nested_fields, **rest)
        self.narrowing = filter_by_previous_result
        self.reset_filter_state()
        self._whole: tuple[int, Result] | None = None
        self._results: OrderedDict[tuple, Result] = OrderedDict()

    def clear_indexes(self):
        self._results.clear()
        return self

    def reset_filter_state(self):
        self._previous: tuple | None = None  # result, criteria, key, base
        self._history: OrderedDict[tuple, Result] = OrderedDict()
        return self

    def _base(self) -> Result:
        self.store.filled("filter")
        if not self._whole or self._whole[0] != self.store.version:
            self._whole = (self.store.version, self.all())
            self.reset_filter_state()
        return self._whole[1]

    def filter(self, *args) -> Result:
        """filter(criteria) on the dataset, or filter(data, criteria) on a result or DataFrame."""
        stored = len(args) == 1
        base = self._base() if stored else self.source(args[0])
        new = P.resolve(args[-1])
        if not self.narrowing:
            return self._repeated(base, new) if stored else self._run(base, new)
        return self._sequential(base, new, stored)

    def _repeated(self, base: Result, criteria) -> Result:
        """The same result object for criteria that were asked lately of the same version."""
        key = (self.store.version, P.criteria_key(criteria))
        if key not in self._results:
            self._results[key] = self._run(base, criteria)
            while len(self._results) > RESULTS:
                self._results.popitem(last=False)
        self._results.move_to_end(key)
        return self._results[key]

    def _run(self, base: Result, criteria) -> Result:
        if not criteria:
            return base
        rows, order = base.settled()
        return Result(self, P.apply(rows, criteria, self.nested), order)

    def _sequential(self, base: Result, new, stored: bool) -> Result:
        key = P.criteria_key(new)
        if stored and len(new) == 1 and new[0].values is None and new[0].exclude and new[0].field in self.fields:
            same = self._previous and self._previous[2] == key and self._previous[3] is base
            return self._keep(self._previous[0] if same else self._run(base, new), new, key, base)
        if not new:
            self.reset_filter_state()
            return base
        if not self._previous or self._previous[3] is not base:
            self._history.clear()
            return self._keep(self._run(base, new), new, key, base)
        before, old, old_key, _ = self._previous
        if key == old_key:
            return before
        if key in self._history:
            return self._keep(self._history[key], new, key, base)
        again = P.backtracks(old, new) or not P.stays_empty(old, new) and before.rows.isEmpty()
        return self._keep(self._run(base, new) if again else self._run(before, P.delta(old, new)), new, key, base)

    def _keep(self, result: Result, criteria, key, base) -> Result:
        self._previous = (result, criteria, key, base)
        if any(r.values is not None for r in criteria):
            self._history[key] = result
            self._history.move_to_end(key)
            while len(self._history) > HISTORY:
                self._history.popitem(last=False)
        return result

    def sort(self, *_):
        raise MissingEngine("sort: this is a filter engine")

    search = sort


class SortEngine(_Engine):
    kind = "sort"

    def sort(self, *args) -> Result:
        """sort(descriptors) on the dataset, or sort(data, descriptors) on a result or DataFrame."""
        stored = len(args) == 1
        if stored:
            self.store.filled("sort")
        base, by = (self.all() if stored else self.source(args[0])), descriptors_of(args[-1])
        if not by:
            return base
        rows, order = base.settled()
        return Result(self, rows, order_of(rows, by, order, self.fields, stored))


class Facade:
    """One dataset behind any of the three engines; results chain, or follow one another."""

    def __init__(self, data=None, engines=(SearchEngine, FilterEngine, SortEngine), filter_by_previous_result=False, keys=None, **options):
        self.store = Store(data, keys)
        self.follow = filter_by_previous_result
        self._last: tuple[Result, int] | None = None
        self._kept: dict[str, tuple] = {}
        self.engines: dict[str, _Engine] = {}
        for cls in engines:
            if cls.kind in self.engines:
                continue
            own = {**options.get(cls.kind, {}), **options.get(cls.__name__, {})}
            if cls.kind == "filter" and "filter_by_previous_result" in own:
                raise BadOption("set filter_by_previous_result on the facade, not on its filter engine")
            if cls.kind == "filter":
                own["filter_by_previous_result"] = filter_by_previous_result
            self.engines[cls.kind] = cls(store=self.store, **own)

    def _engine(self, kind: str):
        if kind not in self.engines:
            raise MissingEngine(f"{kind}: the facade was built without this engine")
        return self.engines[kind]

    def _cached(self, op: str, key, source, make: Callable[[], Result]) -> Result:
        """The same result object for the same call on the same source and version."""
        held = self._kept.get(op)
        if held and held[0] == (key, self.store.version) and held[1] is source:
            result = held[2]
        else:
            made = make()
            result = made if made is source else Result(self, made.rows, made.order, made.window)
            self._kept[op] = ((key, self.store.version), source, result)
        self._last = (result, self.store.version)
        return result

    def _input(self, args):
        if len(args) == 2:
            return args[0]
        if self.follow and self._last and self._last[1] == self.store.version:
            return self._last[0]
        return None

    def search(self, *args) -> Result:
        engine = self._engine("search")
        return self._cached("search", tuple(args), None, lambda: engine.search(*args))

    def filter(self, *args) -> Result:
        engine, source = self._engine("filter"), self._input(args)
        call = (lambda: engine.filter(args[-1])) if source is None else (lambda: engine.filter(source, args[-1]))
        if self.follow and source is not None:  # the session of the filter engine decides, also for a repeated call
            made = call()
            self._last = (made, self.store.version)
            made.owner = self
            return made
        return self._cached("filter", P.criteria_key(P.resolve(args[-1])), source, call)

    def sort(self, *args) -> Result:
        engine, source = self._engine("sort"), self._input(args)
        call = (lambda: engine.sort(args[-1])) if source is None else (lambda: engine.sort(source, args[-1]))
        return self._cached("sort", tuple((d.field, d.direction) for d in descriptors_of(args[-1])), source, call)

    def origin(self) -> DataFrame:
        if not self.engines:
            raise MissingEngine("origin: the facade was built without engines")
        return self.store.rows()

    def add(self, items):
        self.store.add(items)
        return self

    def update(self, field, row):
        self.store.update(field, row)
        return self

    def delete(self, field, values):
        self.store.delete(field, values)
        return self

    def data(self, data, keys=None):
        self.store.replace(data, keys)
        return self

    def clear_data(self, kind: str = "search"):
        self._engine(kind)
        self.store.clear()
        return self

    def clear_indexes(self, kind: str = "search"):
        self._engine(kind).clear_indexes()
        return self
