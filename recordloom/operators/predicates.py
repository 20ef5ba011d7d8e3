"""Filter criteria: normalisation on the driver, then one Column per field.

Values are IN, exclusions are NOT IN that keeps null rows. Criteria of a field merge: values intersect,
exclusions unite. Over an array of records, values ask for any matching element, exclusions that no
element is excluded; each criterion is existential by itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import fitting, flat_field, nested_field, unique


@dataclass(frozen=True)
class Criterion:
    field: str
    values: tuple | None = None
    exclude: tuple | None = None


@dataclass(frozen=True)
class Resolved:
    """One field's criteria, merged: typed keys to values; None where there is no constraint."""

    field: str
    values: dict | None
    exclude: dict | None

    @property
    def impossible(self) -> bool:
        return self.values is not None and not self.values

    @property
    def key(self) -> tuple:
        order = lambda d: None if d is None else tuple(sorted(d, key=repr))
        return self.field, order(self.values), order(self.exclude)


def criteria_of(given) -> list[Criterion]:
    out = []
    for c in given:
        if isinstance(c, dict):
            c = Criterion(c["field"], c.get("values"), c.get("exclude"))
        out.append(c)
    return out


def resolve(given) -> list[Resolved]:
    """Criteria by field, in field order; those that constrain nothing are left out."""
    merged: dict[str, tuple[dict | None, dict | None]] = {}
    for c in criteria_of(given):
        values = None if c.values is None else unique(c.values)
        exclude = unique(c.exclude) if c.exclude else None
        if values is None and not exclude:
            continue
        if c.field in merged:
            was_values, was_exclude = merged[c.field]
            if was_values is not None:
                values = was_values if values is None else {k: v for k, v in was_values.items() if k in values}
            exclude = {**(was_exclude or {}), **(exclude or {})} or None
        merged[c.field] = (values, exclude)
    out = []
    for field in sorted(merged):
        values, exclude = merged[field]
        if values is not None and exclude:
            values = {k: v for k, v in values.items() if k not in exclude}
        out.append(Resolved(field, values, exclude))
    return out


def criteria_key(resolved: list[Resolved]) -> tuple:
    return tuple(r.key for r in resolved)


def _among(value: Column, kind: T.DataType, wanted: dict) -> Column:
    """value is one of wanted; false, never null, for null values unless null is wanted."""
    rest = fitting([v for v in wanted.values() if v is not None], kind)
    found = value.isin(rest) if rest else F.lit(False)
    return (found | value.isNull()) if ("null",) in wanted else found


def _not_among(value: Column, kind: T.DataType, banned: dict) -> Column:
    rest = fitting([v for v in banned.values() if v is not None], kind)
    if ("null",) in banned:
        return value.isNotNull() & ~value.isin(rest) if rest else value.isNotNull()
    return (value.isNull() | ~value.isin(rest)) if rest else F.lit(True)


def _any(array: Column, test) -> Column:
    return F.coalesce(F.exists(array, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def predicate(df: DataFrame, r: Resolved, nested: tuple[str, ...] = ()) -> Column:
    if r.impossible:
        return F.lit(False)
    deep = nested_field(df, r.field) if r.field in nested else None
    if deep:
        array, key, kind = deep
        parts = []
        if r.values is not None:
            parts.append(_any(array, lambda x: _among(x[key], kind, r.values)))
        if r.exclude:
            parts.append(~_any(array, lambda x: _among(x[key], kind, r.exclude)))
        return reduce(Column.__and__, parts)
    value, kind = flat_field(df, r.field) or (F.lit(None).cast("string"), T.StringType())
    parts = []
    if r.values is not None:
        parts.append(_among(value, kind, r.values))
    if r.exclude:
        parts.append(_not_among(value, kind, r.exclude))
    return reduce(Column.__and__, parts)


def apply(df: DataFrame, resolved: list[Resolved], nested: tuple[str, ...] = ()) -> DataFrame:
    """All criteria as one filter; flat ones first, which reach the scan."""
    if not resolved:
        return df
    flat_first = sorted(resolved, key=lambda r: r.field in nested)
    return df.where(reduce(Column.__and__, [predicate(df, r, nested) for r in flat_first]))


# The steps of a narrowing session.


def _grows(old: dict, new: dict) -> bool:
    return len(new) > len(old) and all(k in new for k in old)


def backtracks(old: list[Resolved], new: list[Resolved]) -> bool:
    """Whether new criteria let rows back in that old ones took out."""
    now = {r.field: r for r in new}
    return any(_field_backtracks(o, now.get(o.field)) for o in old)


def _field_backtracks(o: Resolved, n: Resolved | None) -> bool:
    if n is None:
        return True
    for before, after in ((o.values, n.values), (o.exclude, n.exclude)):
        if before is not None and after is None:
            return True
        if before is not None and before.keys() != after.keys():
            return after.keys() <= before.keys()
        if before is None and after is not None:
            return False
    return False


def delta(old: list[Resolved], new: list[Resolved]) -> list[Resolved]:
    """What of new is yet to be tested on a result of old: the added values alone, where a list has grown."""
    was = {r.field: r for r in old}
    out = []
    for n in new:
        o = was.get(n.field)
        if o and o.values is not None and n.values is not None and not o.exclude and not n.exclude and _grows(o.values, n.values):
            n = Resolved(n.field, {k: v for k, v in n.values.items() if k not in o.values}, None)
        elif o and o.exclude and n.exclude and (o.values or {}).keys() == (n.values or {}).keys() and (o.values is None) == (n.values is None) and _grows(o.exclude, n.exclude):
            n = Resolved(n.field, n.values, {k: v for k, v in n.exclude.items() if k not in o.exclude})
        out.append(n)
    return out


def stays_empty(old: list[Resolved], new: list[Resolved]) -> bool:
    """Whether new may be applied to an empty result of old: shared fields' lists are equal, grow or appear."""
    was = {r.field: r for r in old}
    for n in new:
        if o := was.get(n.field):
            for before, after in ((o.values, n.values), (o.exclude, n.exclude)):
                if before is not None and (after is None or not before.keys() <= after.keys()):
                    return False
    return True
