"""Sort descriptors as columns, with null and tie rules stated.

Null numbers sort as zero; other nulls come last ascending and first descending. Ties keep row order,
or reverse it where a descending order is a reversed ascending one: a single descending key that is a
number, or that is a configured field of the stored dataset; with several keys, a configured first key
of the stored dataset decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import flat_field


@dataclass(frozen=True)
class Descriptor:
    field: str
    direction: str = "asc"


def descriptors_of(given) -> list[Descriptor]:
    return [Descriptor(d["field"], d.get("direction", "asc")) if isinstance(d, dict) else d for d in given]


#: One key of an order: a value, and whether it descends. Nulls are the largest values either way.
Key = tuple[Column, bool]


def columns(order: list[Key]) -> list[Column]:
    return [value.desc_nulls_first() if down else value.asc_nulls_last() for value, down in order]


def order_of(df: DataFrame, descriptors: list[Descriptor], row_order: list[Key], configured: tuple[str, ...] = (), stored: bool = True) -> list[Key]:
    """Keys of the sorted rows; row_order is how df's rows stand so far."""
    out, numeric = [], False
    for number, d in enumerate(descriptors):
        found = flat_field(df, d.field)
        if found is None:
            continue
        value, kind = found
        if isinstance(kind, T.NumericType):
            numeric = numeric or number == 0
            value = F.coalesce(value, F.lit(0).cast(kind))
        out.append((value, d.direction == "desc"))
    first = descriptors[0]
    held = stored and first.field in configured
    reverse = first.direction == "desc" and (held or len(descriptors) == 1 and numeric)
    return out + [(value, down != reverse) for value, down in row_order]
