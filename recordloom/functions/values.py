"""Literals and fields: strict typing of filter values, text normalisation, field resolution."""

from __future__ import annotations

import datetime
import math
import struct
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that a query is trimmed of.
BLANKS = "\t\n\v\f\r                  　﻿"

#: The one column name that the engine keeps to itself: a row's position.
POS = "__recordloom_position"

_WHOLE = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def normal_query(query: str) -> str:
    return query.strip(BLANKS).lower()


def utf16_length(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def value_key(value) -> tuple:
    """Equal for values that count as the same: types never mix, NaN is itself, 1 is 1.0."""
    if value is None:
        return ("null",)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, (int, float, Decimal)):
        return ("nan",) if value != value else ("number", value)
    if isinstance(value, (bytes, bytearray)):
        return ("bytes", bytes(value))
    return (type(value).__name__, value)


def unique(values) -> dict[tuple, object]:
    return {value_key(v): v for v in values}


def fitting(values, kind: T.DataType) -> list:
    """The non-null values that a column of this type can hold; others match nothing and are left out."""
    out = []
    for v in values:
        number = isinstance(v, (int, float, Decimal)) and not isinstance(v, bool)
        if type(kind) in _WHOLE and number:
            if math.isfinite(v) and v == int(v) and -(2 ** (_WHOLE[type(kind)] - 1)) <= v < 2 ** (_WHOLE[type(kind)] - 1):
                out.append(int(v))
        elif isinstance(kind, T.DoubleType) and number:
            out.append(float(v))
        elif isinstance(kind, T.FloatType) and number:
            if not math.isfinite(v) or abs(v) < 3.4028235677973366e38:  # beyond that, no float is nearest
                out.append(struct.unpack("f", struct.pack("f", v))[0])
        elif isinstance(kind, T.BinaryType) and isinstance(v, (bytes, bytearray)):
            out.append(bytes(v))
        elif isinstance(kind, T.DecimalType) and number and math.isfinite(v):
            out.append(Decimal(str(v)))
        elif isinstance(kind, T.StringType) and isinstance(v, str) or isinstance(kind, T.BooleanType) and isinstance(v, bool):
            out.append(v)
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)) and isinstance(v, datetime.datetime):
            out.append(v)
        elif isinstance(kind, T.DateType) and isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
            out.append(v)
    return out


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def flat_field(df: DataFrame, field: str) -> tuple[Column, T.DataType] | None:
    """Column and type of a top-level field; None if there is none, which reads as null everywhere."""
    if field in df.columns and field != POS:
        return named(field), df.schema[field].dataType
    return None


def nested_field(df: DataFrame, path: str) -> tuple[Column, str, T.DataType] | None:
    """(array, key, type of the key) of "collection.key", cut at the first dot."""
    collection, dot, key = path.partition(".")
    if not dot or collection not in df.columns:
        return None
    kind = df.schema[collection].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and key in kind.elementType.names:
        return named(collection), key, kind.elementType[key].dataType
    return None


def text_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != POS]
