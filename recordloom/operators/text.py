"""Substring search, ignoring case: predicates over flat and nested fields, and the rank of the first field that matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import POS, flat_field, nested_field


def matches(df: DataFrame, field: str, query: str, nested: tuple[str, ...] = ()) -> Column:
    """Whether the field holds the normalised query; never null. Fields that aren't text match nothing."""
    deep = nested_field(df, field) if field in nested else None
    if deep:
        array, key, kind = deep
        if not isinstance(kind, T.StringType):
            return F.lit(False)
        return F.coalesce(F.exists(array, lambda x: F.coalesce(F.contains(F.lower(x[key]), F.lit(query)), F.lit(False))), F.lit(False))
    flat = flat_field(df, field)
    if not flat or not isinstance(flat[1], T.StringType):
        return F.lit(False)
    return F.coalesce(F.contains(F.lower(flat[0]), F.lit(query)), F.lit(False))


def matches_any(df: DataFrame, fields: list[str], query: str, nested: tuple[str, ...] = ()) -> Column:
    return reduce(Column.__or__, [matches(df, f, query, nested) for f in fields], F.lit(False))


def rank(df: DataFrame, fields: list[str], query: str, nested: tuple[str, ...] = ()) -> Column:
    """Number of the first field that matches."""
    chain = F
    for k, f in enumerate(fields):
        chain = chain.when(matches(df, f, query, nested), F.lit(k))
    return chain.otherwise(F.lit(len(fields))) if fields else F.lit(0)


SIZES = (2, 3)  # letters of the grams of a gram table


def grams(df: DataFrame, field: str) -> DataFrame:
    """gram, position: a table of a field's distinct substrings of 2 and of 3 letters, for repeated searches."""
    low = F.lower(flat_field(df, field)[0])

    def held(size: int) -> Column:
        pieces = F.transform(F.sequence(F.lit(1), F.char_length(low) - (size - 1)), lambda k: F.substring(low, k, F.lit(size)))
        return F.when(F.char_length(low) >= size, pieces).otherwise(F.array().cast("array<string>"))

    return df.where(F.char_length(low) >= SIZES[0]).select(F.explode(F.array_distinct(F.concat(*map(held, SIZES)))).alias("gram"), POS)


def gram_candidates(table: DataFrame, query: str, most: int = 12) -> DataFrame:
    """Positions of rows that hold all of up to `most` evenly spaced grams of the query (of 2 letters or more); they're yet to be confirmed."""
    size = min(SIZES[-1], len(query))
    if size < SIZES[0]:
        raise ValueError(f"a query of {len(query)} letters has no gram")
    parts = list(dict.fromkeys(query[k : k + size] for k in range(len(query) - size + 1)))
    if len(parts) > most:
        parts = [parts[k * (len(parts) - 1) // (most - 1)] for k in range(most)]
    return table.where(F.col("gram").isin(parts)).groupBy(POS).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(set(parts))).select(POS)
