"""Exact order statistics by digits: counts of leading digits narrow every wanted rank to a cell, whose rows alone are
counted by their next digits.

A value becomes a long whose order is the value's. Pass by pass, tasks count digits (a map-side aggregate), and running
sums over the digits of a group, at most ``2**_FIRST`` of them, tell which cell holds which rank. All ranks of all groups
narrow together. No row is sorted, stored or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gramwise.operators.joins import joined
from gramwise.session import joinable, settle

_FIRST, _NEXT = 20, 22
"""Bits of the first digit, and of each of the two that follow."""

_DIRECT_ROWS = 2_000_000
"""Cells with this many rows together are counted by whole values at once."""


def ordered_long(column: Column, kind: T.DataType) -> Column | None:
    """A long in the order of the values, equal for equal values; None for a type without one."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return column.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (column * F.lit(10**kind.scale).cast("decimal(19,0)")).cast("long")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return _bits(column.cast("double"))
    return None


def from_long(column: Column, kind: T.DataType) -> Column:
    """The value again."""
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(column.cast("int"))
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(column)
    if isinstance(kind, T.DecimalType):
        return (column.cast("decimal(19,0)") / F.lit(10**kind.scale).cast("decimal(19,0)")).cast(kind)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return _unbits(column).cast(kind)
    return column.cast(kind)


@F.pandas_udf(T.LongType())
def _bits(values: pd.Series) -> pd.Series:
    # a negative zero equals zero; the bits of negative numbers count downwards
    raw = (values.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(raw < 0, raw ^ np.int64(0x7FFFFFFFFFFFFFFF), raw))


@F.pandas_udf(T.DoubleType())
def _unbits(keys: pd.Series) -> pd.Series:
    raw = keys.to_numpy(np.int64)
    return pd.Series(np.where(raw < 0, raw ^ np.int64(0x7FFFFFFFFFFFFFFF), raw).view(np.float64))


def select_ranks(df: DataFrame, column: str | Column, wanted: Callable[[Column], Column], by: Sequence[str] = ()) -> DataFrame:
    """(by..., r, value): the r-th smallest value of a group for every rank in the array ``wanted(rows of the group)``.

    Ranks count from 1; nulls and NaN are no values; a rank wanted twice comes twice.
    """
    by = list(by)
    column = F.col(column) if isinstance(column, str) else column
    named = df.select(*by, column.alias("__value"))
    kind = named.schema["__value"].dataType
    known = F.col("__value").isNotNull() & (~F.isnan("__value") if isinstance(kind, (T.FloatType, T.DoubleType)) else F.lit(True))
    key = ordered_long(F.col("__value"), kind)
    if key is None:
        raise TypeError(f"no digits for values of type {kind.simpleString()}")
    rows = named.where(known).select(*by, key.alias("__key"))
    rest = 64 - _FIRST
    counts = rows.groupBy(*by, F.shiftright("__key", rest).alias("__cell")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    counts = counts.select(*by, "__cell", "__n", before.alias("__before"), F.sum("__n").over(Window.partitionBy(*by)).alias("__rows"))
    found = _hits(counts.withColumn("__wanted", wanted(F.col("__rows"))), [*by, "__cell"])
    while rest:
        found = settle(found)
        cells = found.groupBy(*by, "__cell").agg(F.max("__n").alias("__n"))
        size = cells.agg(F.sum("__n")).first()[0] or 0
        low = 0 if size <= _DIRECT_ROWS else max(0, rest - _NEXT)
        inside = joined(rows.withColumn("__cell", F.shiftright("__key", rest)), joinable(cells.drop("__n")), [*by, "__cell"], "inner")
        inside = inside.groupBy(*by, "__cell", F.shiftright("__key", low).alias("__next")).agg(F.count(F.lit(1)).alias("__n"))
        order = Window.partitionBy(*by, "__cell").orderBy("__next").rowsBetween(Window.unboundedPreceding, 0)
        inside = inside.withColumn("__in", F.sum("__n").over(order) - F.col("__n"))
        ranks = found.groupBy(*by, "__cell", "__before").agg(F.collect_list("r").alias("__wanted"))
        inside = joined(inside, ranks, [*by, "__cell"], "inner").withColumn("__before", F.col("__before") + F.col("__in"))
        found = _hits(inside.drop("__cell").withColumnRenamed("__next", "__cell"), [*by, "__cell"])
        rest = low
    return found.select(*by, "r", from_long(F.col("__cell"), kind).alias("value"))


def _hits(counts: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each wanted rank that falls into a cell."""
    inside = F.filter("__wanted", lambda r: (r > F.col("__before")) & (r <= F.col("__before") + F.col("__n")))
    return counts.select(*keys, "__n", "__before", F.explode(inside).alias("r"))
