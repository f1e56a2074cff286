"""Joins of rows with small tables of statistics derived from them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from gramwise.session import joinable


def joined(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equal keys, nulls equal to nulls; the keys once and first, as in a join by name."""
    keys = list(keys)
    if not keys:
        return df.crossJoin(table)
    renamed = table.select(*[F.col(k).alias(f"__key_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys])
    both = df.join(renamed, same, how).drop(*[f"__key_{k}" for k in keys])
    rest = [c for c in both.columns if c not in keys]
    return both.select(*keys, *rest) if len(set(rest)) == len(rest) else both


def attach(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a table of statistics or coefficients that was derived from much larger data.

    It is computed once and stored; it is broadcast when its measured size is small, else joined by shuffle. A null
    key is a group like any other.
    """
    return joined(df, joinable(table), keys, how)
