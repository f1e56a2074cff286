"""Writers of results."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def write_results(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Partitioned parquet; a rerun replaces only the partitions it produces.

    Rebalancing by the partition columns gives few files per small partition and several tasks to a hot one.
    """
    (
        df.hint("rebalance", *partitions)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def fixed_decimals(column, digits: int = 4):
    """Text of a double with fixed decimals, rounded from its exact binary value as C and Python do.

    The JVM's format rounds the shortest decimal form instead, which differs on apparent ties.
    """

    @F.pandas_udf("string")
    def show(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else f"{v:.{digits}f}").astype(object)

    return show(column)


def write_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    """CSV with a header, doubles at a fixed number of decimals, keys kept as columns."""
    shown = [fixed_decimals(F.col(name), digits).alias(name) if kind == "double" else F.col(name) for name, kind in df.dtypes]
    df.select(*shown).write.mode("overwrite").csv(path, header=True)
