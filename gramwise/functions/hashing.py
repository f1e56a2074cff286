"""Uniform numbers derived from a row key, so that a sample does not depend on the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def hash_uniform(key: str | Column | Sequence[str | Column], seed: int | Column = 0) -> Column:
    """A number in [0, 1): the first 32 bits of md5("key:seed") over 2^32. ``seed`` may be a column."""
    parts = list(key) if isinstance(key, (list, tuple)) else [key]
    columns = [F.col(part) if isinstance(part, str) else part for part in parts]
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    text = F.concat_ws(":", *[c.cast("string") for c in columns], seed.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
