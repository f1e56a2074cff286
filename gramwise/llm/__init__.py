"""Operators for training-data preparation on text corpora and embeddings, with their registered queries."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    return dict(import_module("gramwise.llm.queries").BOOK.queries)


def all_sql() -> dict[str, str]:
    return dict(import_module("gramwise.llm.queries").BOOK.sql)
