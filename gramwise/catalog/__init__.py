"""Registered queries: each operator run on the given tables, with its SQL equivalent where one exists."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

AREAS = ("tables", "encoding", "samples", "summaries", "ordering", "fits", "exact_fits", "labels", "effects", "shifts", "neighbours", "predictive")

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for area in AREAS:
        out.update(import_module(f"gramwise.catalog.{area}").BOOK.queries)
    return out


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for area in AREAS:
        out.update(import_module(f"gramwise.catalog.{area}").BOOK.sql)
    return out
