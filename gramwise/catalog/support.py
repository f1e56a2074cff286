"""Registration, table access and the SQL fragments shared by the oracles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class Book:
    """Queries of one area by name, with their SQL."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(column: str | Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def q(expression: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"(round(CAST(({expression}) AS DOUBLE), {digits}) + 0.0)"


def u(key: str, seed: int | str = 0) -> str:
    """SQL of ``hash_uniform``; ``key`` may be a comma list, ``seed`` a number or an SQL expression."""
    text = " || ':' || ".join(f"CAST({k.strip()} AS VARCHAR)" for k in [*key.split(","), str(seed)])
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0)"


def long_form(df: DataFrame, keys: Sequence[str], name: str = "term", value: str = "value", digits: int = 6) -> DataFrame:
    """All other columns as (keys..., name, rounded value)."""
    rest = [c for c in df.columns if c not in keys]
    cells = F.array(*[F.struct(F.lit(c).alias(name), r(c, digits).alias(value)) for c in rest])
    return df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")


def long_sql(source: str, keys: Sequence[str], columns: Sequence[str], name: str = "term", value: str = "value", digits: int = 6) -> str:
    head = "".join(f"{k}, " for k in keys)
    return " UNION ALL ".join(f"SELECT {head}'{c}' AS {name}, {q(c, digits)} AS {value} FROM {source}" for c in columns)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# Documents with their labels where they have them; x = ln(1 + n_chars), y = quality, tox = toxic.
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select(
        "doc_id", "lang", "source", F.log1p(F.col("n_chars").cast("double")).alias("x"),
        F.col("quality").cast("double").alias("y"), F.col("toxic").cast("double").alias("tox"),
        F.col("quality").isNotNull().alias("has_label"),
    )


DOCUMENTS = """docs AS (SELECT d.doc_id, d.lang, d.source, ln(1 + d.n_chars) AS x, CAST(l.quality AS DOUBLE) AS y,
  CAST(l.toxic AS DOUBLE) AS tox, l.quality IS NOT NULL AS has_label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


# Orders as a treatment study: t = urgent or high priority, y = price and x = balance, both in thousands.
def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("setup"),
        F.col("c_nationkey").alias("rep"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("t"),
        (F.col("o_totalprice") / 1000.0).alias("y"),
        (F.col("c_acctbal") / 1000.0).alias("x"),
    )


STUDY = """study AS (SELECT o.o_orderkey AS id, o.o_orderstatus AS setup, c.c_nationkey AS rep,
  CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS t,
  o.o_totalprice / 1000.0 AS y, c.c_acctbal / 1000.0 AS x FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""


def weighted_line(w: str, x: str = "x", y: str = "y") -> tuple[str, str]:
    """SQL aggregates (slope, intercept) of a weighted straight line."""
    sw, sx, sy, sxx, sxy = f"sum({w})", f"sum({w}*{x})", f"sum({w}*{y})", f"sum({w}*{x}*{x})", f"sum({w}*{x}*{y})"
    slope = f"(({sw})*({sxy})-({sx})*({sy}))/(({sw})*({sxx})-({sx})*({sx}))"
    return slope, f"(({sy})-({slope})*({sx}))/({sw})"


def plane(x1: str, x2: str, y: str) -> tuple[str, str, str]:
    """SQL aggregates (intercept, slope 1, slope 2) of least squares on two covariates."""
    v1, v2, c12 = f"var_pop({x1})", f"var_pop({x2})", f"covar_pop({x1},{x2})"
    c1, c2 = f"covar_pop({x1},{y})", f"covar_pop({x2},{y})"
    det = f"({v1}*{v2}-{c12}*{c12})"
    b1, b2 = f"(({c1}*{v2}-{c2}*{c12})/{det})", f"(({c2}*{v1}-{c1}*{c12})/{det})"
    return f"(avg({y})-{b1}*avg({x1})-{b2}*avg({x2}))", b1, b2


def newton_chain(source: str, steps: int = 12, by: Sequence[str] = (), w: str = "w", x: str = "x", y: str = "y", prefix: str = "n") -> str:
    """CTEs of unrolled logistic Newton steps on one covariate; the last is ``<prefix>_fit(by..., a, b)``."""
    keys = "".join(f"{k}, " for k in by)
    on = " AND ".join(f"s.{k} = t.{k}" for k in by) or "TRUE"
    group = f" GROUP BY {', '.join(by)}" if by else ""
    first = f"SELECT DISTINCT {keys}0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM {source}" if by else "SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b"
    parts = [f"{prefix}0 AS MATERIALIZED ({first})"]
    for k in range(steps):
        inner = f"SELECT s.*, t.a, t.b, 1.0/(1.0+exp(-(t.a+t.b*s.{x}))) AS p FROM {source} s JOIN {prefix}{k} t ON {on}"
        sums = (
            f"SELECT {keys}any_value(a) AS a, any_value(b) AS b, sum({w}*p*(1-p)) AS h11, sum({w}*p*(1-p)*{x}) AS h12, "
            f"sum({w}*p*(1-p)*{x}*{x}) AS h22, sum({w}*({y}-p)) AS g1, sum({w}*({y}-p)*{x}) AS g2 FROM ({inner}){group}"
        )
        name = f"{prefix}{k + 1}" if k + 1 < steps else f"{prefix}_fit"
        parts.append(
            f"{name} AS MATERIALIZED (SELECT {keys}a+(h22*g1-h12*g2)/(h11*h22-h12*h12) AS a, b+(h11*g2-h12*g1)/(h11*h22-h12*h12) AS b FROM ({sums}))"
        )
    return ", ".join(parts)
