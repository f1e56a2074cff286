"""Ranks and prefix sums over a whole table without a single-task window.

The table is range-partitioned on the order columns and stored once with its partition number. Totals per
partition are a small table; each row then needs only a window inside its own partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gramwise.functions.hashing import hash_uniform
from gramwise.operators.digits import select_ranks
from gramwise.operators.joins import attach as attach, joined as _joined
from gramwise.session import settle

_BUCKET = "__bucket"
_SLOTS = 1 << 14


def _buckets(df: DataFrame) -> int:
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _within_buckets(df: DataFrame, by: list[str], order: list[Column], value: Column | None) -> DataFrame:
    value = F.lit(1) if value is None else value
    df = df.withColumn("__value", value)
    keys = [*by, _BUCKET]
    # __n rows and __total value per bucket, then the running start of every bucket.
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum("__value").alias("__total"))
    before = Window.partitionBy(*by).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy(*by).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy(*by)
    totals = totals.select(
        *keys,
        "__n",
        F.sum("__n").over(group).alias("__rows"),
        F.sum("__total").over(group).alias("__sum"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__rank0"),
        F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__value0"),
        F.sum("__total").over(through).alias("__value1"),
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    joined = _joined(df, totals, keys)
    number = F.row_number().over(inside)
    # The last row of a bucket takes the next bucket's start, so neighbouring rows always share one number.
    return joined.select(
        *[c for c in df.columns if c not in (_BUCKET, "__value")],
        (F.col("__rank0") + number).alias("rank"),
        (F.col("__value0") + F.coalesce(F.sum("__value").over(earlier), F.lit(0))).alias("before"),
        F.when(number == F.col("__n"), F.col("__value1"))
        .otherwise(F.col("__value0") + F.sum("__value").over(running))
        .alias("through"),
        F.col("__rows").alias("group_rows"),
        F.col("__sum").alias("total"),
    )


def prefix(
    df: DataFrame,
    order: Sequence[str],
    value: str | Column | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Add ``rank`` (1-based), ``before`` and ``through`` (running sums of ``value``, default 1), and the group's

    ``group_rows`` and ``total``. The rows are stored once on the way, so pass only the columns needed.

    ``order`` must identify a row inside its group: aggregate to distinct values first, or end the list with
    a unique key. Hot groups and hot values are then spread over partitions.
    """
    by, order = list(by), list(order)
    ranged = df.repartitionByRange(_buckets(df), *by, *order).withColumn(_BUCKET, F.spark_partition_id())
    value = F.col(value) if isinstance(value, str) else value
    return _within_buckets(settle(ranged), by, [F.col(c) for c in order], value)


def hash_rank(df: DataFrame, key: Sequence[str], seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Add ``rank`` in the order of the key's hash. Buckets are equal slices of [0, 1): no range pass needed."""
    by, key = list(by), list(key)
    n = _buckets(df)
    df = df.withColumn("__u", hash_uniform(key, seed)).withColumn(_BUCKET, F.floor(F.col("__u") * n))
    ranked = _within_buckets(df, by, [F.col("__u"), *[F.col(c) for c in key]], None)
    return ranked.drop("__u", "before", "through", "total")


def value_counts(df: DataFrame, column: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with counts; hot values collapse before the shuffle. Nulls and NaN are no values."""
    column = F.col(column) if isinstance(column, str) else column
    counts = df.groupBy(*by, column.alias("value")).agg(F.count(F.lit(1)).alias("n")).where("value is not null")
    return counts.where(~F.isnan("value")) if dict(counts.dtypes)["value"] in ("double", "float") else counts


def order_statistic_edges(df: DataFrame, column: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Distinct quantile edges of ``column`` for k = 0..bins, one row per edge: (by..., value).

    With t = (N-1)k/bins and j = floor(t): the j-th smallest value when t is an integer, otherwise the
    (j+1)-th; k=0 is the minimum and k=bins the maximum. Integer arithmetic keeps the test for t exact.
    """
    by = list(by)

    def wanted(total: Column) -> Column:
        t = lambda k: (total - 1) * k
        ranks = F.transform(
            F.sequence(F.lit(0), F.lit(bins)),
            lambda k: F.when(k == 0, F.lit(1).cast("long"))
            .when(k == bins, total)
            .when(t(k) % bins == 0, F.floor(t(k) / bins))
            .otherwise(F.floor(t(k) / bins) + 1),
        )
        # An integer t of zero (a one-row table) still means the first row.
        return F.array_distinct(F.transform(ranks, lambda r: F.greatest(r, F.lit(1).cast("long"))))

    return select_ranks(df, column, wanted, by).select(*by, "value").distinct()


def level_quantiles(df: DataFrame, column: str, levels: Sequence[float], by: Sequence[str] = (), name: str = "q") -> DataFrame:
    """(by..., q): for every level the smallest value whose rank reaches level * N, as one ascending array per group."""
    by = list(by)
    # Rank wanted per level; the slack keeps level * N exact where it is an integer.
    wanted = lambda total: F.array(*[F.greatest(F.ceil(total * F.lit(float(a)) - 1e-9), F.lit(1)) for a in levels])
    return select_ranks(df, column, wanted, by).groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda s: s["value"].cast("double")).alias(name)
    )


def other_folds_quantiles(df: DataFrame, column: str, levels: Sequence[float], fold: str, folds: int, by: Sequence[str] = (), name: str = "q") -> DataFrame:
    """(by..., fold, q): for every fold from 0 to ``folds`` - 1 the level quantiles of all rows of the other folds."""
    others = F.filter(F.array(*[F.lit(k) for k in range(folds)]), lambda k: k != F.col(fold))
    rows = df.select(*by, column, F.explode(others).alias(fold))
    return level_quantiles(rows, column, levels, [*by, fold], name)


def auc(df: DataFrame, label: str, score: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by mid-ranks: (by..., auc). Equal scores collapse before ranking.

    Rows without a label or a score take no part.
    """
    by = list(by)
    score = F.col(score) if isinstance(score, str) else score
    tallies = df.where(F.col(label).isNotNull() & score.isNotNull() & ~F.isnan(score.cast("double"))).groupBy(*by, score.alias("value")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"),
    )
    ranked = prefix(tallies, ["value"], "neg", by)
    return ranked.groupBy(*by).agg(
        (
            F.sum(F.col("pos") * (F.col("before") + F.col("neg") / 2.0)) / (F.sum("pos") * F.sum("neg"))
        ).alias("auc")
    )


def uniform_ks(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Kolmogorov-Smirnov distance of a column to the uniform distribution on [0, 1]: (by..., ks, n).

    Counts of slots bound the distance within each slot; only values of slots that may hold the largest are ranked.
    """
    by = list(by)
    values = df.select(*by, (F.col(column).cast("double") + F.lit(0.0)).alias("value")).where("value is not null and not isnan(value)")
    # values outside [0, 1] lie in slots beyond its ends
    slot = F.floor(F.greatest(F.lit(-1.0), F.least(F.col("value"), F.lit(2.0))) * _SLOTS).cast("long").alias("slot")
    counts = values.groupBy(*by, slot).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    earlier = Window.partitionBy(*by).orderBy("slot")
    before = F.sum("n").over(earlier) - F.col("n")
    slots = counts.select("*", before.alias("start"), F.sum("n").over(Window.partitionBy(*by)).alias("total"))
    start, end = F.col("start") / F.col("total"), (F.col("start") + F.col("n")) / F.col("total")
    slots = slots.select("*", F.greatest(end - F.col("high"), F.col("low") - start).alias("met"), F.greatest(end - F.col("low"), F.col("high") - start).alias("most"))
    slots = settle(slots.select("*", F.max("met").over(Window.partitionBy(*by)).alias("least")))
    open_slots = slots.where("low < high and most > least").select(*by, "slot", "start", F.col("total").alias("all"))
    inner = value_counts(attach(values.withColumn("slot", slot), open_slots, [*by, "slot"]), "value", [*by, "slot", "start", "all"])
    ranked = prefix(inner, ["value"], "n", [*by, "slot", "start", "all"])
    through, passed = (F.col("start") + F.col("through")) / F.col("all"), (F.col("start") + F.col("before")) / F.col("all")
    gaps = ranked.select(*by, F.greatest(through - F.col("value"), F.col("value") - passed).alias("ks"), F.col("all").alias("n"))
    return slots.select(*by, F.col("least").alias("ks"), F.col("total").alias("n")).unionByName(gaps).groupBy(*by).agg(F.max("ks").alias("ks"), F.max("n").alias("n"))


def density_histogram(df: DataFrame, column: str, bins: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Density of values on [0, 1] in equal bins: (by..., bin 0-based, n, density); 1.0 falls in the last bin.

    Nulls and NaN are no values.
    """
    by = list(by)
    df = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    slot = F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(*by, slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("density", F.col("n") * F.lit(float(bins)) / total)


def running_effects(df: DataFrame, order: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative sum, previous cumulative sum (0 at the start) and their mean, over few ordered rows."""
    w = Window.partitionBy(*by).orderBy(order)
    out = df.withColumn("cumulative", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("previous", F.lag("cumulative", 1, 0.0).over(w))
    return out.withColumn("midpoint", (F.col("cumulative") + F.col("previous")) / 2.0)
