"""Samples, splits and folds decided by a hash of the row key: stable under any partitioning or retry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gramwise.functions.hashing import hash_uniform
from gramwise.operators.ranks import attach, hash_rank, prefix
from gramwise.session import settle

_GRID = 4096
_FINISH_ROWS = 20_000
_COPIES_PER_ROW = 65_536


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def within_hash_rank(df: DataFrame, key: str | Sequence[str], size: int, seed: int) -> Column:
    """Condition true for exactly the ``size`` rows with the smallest (hash, key).

    The cut is found from histograms of the hash, narrowed until few rows remain, so that marking the rows is
    a projection: no sort or shuffle of the table.
    """
    key = _keys(key)
    if size <= 0:
        return F.lit(False)
    u = hash_uniform(key, seed)
    slim = df.select(*key, u.alias("__u"))
    low, width, before = 0.0, 1.0, 0
    while True:
        # The grid is a power of two, so every cell bound is an exact double.
        cell = F.floor((F.col("__u") - low) / width * _GRID)
        counts = (
            slim.where((F.col("__u") >= low) & (F.col("__u") < low + width))
            .groupBy(cell.alias("cell"))
            .count()
            .orderBy("cell")
            .collect()
        )
        if before + sum(r["count"] for r in counts) <= size:
            return F.lit(True) if low == 0.0 and width == 1.0 else u < F.lit(low + width)
        for r in counts:
            if before + r["count"] >= size:
                break
            before += r["count"]
        low, width = low + r["cell"] * width / _GRID, width / _GRID
        if r["count"] <= _FINISH_ROWS or width <= 2.0**-32:
            break
    last = (
        slim.where((F.col("__u") >= low) & (F.col("__u") < low + width))
        .orderBy("__u", *key)
        .limit(size - before)
        .groupBy()
        .agg(F.max(F.struct("__u", *key)).alias("m"))
        .first()["m"]
    )
    bound = F.struct(*[F.lit(last[name]).cast(slim.schema[name].dataType).alias(name) for name in ("__u", *key)])
    return F.struct(u.alias("__u"), *[F.col(k) for k in key]) <= bound


def _group_cuts(slim: DataFrame, key: list[str], by: list[str], take: Column) -> DataFrame:
    """(by..., __cut): per group the (hash, key) of its ``take``-th row; ``take`` may use the group size ``__n``.

    One histogram pass over all groups finds the cell of each cut; only the rows of those cells are ranked.
    """
    slim = slim.withColumn("__cell", F.floor(F.col("__u") * _GRID))
    running = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)
    counts = slim.groupBy(*by, "__cell").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumns({"__through": F.sum("c").over(running), "__n": F.sum("c").over(Window.partitionBy(*by))})
    counts = counts.withColumn("__take", F.least(take, F.col("__n")))
    cells = counts.where((F.col("__through") >= F.col("__take")) & (F.col("__through") - F.col("c") < F.col("__take")))
    cells = cells.select(*by, "__cell", (F.col("__take") - F.col("__through") + F.col("c")).alias("__need"))
    # Stored first: ranking would otherwise scan the whole table again to find its ranges.
    edge = prefix(settle(attach(slim, cells, [*by, "__cell"])), ["__u", *key], by=by)
    return edge.where(F.col("rank") == F.col("__need")).select(*by, F.struct("__u", *key).alias("__cut"))


def _flag_below(df: DataFrame, cuts: DataFrame, key: list[str], by: list[str], u: Column, name: str) -> DataFrame:
    mine = F.struct(u.alias("__u"), *[F.col(k) for k in key])
    return attach(df, cuts, by, "left").withColumn(name, F.coalesce(mine <= F.col("__cut"), F.lit(False))).drop("__cut")


def seed_samples(
    df: DataFrame, key: str | Sequence[str], size: int, seeds: Sequence[int], name: str = "is_labelled"
) -> DataFrame:
    """Every row once per seed, with a ``seed`` column and a flag for the ``size`` rows of smallest (hash, key)."""
    key = _keys(key)
    long = df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    u = hash_uniform(key, F.col("seed"))
    cuts = _group_cuts(long.select("seed", *key, u.alias("__u")), key, ["seed"], F.lit(size))
    return _flag_below(long, cuts, key, ["seed"], u, name)


def cap_rows(df: DataFrame, key: str | Sequence[str], cap: int, seed: int = 0) -> DataFrame:
    """Uniform sample without replacement of min(cap, N) rows."""
    return df.where(within_hash_rank(df, key, cap, seed))


def labelled_size(n: int, percent: float, cap: int | None = None) -> int:
    """That percentage of the rows, or ``cap`` if given and smaller."""
    size = int(percent * n / 100)
    return size if cap is None else min(cap, size)


def flag_labelled(
    df: DataFrame, key: str | Sequence[str], percent: float, cap: int | None = None, seed: int = 0, name: str = "is_labelled"
) -> DataFrame:
    """Mark a labelled sample of ``labelled_size`` rows; the complement is the flag's negation."""
    return df.withColumn(name, within_hash_rank(df, key, labelled_size(df.count(), percent, cap), seed))


def complement(df: DataFrame, sample: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``sample``."""
    return df.join(sample.select(*_keys(key)), _keys(key), "left_anti")


def train_test_split(
    df: DataFrame,
    key: str | Sequence[str],
    test_fraction: float | None = None,
    train_size: int | None = None,
    seed: int = 0,
    name: str = "split",
    exact: bool = True,
) -> DataFrame:
    """Add ``split`` = 'test' / 'train'. Exact sizes by default; otherwise each row decides by its own hash."""
    if (test_fraction is None) == (train_size is None):
        raise ValueError("give either test_fraction or train_size")
    if train_size is not None:
        in_train = within_hash_rank(df, key, train_size, seed)
        return df.withColumn(name, F.when(in_train, "train").otherwise("test"))
    if not exact:
        return df.withColumn(name, F.when(hash_uniform(key, seed) < test_fraction, "test").otherwise("train"))
    n = df.count()
    size = -int(-test_fraction * n // 1)
    return df.withColumn(name, F.when(within_hash_rank(df, key, size, seed), "test").otherwise("train"))


def stratified_split(
    df: DataFrame, key: str | Sequence[str], strata: str, fraction: float, seed: int = 0, name: str = "is_calibration"
) -> DataFrame:
    """Mark round(fraction * n_s) rows of every stratum s, by a cut of its own: no stratum is gathered or sorted."""
    key, u = _keys(key), hash_uniform(key, seed)
    take = F.round(F.col("__n") * F.lit(fraction)).cast("long")
    cuts = _group_cuts(df.select(strata, *key, u.alias("__u")), key, [strata], take)
    return _flag_below(df, cuts, key, [strata], u, name)


def kfold(
    df: DataFrame, key: str | Sequence[str], k: int, seed: int = 0, name: str = "fold", balanced: bool = False
) -> DataFrame:
    """Add a fold number 0..k-1: from the hash alone, or from the hash rank when sizes must differ by at most 1."""
    if not balanced:
        return df.withColumn(name, F.floor(hash_uniform(key, seed) * k).cast("int"))
    ranked = hash_rank(df, _keys(key), seed)
    return ranked.withColumn(name, ((F.col("rank") - 1) % k).cast("int")).drop("rank", "group_rows")


def head_tail_split(
    df: DataFrame, order: Sequence[str], head_rows: int, name: str = "part"
) -> DataFrame:
    """Add ``part`` = 'head' for the first ``head_rows`` rows in the stated unique order, else 'tail'.

    Only the order columns are ranked; the rows themselves are compared with the cut where they are.
    """
    order = list(order)
    slim = df.select(*order)
    if head_rows <= 0:
        return df.withColumn(name, F.lit("tail"))
    cut = prefix(slim, order).where(F.col("rank") == head_rows).select(*order).first()
    if cut is None:
        return df.withColumn(name, F.lit("head"))
    bound = F.struct(*[F.lit(cut[c]).cast(slim.schema[c].dataType).alias(c) for c in order])
    return df.withColumn(name, F.when(F.struct(*[F.col(c) for c in order]) <= bound, "head").otherwise("tail"))


def permutation_key(key: str | Sequence[str], seed: int = 0) -> list[Column]:
    """Columns whose order is a random permutation of the rows."""
    return [hash_uniform(key, seed), *[F.col(k) for k in _keys(key)]]


def weighted_copies(df: DataFrame, order: Sequence[str], weight: str, size: int, u: float) -> DataFrame:
    """Add ``copies``: how often each row is drawn by systematic resampling of ``size`` rows with offset u."""
    order = list(order)
    ranked = prefix(df.select(*order, weight), order, weight)
    mark = lambda c: F.floor(F.lit(float(size)) * F.col(c) / F.col("total") + F.lit(float(u)))
    # The final running sum is the total whatever the summation order was.
    upper = F.when(F.col("rank") == F.col("group_rows"), F.lit(size)).otherwise(mark("through"))
    copies = ranked.select(*order, weight, (upper - mark("before")).cast("long").alias("copies"))
    # Only a wide table has to be met again through its key.
    return copies if set(df.columns) == {*order, weight} else df.join(copies.drop(weight), order)


def weighted_resample(df: DataFrame, order: Sequence[str], weight: str, size: int, u: float = 0.5) -> DataFrame:
    """Exactly ``size`` rows drawn with replacement, P(row) proportional to weight; adds ``copy`` (1-based).

    Copies unfold in two steps, so that one row holding most of the weight does not build one huge array.
    """
    drawn = weighted_copies(df, order, weight, size, u).where(F.col("copies") > 0)
    blocks = drawn.withColumn(
        "__block", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / _COPIES_PER_ROW)))
    )
    first = F.col("__block") * _COPIES_PER_ROW + 1
    last = F.least(F.col("copies"), first + (_COPIES_PER_ROW - 1))
    if size > _COPIES_PER_ROW:
        blocks = blocks.repartition(*[F.col(c) for c in order], F.col("__block"))
    return blocks.withColumn("copy", F.explode(F.sequence(first, last))).drop("__block", "copies")


def parameter_grid(spark, **axes: Sequence) -> DataFrame:
    """Every combination of short literal lists, one column per axis."""
    grid = spark.range(1).select()
    for name, values in axes.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return grid
