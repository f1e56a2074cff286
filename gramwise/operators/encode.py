"""Projections, encodings and filters of one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gramwise.functions.hashing import hash_uniform
from gramwise.operators.ranks import attach, prefix


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(subset) if subset else None)


def null_report(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, kept, removed."""
    complete = F.lit(True)
    for name in subset or df.columns:
        complete = complete & F.col(name).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(complete).alias("kept")).withColumn(
        "removed", F.col("rows") - F.col("kept")
    )


def split_target(df: DataFrame, target: str, name: str = "y") -> DataFrame:
    """The target as ``y`` followed by the other columns; an absent target raises."""
    if target not in df.columns:
        raise ValueError(f"no column {target!r}; the table has {df.columns}")
    return df.select(F.col(target).alias(name), *[c for c in df.columns if c != target])


def label_codes(df: DataFrame, column: str, code: str = "code") -> DataFrame:
    """(column, code): sorted distinct labels numbered from 0, ranked without a single-task window."""
    levels = df.select(column).where(F.col(column).isNotNull()).distinct()
    return prefix(levels, [column]).select(column, (F.col("rank") - 1).cast("int").alias(code))


def encode_labels(df: DataFrame, column: str, code: str = "code") -> DataFrame:
    return attach(df, label_codes(df, column, code), [column], "left")


def levels_of(df: DataFrame, column: str, most: int | None = None) -> list[str]:
    """Sorted distinct levels of a categorical column that is about to become one column per level.

    ``most`` is the caller's bound on them: more levels are refused.
    """
    levels = df.select(column).where(F.col(column).isNotNull()).distinct()
    found = [r[0] for r in (levels if most is None else levels.limit(most + 1)).collect()]
    if most is not None and len(found) > most:
        raise ValueError(f"{column!r} has more than {most} levels, too many to be columns: use dummy_rows")
    return sorted(found)


def dummies(
    df: DataFrame, columns: Sequence[str], drop_first: bool, levels: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Replace categorical columns by 0/1 columns ``<column>_<level>``, optionally without the smallest level."""
    kept = [F.col(c) for c in df.columns if c not in columns]
    for column in columns:
        values = list(levels[column]) if levels and column in levels else levels_of(df, column)
        for value in values[1:] if drop_first else values:
            kept.append(F.when(F.col(column) == F.lit(value), 1).otherwise(0).alias(f"{column}_{value}"))
    return df.select(*kept)


def dummy_rows(df: DataFrame, key: Sequence[str], columns: Sequence[str], drop_first: bool) -> DataFrame:
    """The same encoding as sparse rows (key..., column, level) for any number of levels; only the ones are kept."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])
    rows = df.select(*key, F.explode(cells).alias("c")).select(*key, "c.*").where(F.col("level").isNotNull())
    if not drop_first:
        return rows
    smallest = df.agg(*[F.min(F.col(c).cast("string")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    first = F.coalesce(*[F.when(F.col("column") == c, F.lit(smallest[f"m{i}"])) for i, c in enumerate(columns)])
    return rows.where(F.col("level") != first)


def scaling_statistics(df: DataFrame, columns: Sequence[str], where: Column | None = None) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column in one pass, over all rows or those meeting ``where``."""
    def pick(c):
        return F.when(where, F.col(c)) if where is not None else F.col(c)

    row = df.agg(
        *[F.avg(pick(c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(pick(c)).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def apply_scaling(df: DataFrame, statistics: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / deviation with a zero deviation read as 1."""
    return df.withColumns(
        {c: (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0) for c, (m, s) in statistics.items()}
    )


def standardise(df: DataFrame, columns: Sequence[str], fit_where: Column | None = None) -> DataFrame:
    """Standardise on the whole table, or with statistics of the rows meeting ``fit_where`` (a training split)."""
    return apply_scaling(df, scaling_statistics(df, columns, fit_where))


def polynomial_columns(columns: Sequence[str | Column], order: int, intercept: bool = True) -> list[Column]:
    """1, then every x, then every x^2, ... up to ``order``; no cross terms."""
    columns = [F.col(c) if isinstance(c, str) else c for c in columns]
    out = [F.lit(1.0)] if intercept else []
    for k in range(1, order + 1):
        for c in columns:
            term = c
            for _ in range(k - 1):
                term = term * c
            out.append(term)
    return out


def polynomial_names(columns: Sequence[str], order: int) -> list[str]:
    return [c if k == 1 else f"{c}^{k}" for k in range(1, order + 1) for c in columns]


def combine_blocks(blocks: Sequence[tuple[DataFrame, str]], features: Sequence[str]) -> DataFrame:
    """Stack (table, response column) blocks as (target, features...)."""
    stacked = None
    for df, response in blocks:
        part = df.select(F.col(response).cast("double").alias("target"), *[F.col(f).cast("double") for f in features])
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def stack_rows(*tables: DataFrame) -> DataFrame:
    """Union by name; columns missing on one side become null."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def bind_columns(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Side-by-side columns of two tables through their row key."""
    return left.join(right, list(key))


def require_same_width(labelled: Sequence[str], unlabelled: Sequence[str]) -> None:
    if list(labelled) != list(unlabelled):
        raise ValueError(f"covariates differ: {list(labelled)} and {list(unlabelled)}")


def counterfactual_rows(df: DataFrame, treatment: str) -> DataFrame:
    """Every row twice, with the treatment set to 0 and to 1."""
    return df.withColumn(treatment, F.explode(F.array(F.lit(0), F.lit(1))))


def arm(df: DataFrame, treatment: str, value: int) -> DataFrame:
    return df.where(F.col(treatment) == value)


def split_features(columns: Sequence[str], n_modifiers: int) -> tuple[list[str], list[str]]:
    """Effect modifiers (the first n) and controls (the rest)."""
    return list(columns[:n_modifiers]), list(columns[n_modifiers:])


def region(x, low: float = -1.0, high: float = 1.0) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.when((x >= low) & (x <= high), "interpolation").otherwise("extrapolation")


def to_double(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast to double; a value that cannot be cast fails the job rather than turning null."""
    def cast(c):
        number = F.col(c).try_cast("double")
        bad = F.raise_error(F.concat(F.lit(f"{c} is not numeric: "), F.col(c).cast("string")))
        return F.when(F.col(c).isNotNull() & number.isNull(), bad.cast("double")).otherwise(number)

    return df.withColumns({c: cast(c) for c in columns})


def flip_labels(label, key, rho: float | Column, seed: int | Column = 0) -> Column:
    """The 0/1 label, flipped for a share rho of the rows; rho = 0 changes nothing."""
    if not isinstance(rho, Column) and not 0.0 <= rho <= 1.0:
        raise ValueError("rho must lie in [0, 1]")
    label = F.col(label) if isinstance(label, str) else label
    rho = rho if isinstance(rho, Column) else F.lit(float(rho))
    return F.when(hash_uniform(key, seed) < rho, 1 - label).otherwise(label)


def fractional_rows(df: DataFrame, p1: str, observed: Column | None = None, label: str = "y", weight: str = "w") -> DataFrame:
    """Unlabelled rows twice, once per class with the class probability as weight; observed rows once, weight 1.

    ``observed`` says where ``label`` is known; by default nothing is.
    """
    classes = F.array(
        F.struct(F.lit(0.0).alias("l"), (F.lit(1.0) - F.col(p1)).alias("v")),
        F.struct(F.lit(1.0).alias("l"), F.col(p1).cast("double").alias("v")),
    )
    if observed is not None:
        known = F.array(F.struct(F.col(label).cast("double").alias("l"), F.lit(1.0).alias("v")))
        classes = F.when(observed, known).otherwise(classes)
    out = df.withColumn("__c", F.explode(classes))
    return out.withColumns({label: F.col("__c.l"), weight: F.col("__c.v")}).drop("__c")


def region_weight(x, bound: float, cut: float = 0.5) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x > cut, F.lit(float(bound))).otherwise(F.lit(1.0 / bound))


def tilt_weights(df: DataFrame, columns: Sequence[str], beta: Sequence[float], name: str = "w") -> DataFrame:
    """Weights exp(x'beta) that sum to 1 over the table. The largest exponent is taken out first."""
    from gramwise.functions.scalars import dot

    eta = dot(columns, beta)
    top = df.agg(F.max(eta)).first()[0]
    raw = F.exp(eta - F.lit(top))
    total = df.agg(F.sum(raw)).first()[0]
    return df.withColumn(name, raw / F.lit(total))
