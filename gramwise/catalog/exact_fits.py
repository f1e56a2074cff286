"""Fits far from zero, exact quantile fits, and iterations run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from gramwise.catalog.support import STUDY, Book, newton_chain, q, r, study, table
from gramwise.operators import iterate as I
from gramwise.operators.centred import centred_moments
from gramwise.operators.moments import least_squares, linear_score

BOOK = Book()

_DAYS = "date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))"


def _orders(spark, sf):
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double")
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", seconds.alias("seconds"), (F.col("o_totalprice") / 1000.0).cast("double").alias("price"))


@BOOK.add(
    "mod1_epoch_seconds",
    f"""SELECT o_orderstatus AS status, {q(f"regr_slope(o_totalprice / 1000.0, {_DAYS}) * 365", 5)} AS per_year,
    {q(f"regr_intercept(o_totalprice / 1000.0, {_DAYS})", 5)} AS at_1995 FROM orders GROUP BY 1""",
)
def mod1_seconds(spark, sf):
    """A covariate about 8e8 with seconds as its unit, as it comes; the SQL counts days from 1995."""
    fits = least_squares(_orders(spark, sf), ["seconds"], "price", by=["o_orderstatus"])
    slope, start = F.get("theta", 1), 788918400.0
    return fits.select(F.col("o_orderstatus").alias("status"), r(slope * 86400.0 * 365, 5).alias("per_year"), r(F.get("theta", 0) + slope * start, 5).alias("at_1995"))


_DEAR = f"s AS (SELECT {_DAYS} / 1000.0 AS x, CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END AS y, 1.0 AS w FROM orders)"


@BOOK.add("mod2_logistic_epoch_seconds", f"WITH {_DEAR}, {newton_chain('s')} SELECT {q('a', 5)} AS at_1995, {q('b', 5)} AS per_1000_days FROM n_fit")
def mod2_seconds(spark, sf):
    rows = _orders(spark, sf).select("seconds", (F.col("price") > 150.0).cast("double").alias("dear"))
    theta = I.logistic_regression(rows, ["seconds"], "dear").select((F.get("theta", 0) + F.get("theta", 1) * 788918400.0).alias("a"), (F.get("theta", 1) * 86400000.0).alias("b"))
    return theta.select(r("a", 5).alias("at_1995"), r("b", 5).alias("per_1000_days"))


@BOOK.add(
    "mod3_quantiles_of_two_groups",
    " UNION ALL ".join(
        f"""SELECT {tau} AS tau, {q("any_value(lo)", 5)} AS group_0, {q("any_value(hi)", 5)} AS group_1, 'ok' AS status
        FROM (SELECT (SELECT quantile_disc(y, {tau}) FROM study WHERE t = 0) AS lo, (SELECT quantile_disc(y, {tau}) FROM study WHERE t = 1) AS hi)"""
        for tau in (0.137, 0.737)
    ).replace("SELECT 0.137", f"WITH {STUDY} SELECT 0.137::DOUBLE", 1).replace("SELECT 0.737 AS", "SELECT 0.737::DOUBLE AS"),
)
def mod3_groups(spark, sf):
    """Quantile regression on a 0/1 covariate has to return the exact quantiles of its two groups."""
    rows, out = study(spark, sf), []
    for tau in (0.137, 0.737):
        theta, status = I.quantile_regression(rows, ["t"], "y", tau)
        out.append((tau, float(theta[0]), float(theta[0] + theta[1]), status))
    found = spark.createDataFrame(out, "tau double, group_0 double, group_1 double, status string")
    return found.select("tau", r("group_0", 5).alias("group_0"), r("group_1", 5).alias("group_1"), "status")


@BOOK.add(
    "mod3_check_loss_at_the_minimum",
    f"""WITH {STUDY}, lines AS (SELECT a.y - (b.y - a.y) / (b.x - a.x) * a.x AS c, (b.y - a.y) / (b.x - a.x) AS m
      FROM (SELECT DISTINCT x, y FROM study WHERE setup = 'P' AND id % 8 = 0) a JOIN (SELECT DISTINCT x, y FROM study WHERE setup = 'P' AND id % 8 = 0) b ON a.x < b.x),
    losses AS (SELECT c, m, sum(CASE WHEN s.y < c + m * s.x THEN -0.63 ELSE 0.37 END * (s.y - c - m * s.x)) AS loss FROM lines, (SELECT x, y FROM study WHERE setup = 'P' AND id % 8 = 0) s GROUP BY c, m)
    SELECT {q("min(loss)", 4)} AS loss FROM losses""",
)
def mod3_minimum(spark, sf):
    """The least check loss of a line on one covariate; the SQL tries every line through two rows."""
    rows = study(spark, sf).where("setup = 'P' and id % 8 = 0")
    theta, _ = I.quantile_regression(rows, ["x"], "y", 0.37)
    gap = F.col("y") - linear_score(theta, ["x"])
    return rows.agg(r(F.sum(F.when(gap < 0, -0.63).otherwise(0.37) * gap), 4).alias("loss"))


@BOOK.add("mod5_descent_to_convergence", f"WITH {STUDY}, s AS (SELECT (x - 4.5) / 3.2 AS x, CAST(t AS DOUBLE) AS y, 1.0 AS w FROM study), {newton_chain('s')} SELECT {q('a', 5)} AS intercept, {q('b', 5)} AS slope, 'ok' AS status FROM n_fit")
def mod5_whole(spark, sf):
    """Gradient descent until its steps vanish, with its status; the SQL finds the same minimum by Newton steps."""
    rows = study(spark, sf).select(((F.col("x") - 4.5) / 3.2).alias("x"), F.col("t").cast("double").alias("t"))
    theta, _, status = I.gradient_descent(rows, ["x"], "t", [0.0, 0.0], 4.0, "logistic", tol=1e-9, max_iter=200)
    return spark.createDataFrame([(float(theta[0]), float(theta[1]), status)], "a double, b double, status string").select(r("a", 5).alias("intercept"), r("b", 5).alias("slope"), "status")


@BOOK.add(
    "cls1_class_covariances_of_all_dimensions",
    f"""SELECT label, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {q("covar_samp(CAST(embedding[i + 1] AS DOUBLE), CAST(embedding[j + 1] AS DOUBLE))")} AS value
    FROM embeddings, range(64) a(i), range(64) b(j) WHERE i <= j GROUP BY 1, 2, 3""",
)
def cls1_all(spark, sf):
    """Covariances of all 64 coordinates within each class, from centred sums."""
    rows = table(spark, sf, "embeddings").select("label", *[F.get("embedding", i).cast("double").alias(f"e{i}") for i in range(64)])
    sums = centred_moments(rows, [f"e{i}" for i in range(64)], by=["label"])
    pairs = [(i, j) for i in range(-1, 64) for j in range(i, 64)]
    names = spark.createDataFrame([(at, i, j) for at, (i, j) in enumerate(pairs) if i >= 0], "at int, i int, j int")
    out = sums.select("label", "n", F.posexplode("g").alias("at", "s")).join(F.broadcast(names), "at")
    return out.select("label", "i", "j", r(F.col("s") / (F.col("n") - 1)).alias("value"))
