"""Scores of predictions, replicate summaries, joins of outcomes and truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from gramwise.catalog.support import STUDY, Book, long_form, long_sql, q, r, study, table, u
from gramwise.functions.hashing import hash_uniform
from gramwise.operators import metrics as M
from gramwise.operators.iterate import exact_median
from gramwise.operators.ranks import attach
from gramwise.operators.sampling import kfold

BOOK = Book()

# Prices predicted from the balance, with a known effect and a guessed one.
_TRUTH = "(1.0 + 0.1 * x)"
_GUESS = "(1.1 + 0.05 * x)"
_STUDY = f"{STUDY}, eff AS (SELECT *, {_TRUTH} AS tau, {_GUESS} AS tau_hat, 250.0 + x AS yhat FROM study)"


def _effects(spark, sf):
    return study(spark, sf).withColumns({"tau": 1.0 + 0.1 * F.col("x"), "tau_hat": 1.1 + 0.05 * F.col("x"), "yhat": 250.0 + F.col("x")})


@BOOK.add(
    "jon1_covariates_outcomes_truth",
    f"WITH {_STUDY} SELECT n_regionkey AS region, e.setup, count(*) AS n, {q('avg(tau)')} AS tau, {q('avg(y)', 4)} AS y FROM eff e JOIN nation ON n_nationkey = e.rep GROUP BY 1, 2",
)
def jon1(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("rep"), F.col("n_regionkey").alias("region"))
    return _effects(spark, sf).join(nations, "rep").groupBy("region", "setup").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("tau")).alias("tau"), r(F.avg("y"), 4).alias("y")
    )


@BOOK.add("jon2_agg5_mse_rmse", f"WITH {_STUDY} SELECT setup, {q('avg((y - yhat) * (y - yhat))', 4)} AS mse, {q('sqrt(avg((y - yhat) * (y - yhat)))')} AS rmse FROM eff GROUP BY setup")
def agg5(spark, sf):
    out = M.metric_table(_effects(spark, sf), ["setup"], mse=M.mse("y", "yhat"), rmse=M.rmse("y", "yhat"))
    return out.select("setup", r("mse", 4).alias("mse"), r("rmse").alias("rmse"))


_FOLD = f"CAST(floor({u('event_id', 8)} * 10) AS INTEGER)"
_EST = f"est AS (SELECT event_type, {_FOLD} AS fold, avg(value) AS theta FROM events GROUP BY 1, 2), truth AS (SELECT event_type, avg(value) AS truth FROM events GROUP BY 1)"


def _estimates(spark, sf):
    """Replicate estimates: the mean per fold and event type, and the full-data mean."""
    events = table(spark, sf, "events").select("event_id", F.col("event_type").alias("term"), "value")
    estimates = kfold(events, "event_id", 10, 8).groupBy("term", "fold").agg(F.avg("value").alias("theta"))
    truth = events.groupBy("term").agg(F.avg("value").alias("theta"))
    return estimates, truth


@BOOK.add(
    "agg6_bias_variance_mse",
    f"""WITH {_EST} SELECT event_type AS term, {q("avg(theta - truth)")} AS bias, {q("var_pop(theta)")} AS variance, {q("avg((theta - truth) * (theta - truth))")} AS mse
    FROM est JOIN truth USING (event_type) GROUP BY 1""",
)
def agg6(spark, sf):
    estimates, truth = _estimates(spark, sf)
    joined = M.term_errors(estimates, truth)
    out = M.replicate_metrics(joined, "theta", "truth", [])
    return out.select("term", *[r(c).alias(c) for c in ("bias", "variance", "mse")])


@BOOK.add(
    "agg6_mean_over_terms",
    f"""WITH {_EST}, per AS (SELECT event_type, avg(theta - truth) AS bias, var_pop(theta) AS variance, avg((theta - truth) * (theta - truth)) AS mse
    FROM est JOIN truth USING (event_type) GROUP BY 1) SELECT {q("avg(bias)")} AS bias, {q("avg(variance)")} AS variance, {q("avg(mse)")} AS mse FROM per""",
)
def agg6_overall(spark, sf):
    estimates, truth = _estimates(spark, sf)
    per_term = M.replicate_metrics(M.term_errors(estimates, truth), "theta", "truth", [])
    return M.average_over_terms(per_term, []).select(*[r(c).alias(c) for c in ("bias", "variance", "mse")])


@BOOK.add("agg7_term_errors", f"WITH {_EST} SELECT event_type AS term, fold, {q('(theta - truth) * (theta - truth)')} AS sq_error FROM est JOIN truth USING (event_type)")
def agg7(spark, sf):
    return M.term_errors(*_estimates(spark, sf)).select("term", "fold", r("sq_error").alias("sq_error"))


@BOOK.add(
    "agg8_mean_and_error",
    f"""WITH {_EST} SELECT event_type AS term, {q("avg(theta)")} AS mean, {q("stddev_samp(theta) / sqrt(count(theta))")} AS se, 'repeats' AS kind FROM est GROUP BY 1
    UNION ALL SELECT event_type, {q("avg(value)")}, {q("stddev_pop(value) / sqrt(count(value))")}, 'within' FROM events GROUP BY 1""",
)
def agg8(spark, sf):
    repeats = M.mean_and_error(_estimates(spark, sf)[0], "theta", ["term"]).withColumn("kind", F.lit("repeats"))
    within = M.mean_and_error(table(spark, sf, "events").withColumnRenamed("event_type", "term"), "value", ["term"], within=True)
    both = repeats.unionByName(within.withColumn("kind", F.lit("within")))
    return both.select("term", r("mean").alias("mean"), r("se").alias("se"), "kind")


@BOOK.add("agg9_median", f"SELECT event_type, {q('median(value)')} AS median FROM events GROUP BY event_type")
def agg9(spark, sf):
    return exact_median(table(spark, sf, "events"), "value", ["event_type"]).select("event_type", r("median").alias("median"))


_ATT = f"""{_STUDY}, m AS (SELECT setup, rep, abs(avg(CASE WHEN t = 1 THEN tau END) - avg(CASE WHEN t = 1 THEN tau_hat END)) AS att_abs_err,
    sqrt(avg((tau - tau_hat) * (tau - tau_hat))) AS cate_rmse FROM eff GROUP BY setup, rep)"""


@BOOK.add("agg10_effect_metrics", f"WITH {_ATT} SELECT setup, rep, {q('att_abs_err')} AS att_abs_err, {q('cate_rmse')} AS cate_rmse FROM m")
def agg10(spark, sf):
    out = M.effect_metrics(_effects(spark, sf), ["setup", "rep"], "tau", "tau_hat")
    return out.select("setup", "rep", r("att_abs_err").alias("att_abs_err"), r("cate_rmse").alias("cate_rmse"))


@BOOK.add("agg14_importance_weighted_mse", f"SELECT p_type, {q('sum(w * e * e) / sum(w)', 4)} AS iw_mse FROM (SELECT p_type, p_retailprice - 1000.0 AS e, CASE WHEN p_size > 25 THEN 5.0 ELSE 0.2 END AS w FROM part) GROUP BY p_type")
def agg14(spark, sf):
    rows = table(spark, sf, "part").withColumns({"p": F.lit(1000.0), "w": F.when(F.col("p_size") > 25, 5.0).otherwise(0.2)})
    return rows.groupBy("p_type").agg(r(M.importance_weighted_mse("p_retailprice", "p", "w"), 4).alias("iw_mse"))


@BOOK.add("agg27_udf4_weighted_loss", f"SELECT p_type, {q('avg(w * e * e)', 4)} AS loss FROM (SELECT p_type, p_retailprice - 1000.0 AS e, p_size / 50.0 AS w FROM part) GROUP BY p_type")
def agg27(spark, sf):
    rows = table(spark, sf, "part").withColumns({"p": F.lit(1000.0), "w": F.col("p_size") / 50.0})
    custom = {"loss": M.weighted_loss("p_retailprice", "p", "w")}
    return M.metric_table(rows, ["p_type"], **custom).select("p_type", r("loss", 4).alias("loss"))


# Bands of one and two deviations around each type's mean.
_BANDS = f"""b AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1), e AS (SELECT e.*, b.m, b.s, (e.value - b.m) / b.s AS x,
    CAST(floor({u("event_id", 8)} * 4) AS INTEGER) AS rep FROM events e JOIN b ON e.event_type = b.event_type)"""


def _bands(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    stats = events.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    rows = attach(kfold(events, "event_id", 4, 8, "rep"), stats, ["event_type"])
    return rows.withColumns({"x": (F.col("value") - F.col("m")) / F.col("s"), "lo": F.col("m") - F.col("s"), "hi": F.col("m") + F.col("s")})


@BOOK.add("agg15_agg16_coverage_width", f"WITH {_BANDS} SELECT event_type, {q('avg(CASE WHEN value BETWEEN m - s AND m + s THEN 1.0 ELSE 0.0 END)')} AS coverage, {q('avg(2 * s)')} AS width FROM e GROUP BY event_type")
def agg15(spark, sf):
    return _bands(spark, sf).groupBy("event_type").agg(r(M.coverage("value", "lo", "hi")).alias("coverage"), r(M.mean_width("lo", "hi")).alias("width"))


_REP = f"rep AS (SELECT event_type, {_FOLD} AS fold, avg(value) AS score FROM events GROUP BY 1, 2)"


def _scores(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    return kfold(events, "event_id", 10, 8).groupBy("event_type", "fold").agg(F.avg("value").alias("score"))


@BOOK.add(
    "agg20_pick_best",
    f"""WITH {_REP}, s AS (SELECT event_type, fold, round(score, 0) AS score FROM rep), m AS (SELECT event_type, min(score) AS score FROM s GROUP BY 1)
    SELECT s.event_type, min(s.fold) AS fold, {q("min(s.score)")} AS score FROM s JOIN m ON s.event_type = m.event_type AND s.score = m.score GROUP BY 1""",
)
def agg20(spark, sf):
    """Scores are rounded so that ties occur; the smallest index wins."""
    rows = _scores(spark, sf).select("event_type", "fold", F.round("score", 0).alias("score"), (F.col("fold") * 2).alias("parameter"))
    best = M.pick_best(rows, "parameter", "score", "fold", ["event_type"])
    return best.select("event_type", "fold", r("score").alias("score"))


@BOOK.add("agg21_mean_of_means", f"WITH {_REP}, g AS (SELECT fold, round(avg(score), 3) AS score FROM rep GROUP BY fold) SELECT {q('avg(score)')} AS score FROM g")
def agg21(spark, sf):
    per_fold = M.group_means(_scores(spark, sf), ["fold"], ["score"], 3)
    return M.group_means(per_fold, [], ["score"]).select(r("score").alias("score"))


@BOOK.add("agg22_calibration_curve", f"WITH {_REP} SELECT fold AS level, {q('avg(score)')} AS mean, {q('stddev_pop(score)')} AS sd FROM rep GROUP BY fold")
def agg22(spark, sf):
    out = M.curve(_scores(spark, sf).withColumnRenamed("fold", "level"), ["level"], "score")
    return out.select("level", r("mean").alias("mean"), r("sd").alias("sd"))


_TYPES = ("click", "error", "purchase", "signup", "view")


@BOOK.add(
    "agg24_pivot",
    f"WITH {_REP} SELECT fold, {', '.join(f'''{q(f"max(CASE WHEN event_type = '{t}' THEN score END)", 3)} AS {t}''' for t in _TYPES)} FROM rep GROUP BY fold",
)
def agg24(spark, sf):
    return M.wide_table(_scores(spark, sf), "fold", "event_type", _TYPES, "score")


@BOOK.add(
    "agg25_slice_table",
    f"SELECT CAST(floor(p_size / 10) AS BIGINT) AS slice, count(*) AS n, {q('count(*) / (SELECT count(*) FROM part)')} AS share, {q('avg(p_retailprice)', 4)} AS mean_price FROM part GROUP BY 1",
)
def agg25(spark, sf):
    rows = table(spark, sf, "part").select(F.floor(F.col("p_size") / 10).alias("slice"), F.col("p_retailprice").alias("price"))
    out = M.slice_table(rows, "slice", ["price"])
    return out.select("slice", "n", r("share").alias("share"), r("mean_price", 4).alias("mean_price"))


@BOOK.add("agg26_agg29_fold_mean_score", f"WITH f AS (SELECT event_type, {_FOLD} AS fold, avg((value - 10.0) * (value - 10.0)) AS score FROM events GROUP BY 1, 2) SELECT event_type, {q('avg(score)')} AS score FROM f GROUP BY 1")
def agg26(spark, sf):
    rows = kfold(table(spark, sf, "events"), "event_id", 10, 8).withColumn("p", F.lit(10.0))
    return M.fold_mean_score(rows, "fold", M.mse("value", "p"), ["event_type"]).select("event_type", r("score").alias("score"))


@BOOK.add("agg28_srt1_sorted_distinct", "SELECT DISTINCT p_size FROM part")
def agg28(spark, sf):
    return M.sorted_distinct(table(spark, sf, "part"), "p_size")


@BOOK.add(
    "agg23_group_summary",
    f"WITH {_BANDS}, s AS (SELECT event_type, rep, avg(CASE WHEN value BETWEEN m - s AND m + s THEN 1.0 ELSE 0.0 END) AS coverage, avg(2 * s) AS width FROM e GROUP BY 1, 2) {long_sql('s', ['event_type', 'rep'], ['coverage', 'width'])}",
)
def agg23(spark, sf):
    out = M.metric_table(_bands(spark, sf), ["event_type", "rep"], coverage=M.coverage("value", "lo", "hi"), width=M.mean_width("lo", "hi"))
    return long_form(out, ["event_type", "rep"])


@BOOK.add(
    "uq3_region_coverage",
    f"""WITH {_BANDS}, g AS (SELECT event_type, rep, CASE WHEN x >= -1 AND x <= 1 THEN 'interpolation' ELSE 'extrapolation' END AS region,
    avg(CASE WHEN value BETWEEN m - 1.5 * s AND m + 1.5 * s THEN 1.0 ELSE 0.0 END) AS coverage, avg(3 * s) AS length FROM e GROUP BY 1, 2, 3)
    SELECT event_type, region, {q("avg(coverage)")} AS coverage, {q("avg(length)")} AS length FROM g GROUP BY 1, 2""",
)
def uq3(spark, sf):
    from gramwise.operators.intervals import region_coverage

    rows = _bands(spark, sf)
    per = region_coverage(rows, "x", "value", F.col("m") - 1.5 * F.col("s"), F.col("m") + 1.5 * F.col("s"), ["event_type", "rep"])
    out = M.group_means(per, ["event_type", "region"], ["coverage", "length"])
    return out.select("event_type", "region", r("coverage").alias("coverage"), r("length").alias("length"))


@BOOK.add(
    "agg11_accuracy_auc",
    f"""WITH d AS (SELECT c_mktsegment AS g, CASE WHEN c_acctbal > 4000 THEN 1 ELSE 0 END AS y, floor(({u("c_custkey", 3)} * 0.6 + c_acctbal / 25000.0) * 50) / 50.0 AS p FROM customer),
    r AS (SELECT g, y, rank() OVER (PARTITION BY g ORDER BY p) + (count(*) OVER (PARTITION BY g, p) - 1) / 2.0 AS mid FROM d),
    a AS (SELECT g, (sum(CASE WHEN y = 1 THEN mid END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc FROM r GROUP BY g)
    SELECT g, {q("avg(CASE WHEN (CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) = y THEN 1.0 ELSE 0.0 END)")} AS accuracy, {q("any_value(auc)")} AS auc FROM d JOIN a USING (g) GROUP BY g""",
)
def agg11(spark, sf):
    score = F.floor((hash_uniform("c_custkey", 3) * 0.6 + F.col("c_acctbal") / 25000.0) * 50) / 50.0
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("g"), (F.col("c_acctbal") > 4000).cast("int").alias("y"), score.alias("p"))
    return M.accuracy_and_auc(rows, "y", "p", ["g"]).select("g", r("accuracy").alias("accuracy"), r("auc").alias("auc"))
