"""Treatment-effect learners, replicated evaluation and user-function surfaces."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import functions as F

from gramwise.catalog.support import STUDY, Book, newton_chain, plane, q, r, study, table, u
from gramwise.functions.hashing import hash_uniform
from gramwise.functions.scalars import logistic
from gramwise.operators import effects as C
from gramwise.operators.metrics import fold_mean_score, mse
from gramwise.operators.moments import least_squares, score_with
from gramwise.operators.sampling import kfold
from gramwise.operators.score import cross_validated_score, fit_groups
from gramwise.plans.effect_benchmark import average_replicates, compare_methods, evaluate_replicates

BOOK = Book()
_P0, _P1, _P2 = plane("x", "t", "y")


def _by_setup(df, digits=5):
    return df.groupBy("setup").agg(F.count(F.lit(1)).alias("n"), r(F.avg("tau_hat"), digits).alias("effect"), r(F.stddev_pop("tau_hat"), digits).alias("spread"))


def _summary(source: str, effect: str = "tau_hat", digits: int = 5) -> str:
    return f"SELECT setup, count(*) AS n, {q(f'avg({effect})', digits)} AS effect, {q(f'stddev_pop({effect})', digits)} AS spread FROM {source} GROUP BY setup"


@BOOK.add("cat1_single_learner", f"WITH {STUDY}, f AS (SELECT setup, {_P2} AS tau_hat FROM study GROUP BY setup) {_summary('study JOIN f USING (setup)')}")
def cat1(spark, sf):
    rows = study(spark, sf)
    return _by_setup(C.single_learner(rows, rows, ["x"], "t", "y", by=["setup"]))


@BOOK.add("cat1_prj14_one_scoring_pass", f"WITH {STUDY} SELECT {q(_P2, 5)} AS effect, count(*) AS n FROM study")
def cat1_unfolded(spark, sf):
    rows = study(spark, sf)
    out = C.single_learner_unfolded(rows, rows, ["id"], ["x"], "t", "y")
    return out.agg(r(F.avg("tau_hat"), 5).alias("effect"), F.count(F.lit(1)).alias("n"))


_ARMS = "m AS (SELECT setup, regr_intercept(y, x) FILTER (t=0) AS a0, regr_slope(y, x) FILTER (t=0) AS b0, regr_intercept(y, x) FILTER (t=1) AS a1, regr_slope(y, x) FILTER (t=1) AS b1 FROM study GROUP BY setup)"


@BOOK.add("cat2_two_learner", f"WITH {STUDY}, {_ARMS}, e AS (SELECT setup, a1 + b1*x - a0 - b0*x AS tau_hat FROM study JOIN m USING (setup)) {_summary('e')}")
def cat2(spark, sf):
    rows = study(spark, sf)
    return _by_setup(C.two_learner(rows, rows, ["x"], "t", "y", by=["setup"]))


_EPROP = newton_chain("s", 9, ["setup"])


@BOOK.add(
    "cat3_cross_learner",
    f"""WITH {STUDY}, {_ARMS}, s AS (SELECT setup, x, CAST(t AS DOUBLE) AS y, 1.0 AS w FROM study), {_EPROP},
    d AS (SELECT setup, t, x, CASE WHEN t=1 THEN y - a0 - b0*x ELSE a1 + b1*x - y END AS d FROM study JOIN m USING (setup)),
    k AS (SELECT setup, regr_intercept(d, x) FILTER (t=0) AS c0, regr_slope(d, x) FILTER (t=0) AS d0, regr_intercept(d, x) FILTER (t=1) AS c1, regr_slope(d, x) FILTER (t=1) AS d1 FROM d GROUP BY setup),
    e AS (SELECT k.setup, 1.0/(1.0+exp(-(a+b*x))) AS e, c0 + d0*x AS t0, c1 + d1*x AS t1 FROM study JOIN k USING (setup) JOIN n_fit USING (setup)) {_summary("e", "e*t0 + (1-e)*t1")}""",
)
def cat3(spark, sf):
    rows = study(spark, sf)
    return _by_setup(C.cross_learner(rows, rows, ["x"], "t", "y", by=["setup"]))


# Two folds by hash; nuisances of a fold come from the other one. e has logistic fits per fold.
_FOLDS = f"""{STUDY}, z AS (SELECT *, CAST(floor({u("id", 41)} * 2) AS INTEGER) AS fold FROM study),
  s AS (SELECT 1 - fold AS fold, x, CAST(t AS DOUBLE) AS y, 1.0 AS w FROM z), {newton_chain("s", 9, ["fold"])},
  m AS (SELECT 1 - fold AS fold, regr_intercept(y, x) AS ma, regr_slope(y, x) AS mb, regr_intercept(y, x) FILTER (t=0) AS a0, regr_slope(y, x) FILTER (t=0) AS b0,
    regr_intercept(y, x) FILTER (t=1) AS a1, regr_slope(y, x) FILTER (t=1) AS b1 FROM z GROUP BY fold),
  o AS (SELECT z.*, 1.0/(1.0+exp(-(n_fit.a+n_fit.b*x))) AS e, ma + mb*x AS m, a0 + b0*x AS m0, a1 + b1*x AS m1 FROM z JOIN m USING (fold) JOIN n_fit USING (fold))"""


@BOOK.add(
    "cat4_doubly_robust_learner",
    f"""WITH {_FOLDS}, p AS (SELECT *, m1 + t*(y-m1)/greatest(e, 0.1) - m0 - (1-t)*(y-m0)/greatest(1-e, 0.1) AS psi FROM o),
    f AS (SELECT regr_intercept(psi, x) AS fa, regr_slope(psi, x) AS fb FROM p) {_summary("(SELECT setup, fa + fb*x AS tau_hat FROM study, f)")}""",
)
def cat4(spark, sf):
    rows = kfold(study(spark, sf), "id", 2, 41)
    return _by_setup(C.doubly_robust_learner(rows, study(spark, sf), ["x"], "t", "y", "fold"))


_FINAL = "g AS (SELECT sum(rt*rt) AS g11, sum(rt*rt*x) AS g12, sum(rt*rt*x*x) AS g22, sum(rt*ry) AS h1, sum(rt*rt*0 + rt*x*ry) AS h2 FROM res), f AS (SELECT (h1*g22-h2*g12)/(g11*g22-g12*g12) AS fa, (h2*g11-h1*g12)/(g11*g22-g12*g12) AS fb FROM g)"


@BOOK.add("cat5_residual_learner", f"WITH {_FOLDS}, res AS (SELECT x, y - m AS ry, t - e AS rt FROM o), {_FINAL} {_summary('(SELECT setup, fa + fb*x AS tau_hat FROM study, f)')}")
def cat5(spark, sf):
    rows = kfold(study(spark, sf), "id", 2, 41)
    return _by_setup(C.residual_learner(rows, study(spark, sf), ["x"], "t", "y", "fold"))


@BOOK.add(
    "cat6_udf3_known_nuisances",
    f"WITH {STUDY}, res AS (SELECT x, y - (240 + x + (1 + 0.1*x) * (0.4 - 0.5)) AS ry, t - 0.4 AS rt FROM study), {_FINAL} {_summary('(SELECT setup, fa + fb*x AS tau_hat FROM study, f)')}",
)
def cat6(spark, sf):
    rows = study(spark, sf)
    out = C.known_nuisance_learner(rows, rows, ["x"], "t", "y", lambda c: 240.0 + c["x"], lambda c: 1.0 + 0.1 * c["x"], lambda c: F.lit(0.4))
    return _by_setup(out)


# A treatment that depends on the balance, so that the propensity is no straight line in it.
_LEAN = f"{STUDY.replace('study AS', 'base AS')}, study AS (SELECT id, setup, rep, x, y, CASE WHEN {u('id', 51)} < 1.0/(1.0+exp(-(x-4))) THEN 1 ELSE 0 END AS t FROM base)"


def _leaning(spark, sf):
    return study(spark, sf).withColumn("t", (hash_uniform("id", 51) < logistic(F.col("x") - 4)).cast("int"))


_R0, _R1, _R2 = plane("x", "e", "y")
_T0, _T1, _T2 = plane("x", "e", "t")


@BOOK.add(
    "cat7_propensity_single_learner",
    f"""WITH {_LEAN}, s AS (SELECT x, CAST(t AS DOUBLE) AS y, 1.0 AS w FROM study), {newton_chain("s", 12)}, z AS (SELECT study.*, 1.0/(1.0+exp(-(a+b*x))) AS e FROM study, n_fit),
    k AS (SELECT {_R0} AS r0, {_R1} AS r1, {_R2} AS r2, {_T0} AS t0, {_T1} AS t1, {_T2} AS t2 FROM z)
    SELECT {q("sum((y - r0 - r1*x - r2*e) * (t - t0 - t1*x - t2*e)) / sum((t - t0 - t1*x - t2*e) * (t - t0 - t1*x - t2*e))", 4)} AS effect, count(*) AS n FROM z, k""",
)
def cat7(spark, sf):
    rows = _leaning(spark, sf)
    out = C.propensity_single_learner(rows, rows, ["x"], "t", "y")
    return out.agg(r(F.avg("tau_hat"), 4).alias("effect"), F.count(F.lit(1)).alias("n"))


@BOOK.add("cat8_propensity_cross_learner")
def cat8(spark, sf):
    rows = _leaning(spark, sf)
    return _by_setup(C.propensity_cross_learner(rows, rows, ["x"], "t", "y"), 3)


@BOOK.add("cat9_model_choice_by_cv")
def cat9(spark, sf):
    rows = study(spark, sf).withColumn("w", 0.5 + hash_uniform("id", 52))
    candidates = {
        "linear": (LinearRegression(), {"regParam": [0.0, 0.1]}),
        "tree": (DecisionTreeRegressor(seed=1), {"maxDepth": [2]}),
    }
    name, _, scores = C.best_by_cv(rows, ["x", "t"], "y", candidates, weight="w")
    return scores.select("candidate", "setting", r("score", 3).alias("score"), (F.col("candidate") == name).alias("chosen"))


_REP_ARMS = "m AS (SELECT setup, rep, regr_intercept(y, x) FILTER (t=0) AS a0, regr_slope(y, x) FILTER (t=0) AS b0, regr_intercept(y, x) FILTER (t=1) AS a1, regr_slope(y, x) FILTER (t=1) AS b1 FROM study GROUP BY 1, 2)"
_EVAL = f"""{STUDY}, {_REP_ARMS}, e AS (SELECT setup, rep, t, 1 + 0.1*x AS tau, a1 + b1*x - a0 - b0*x AS tau_hat FROM study JOIN m USING (setup, rep)),
  k AS (SELECT setup, rep, abs(avg(tau) FILTER (t=1) - avg(tau_hat) FILTER (t=1)) AS att_abs_err, sqrt(avg((tau-tau_hat)*(tau-tau_hat))) AS cate_rmse FROM e GROUP BY 1, 2)"""


def _replicates(spark, sf):
    rows = study(spark, sf).withColumn("tau", 1.0 + 0.1 * F.col("x"))
    methods = {"two": lambda a, b: C.two_learner(a, b, ["x"], "t", "y", by=["setup", "rep"])}
    return evaluate_replicates(rows, methods, ["setup", "rep"], "tau")


@BOOK.add("cat10_replicated_effects", f"WITH {_EVAL} SELECT setup, rep, 'two' AS method, {q('att_abs_err', 5)} AS att_abs_err, {q('cate_rmse', 5)} AS cate_rmse FROM k")
def cat10(spark, sf):
    return _replicates(spark, sf).select("setup", "rep", "method", r("att_abs_err", 5).alias("att_abs_err"), r("cate_rmse", 5).alias("cate_rmse"))


@BOOK.add("cat10_average_over_replicates", f"WITH {_EVAL} SELECT setup, 'two' AS method, {q('avg(att_abs_err)', 5)} AS att_abs_err, {q('avg(cate_rmse)', 5)} AS cate_rmse, count(*) AS replicates FROM k GROUP BY setup")
def cat10_mean(spark, sf):
    out = average_replicates(_replicates(spark, sf), ["setup", "method"])
    return out.select("setup", "method", r("att_abs_err", 5).alias("att_abs_err"), r("cate_rmse", 5).alias("cate_rmse"), "replicates")


@BOOK.add(
    "cat11_method_comparison",
    f"""WITH {STUDY}, z AS (SELECT *, 1 + 0.1*x AS tau, {u("id", 53)} < 0.7 AS train FROM study), f AS (SELECT {_P2} AS single, regr_intercept(y, x) FILTER (t=1) - regr_intercept(y, x) FILTER (t=0) AS da,
    regr_slope(y, x) FILTER (t=1) - regr_slope(y, x) FILTER (t=0) AS db FROM z WHERE train), e AS (SELECT z.*, f.* FROM z, f WHERE NOT train)
    SELECT 'single' AS method, {q("avg((tau-single)*(tau-single))", 4)} AS mse FROM e UNION ALL SELECT 'two', {q("avg((tau-da-db*x)*(tau-da-db*x))", 4)} FROM e""",
)
def cat11(spark, sf):
    rows = study(spark, sf).withColumns({"tau": 1.0 + 0.1 * F.col("x"), "train": hash_uniform("id", 53) < 0.7})
    methods = {
        "single": lambda a, b: C.single_learner(a, b, ["x"], "t", "y"),
        "two": lambda a, b: C.two_learner(a, b, ["x"], "t", "y"),
    }
    return compare_methods(rows.where("train"), rows.where("not train"), methods, "tau").select("method", r("mse", 4).alias("mse"))


# --- user functions ---------------------------------------------------------------------------------------


@BOOK.add("udf2_model_callback_cv", f"WITH {STUDY}, z AS (SELECT *, CAST(floor({u('id', 54)} * 5) AS INTEGER) AS fold FROM study), f AS (SELECT k AS fold, (SELECT regr_intercept(y, x) FROM z WHERE fold <> k) AS a, (SELECT regr_slope(y, x) FROM z WHERE fold <> k) AS b FROM range(5) t(k)), s AS (SELECT fold, avg((y-a-b*x)*(y-a-b*x)) AS score FROM z JOIN f USING (fold) GROUP BY fold) SELECT {q('avg(score)', 4)} AS score FROM s")
def udf2(spark, sf):
    def fit(train):
        fits = least_squares(train, ["x"], "y")
        return lambda rows: score_with(rows, fits, ["x"], "prediction")

    folds = cross_validated_score(study(spark, sf), fit, "id", mse("y", "prediction"), 5, 54)
    return fold_mean_score(folds, "fold", F.avg("score")).select(r("score", 4).alias("score"))


@BOOK.add("udf6_fit_per_group", f"SELECT event_type, {q('regr_intercept(value, hour(ts))', 5)} AS intercept, {q('regr_slope(value, hour(ts))', 5)} AS slope FROM events GROUP BY event_type")
def udf6(spark, sf):
    """A user's fit on one pandas frame per event type."""
    rows = table(spark, sf, "events").select("event_type", "value", F.hour("ts").cast("double").alias("h"))
    schema = "event_type string, intercept double, slope double"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack([np.ones(len(pdf)), pdf["h"]])
        a, b = np.linalg.lstsq(x, pdf["value"].to_numpy(), rcond=None)[0]
        return pd.DataFrame({"event_type": [pdf["event_type"].iloc[0]], "intercept": [a], "slope": [b]})

    out = fit_groups(rows, ["event_type"], fit, schema)
    return out.select("event_type", r("intercept", 5).alias("intercept"), r("slope", 5).alias("slope"))


@BOOK.add("udf6_fit_per_group_from_moments", f"SELECT event_type, {q('regr_intercept(value, hour(ts))', 5)} AS intercept, {q('regr_slope(value, hour(ts))', 5)} AS slope FROM events GROUP BY event_type")
def udf6_moments(spark, sf):
    """The same fits for groups of any size: sums within tasks, no group in one frame."""
    rows = table(spark, sf, "events").select("event_type", "value", F.hour("ts").cast("double").alias("h"))
    fits = least_squares(rows, ["h"], "value", by=["event_type"])
    return fits.select("event_type", r(F.get("theta", 0), 5).alias("intercept"), r(F.get("theta", 1), 5).alias("slope"))
