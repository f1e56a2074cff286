"""Covariate shift, boosted trees and sparse paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from gramwise.catalog.support import Book, q, r, table, u
from gramwise.functions.hashing import hash_uniform
from gramwise.operators import shift as H
from gramwise.operators import sparse as X
from gramwise.operators.encode import region_weight
from gramwise.operators.metrics import importance_weighted_mse, mse
from gramwise.plans.shift_study import repeat, summarise
from gramwise.session import scratch_path
from gramwise.sources.readers import read_results
from gramwise.sources.writers import write_results

BOOK = Book()

# Small parts are the source (fit and hold by hash), large ones the target; y is the price, x the size in [0, 1].
_PARTS = f"""p AS (SELECT p_partkey AS id, p_size / 50.0 AS x, (p_retailprice - 1000.0) / 100.0 AS y,
  CASE WHEN p_size > 25 THEN 'target' WHEN {u("p_partkey", 61)} < 0.5 THEN 'fit' ELSE 'hold' END AS part FROM part)"""


def _parts(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("x"), ((F.col("p_retailprice") - 1000.0) / 100.0).alias("y"),
        F.when(F.col("p_size") > 25, "target").when(hash_uniform("p_partkey", 61) < 0.5, "fit").otherwise("hold").alias("part"),
    )


# Two step features of height sqrt(1/2): ridge in closed form for every penalty.
_M = "sum(z1*z1) AS g11, sum(z1*z2) AS g12, sum(z2*z2) AS g22, sum(z1*y) AS b1, sum(z2*y) AS b2, sum(y*y) AS yy, count(*) AS n"
_TWO = f"""{_PARTS}, z AS (SELECT part, y, CASE WHEN x >= 0.25 THEN sqrt(0.5) ELSE 0 END AS z1, CASE WHEN x >= 0.5 THEN sqrt(0.5) ELSE 0 END AS z2 FROM p),
  m AS (SELECT part, {_M} FROM z GROUP BY part), f AS (SELECT * FROM m WHERE part='fit'), h AS (SELECT * FROM m WHERE part='hold'), t AS (SELECT * FROM m WHERE part='target'),
  n AS (SELECT f.n + h.n AS n FROM f, h), lam AS (SELECT CAST(j AS INTEGER) AS idx, 0.1 / n.n * power(2, j) AS l FROM n, range(60) r(j) WHERE j <= greatest(ceil(ln(n.n / 0.1) / ln(2)), 2)),
  imp AS (SELECT ((h.g22+0.1/n.n)*h.b1 - h.g12*h.b2)/((h.g11+0.1/n.n)*(h.g22+0.1/n.n)-h.g12*h.g12) AS i1, ((h.g11+0.1/n.n)*h.b2 - h.g12*h.b1)/((h.g11+0.1/n.n)*(h.g22+0.1/n.n)-h.g12*h.g12) AS i2 FROM h, n),
  th AS (SELECT idx, l, ((f.g22+l)*f.b1 - f.g12*f.b2)/((f.g11+l)*(f.g22+l)-f.g12*f.g12) AS t1, ((f.g11+l)*f.b2 - f.g12*f.b1)/((f.g11+l)*(f.g22+l)-f.g12*f.g12) AS t2 FROM f, lam)"""


@BOOK.add(
    "shf1_agg20_penalty_path",
    f"""WITH {_TWO} SELECT idx, {q("l", 9)} AS lambda, {q("(h.yy - 2*(t1*h.b1+t2*h.b2) + t1*t1*h.g11 + 2*t1*t2*h.g12 + t2*t2*h.g22)/h.n")} AS naive,
    {q("((t1-i1)*(t1-i1)*t.g11 + 2*(t1-i1)*(t2-i2)*t.g12 + (t2-i2)*(t2-i2)*t.g22)/t.n")} AS pseudo, {q("(t.yy - 2*(t1*t.b1+t2*t.b2) + t1*t1*t.g11 + 2*t1*t2*t.g12 + t2*t2*t.g22)/t.n")} AS real FROM th, h, t, imp""",
)
def shf1(spark, sf):
    path = H.penalty_path(_parts(spark, sf), "part", H.step_features("x", [0.25, 0.5]), "y")
    return path.table.select("idx", r("lambda", 9).alias("lambda"), *[r(c).alias(c) for c in ("naive", "pseudo", "real")])


@BOOK.add("mod7_step_feature_ridge")
def mod7(spark, sf):
    """64 step features standing for the min kernel."""
    path = H.penalty_path(_parts(spark, sf), "part", H.step_features("x", [k / 64 for k in range(1, 65)]), "y")
    return path.table.select("idx", *[r(c).alias(c) for c in ("naive", "pseudo", "real")]).withColumn("features", F.lit(64))


@BOOK.add("mod7_fourier_feature_ridge")
def mod7_fourier(spark, sf):
    """32 random cosine features standing for the Gaussian kernel."""
    path = H.penalty_path(_parts(spark, sf), "part", H.fourier_features(["x"], 32, gamma=1.0, seed=5), "y")
    return path.table.select("idx", *[r(c).alias(c) for c in ("naive", "pseudo", "real")]).withColumn("features", F.lit(32))


_ERRORS = """er AS (SELECT idx, (h.yy - 2*(t1*h.b1+t2*h.b2) + t1*t1*h.g11 + 2*t1*t2*h.g12 + t2*t2*h.g22)/h.n AS naive,
  ((t1-i1)*(t1-i1)*t.g11 + 2*(t1-i1)*(t2-i2)*t.g12 + (t2-i2)*(t2-i2)*t.g22)/t.n AS pseudo, (t.yy - 2*(t1*t.b1+t2*t.b2) + t1*t1*t.g11 + 2*t1*t2*t.g12 + t2*t2*t.g22)/t.n AS real FROM th, h, t, imp),
  pick AS (SELECT 'naive' AS method, arg_min(idx, naive) AS idx FROM er UNION ALL SELECT 'pseudo', arg_min(idx, pseudo) FROM er UNION ALL SELECT 'real', arg_min(idx, real) FROM er)"""


@BOOK.add(
    "shf2_excess_risk",
    f"""WITH {_TWO}, {_ERRORS}, e AS (SELECT method, (z.y - t1*z1 - t2*z2) * (z.y - t1*z1 - t2*z2) AS e FROM pick JOIN th USING (idx), z WHERE z.part='target')
    SELECT method, {q("avg(e)")} AS mean, {q("stddev_pop(e) / sqrt(count(*))")} AS se FROM e GROUP BY method""",
)
def shf2(spark, sf):
    rows = _parts(spark, sf)
    path = H.penalty_path(rows, "part", H.step_features("x", [0.25, 0.5]), "y")
    out = H.excess_risk(path.predictions(rows.where(F.col("part") == "target")), "y", ["naive", "pseudo", "real"])
    return out.select("method", r("mean").alias("mean"), r("se").alias("se"))


@BOOK.add(
    "shf2_candidate_risk",
    f"""WITH {_TWO}, e AS (SELECT idx, (z.y - t1*z1 - t2*z2) * (z.y - t1*z1 - t2*z2) AS e FROM th, z WHERE z.part='target' AND idx IN (0, 5, 10))
    SELECT idx, {q("avg(e)")} AS mean, {q("stddev_pop(e) / sqrt(count(*))")} AS se FROM e GROUP BY idx""",
)
def shf2_candidates(spark, sf):
    rows = _parts(spark, sf)
    path = H.penalty_path(rows, "part", H.step_features("x", [0.25, 0.5]), "y")
    out = H.candidate_risk(rows.where(F.col("part") == "target"), "y", path, [0, 5, 10])
    return out.select("idx", r("mean").alias("mean"), r("se").alias("se"))


_GRID = {"maxDepth": [2, 3], "maxIter": [3]}


def _source_target(spark, sf):
    rows = _parts(spark, sf).withColumn("z", F.col("id") % 97 / 97.0)
    return rows.where(F.col("part") != "target"), rows.where(F.col("part") == "target")


@BOOK.add("shf3_tuned_trees")
def shf3(spark, sf):
    source, target = _source_target(spark, sf)
    model, best = H.tuned_trees(source, ["x", "z"], "y", _GRID, folds=2)
    scored = H.tree_predictions(target, model, ["x", "z"], "p")
    return scored.agg(r(mse("y", "p"), 3).alias("mse"), F.count(F.lit(1)).alias("n")).withColumn("depth", F.lit(best["maxDepth"]))


@BOOK.add("shf4_weighted_trees")
def shf4(spark, sf):
    source, target = _source_target(spark, sf)
    weighted = source.withColumn("w", region_weight("x", 5.0, 0.25))
    model, _ = H.tuned_trees(weighted, ["x", "z"], "y", {"maxDepth": [2], "maxIter": [3]}, "w", folds=2)
    return H.tree_predictions(target, model, ["x", "z"], "p").agg(r(mse("y", "p"), 3).alias("mse"), F.count(F.lit(1)).alias("n"))


@BOOK.add("shf5_importance_weighted_evaluation")
def shf5(spark, sf):
    source, _ = _source_target(spark, sf)
    model = H.refit_trees(source.where(F.col("part") == "fit"), ["x", "z"], "y", {"maxDepth": 2, "maxIter": 3})
    rows = H.tree_predictions(source.where(F.col("part") == "hold"), model, ["x", "z"], "p").withColumn("w", F.exp(3.0 * F.col("x")))
    return rows.agg(r(importance_weighted_mse("y", "p", "w"), 3).alias("iw_mse"), F.count(F.lit(1)).alias("n"))


@BOOK.add("shf6_repeated_selection")
def shf6(spark, sf):
    rows = _parts(spark, sf).drop("part")
    features = H.step_features("x", [k / 16 for k in range(1, 17)])
    out = summarise(repeat(rows, "id", ["x"], "y", features, [2.0], [1, 2, 3]))
    return out.select("method", *[r(c).alias(c) for c in ("mean", "se", "lambda")])


# --- sparse paths ----------------------------------------------------------------------------------------

_FOLD = f"CAST(floor({u('event_id', 62)} * 5) AS INTEGER)"
_ONE = f"e AS (SELECT {_FOLD} AS fold, value / 10.0 AS x, (CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.3 END) * value / 10.0 AS y FROM events)"
# MCP on one unit-variance column: soft threshold divided by (1 - 1/3) up to 3 lambda, untouched beyond.
_MCP = "CASE WHEN abs(c) > 3 * l THEN c WHEN abs(c) <= l THEN 0 ELSE sign(c) * (abs(c) - l) / (1 - 1.0/3) END / s"
_LAMBDAS = "lam AS (SELECT CAST(m AS INTEGER) AS idx, abs(c) * power(0.05, m / 49.0) AS l FROM k, range(50) r(m))"


def _single_feature(spark, sf):
    x = F.col("value") / 10.0
    rows = table(spark, sf, "events").select(
        "event_id", F.floor(hash_uniform("event_id", 62) * 5).cast("int").alias("fold"), x.alias("x"), (F.when(F.col("event_type") == "click", 1.0).otherwise(0.3) * x).alias("y")
    )
    return rows


@BOOK.add("spr1_mcp_path", f"WITH {_ONE}, k AS (SELECT sqrt(avg(x*x)) AS s, avg(x*y) / sqrt(avg(x*x)) AS c FROM e), {_LAMBDAS} SELECT idx, {q('l')} AS lambda, {q(_MCP)} AS beta FROM k, lam")
def spr1(spark, sf):
    path = X.mcp_path(_single_feature(spark, sf), ["x"], "y")
    return path.select("idx", r("lambda").alias("lambda"), r(F.get("beta", 0)).alias("beta"))


@BOOK.add(
    "spr2_mcp_cross_validation",
    f"""WITH {_ONE}, k AS (SELECT sqrt(avg(x*x)) AS s, avg(x*y) / sqrt(avg(x*x)) AS c FROM e), {_LAMBDAS},
    f AS (SELECT v.fold, sqrt(avg(x*x)) AS s, avg(x*y) / sqrt(avg(x*x)) AS c FROM e JOIN range(5) v(fold) ON e.fold <> v.fold GROUP BY v.fold),
    b AS (SELECT fold, idx, {_MCP} AS beta FROM f, lam), sc AS (SELECT b.idx, b.fold, avg((y - beta*x)*(y - beta*x)) AS score FROM b JOIN e USING (fold) GROUP BY 1, 2)
    SELECT idx, {q("avg(score)")} AS cv_mse FROM sc GROUP BY idx""",
)
def spr2(spark, sf):
    path, _ = X.mcp_cross_validated(_single_feature(spark, sf), ["x"], "y", "fold")
    return path.select("idx", r("cv_mse").alias("cv_mse"))


@BOOK.add("spr2_mcp_64_covariates")
def spr2_wide(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "label", "embedding", F.floor(hash_uniform("vec_id", 63) * 5).cast("int").alias("fold"))
    xs = [F.get("embedding", i).cast("double") for i in range(64)]
    path, best = X.mcp_cross_validated(rows, xs, F.col("label") - 4.5, "fold")
    return path.select("idx", r("lambda").alias("lambda"), "nonzero", r("cv_mse").alias("cv_mse"), (F.col("idx") == best).alias("chosen"))


@BOOK.add(
    "spr3_distilled_path",
    f"WITH {_ONE.replace('AS y FROM', 'AS unused, 0.7 * value / 10.0 + 0.1 AS y FROM')}, k AS (SELECT sqrt(avg(x*x)) AS s, avg(x*y) / sqrt(avg(x*x)) AS c FROM e), {_LAMBDAS} SELECT idx, {q(_MCP)} AS beta FROM k, lam",
)
def spr3(spark, sf):
    """Stored predictions of another model are the response."""
    rows = _single_feature(spark, sf)
    path = scratch_path(spark, "teacher")
    write_results(rows.select("event_id", "fold", (0.7 * F.col("x") + 0.1).alias("prediction")), path, ["fold"])
    fitted, _ = X.distilled(rows, read_results(spark, path), "event_id", ["x"], "prediction", "fold")
    return fitted.select("idx", r(F.get("beta", 0)).alias("beta"))
