"""Label shift, confusion tables, discriminant scores and noisy labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from gramwise.catalog.support import DOCUMENTS, Book, documents, newton_chain, q, r, table, u, union_all
from gramwise.functions.hashing import hash_uniform
from gramwise.functions.scalars import logistic
from gramwise.operators import metrics as M
from gramwise.operators.classify import linear_discriminant
from gramwise.operators.encode import standardise
from gramwise.operators.iterate import logistic_regression
from gramwise.operators.moments import covariance_rows, score_with
from gramwise.operators.shift import corrected_prior, reweighted_posterior
from gramwise.plans.noise_study import discriminant_accuracy, grouped_logistic_accuracy

BOOK = Book()

# A made threshold classifier of quality from the document length, and its posterior.
_PRED = f"{DOCUMENTS}, p AS (SELECT doc_id, lang, CAST(y AS INTEGER) AS truth, CASE WHEN x > 6.5 THEN 1 ELSE 0 END AS predicted, 1.0/(1.0+exp(-(x-6.5))) AS p1, has_label FROM docs)"


def _predicted(spark, sf):
    docs = documents(spark, sf)
    return docs.select(
        "doc_id", "lang", "has_label", F.col("y").cast("int").alias("truth"), (F.col("x") > 6.5).cast("int").alias("predicted"), logistic(F.col("x") - 6.5).alias("p1")
    )


@BOOK.add(
    "agg12_confusion_matrix",
    " UNION ALL ".join(
        f"SELECT * FROM (WITH {_PRED} SELECT CAST({t} AS INTEGER) AS true_label, CAST({c} AS INTEGER) AS predicted_label, {q(f'sum(CASE WHEN predicted = {c} THEN 1.0 ELSE 0.0 END) / count(*)')} AS rate FROM p WHERE truth = {t})"
        for t in (0, 1) for c in (0, 1)
    ),
)
def agg12(spark, sf):
    out = M.confusion(_predicted(spark, sf).where("has_label"), "truth", "predicted", [0, 1])
    return out.select("true_label", "predicted_label", r("rate").alias("rate"))


@BOOK.add("agg13_label_shares", f"WITH {_PRED} SELECT lang, predicted, count(*) AS n, {q('count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY lang)')} AS share FROM p GROUP BY lang, predicted")
def agg13(spark, sf):
    out = M.label_shares(_predicted(spark, sf), "predicted", ["lang"])
    return out.select("lang", "predicted", "n", r("share").alias("share"))


_CALIB = u("doc_id", 23) + " < 0.3"
_BBSE = f"""{_PRED}, s AS (SELECT avg(CASE WHEN predicted=1 AND truth=1 THEN 1.0 WHEN truth=1 THEN 0.0 END) FILTER (has_label AND {_CALIB}) AS c11,
  avg(CASE WHEN predicted=1 AND truth=0 THEN 1.0 WHEN truth=0 THEN 0.0 END) FILTER (has_label AND {_CALIB}) AS c10,
  avg(predicted) FILTER (NOT has_label) AS q1, avg(truth) FILTER (has_label) AS s1 FROM p),
 raw AS (SELECT s1, least(greatest((q1 - c10) / (c11 - c10), 1e-6), 1.0) AS t1, least(greatest((c11 - q1) / (c11 - c10), 1e-6), 1.0) AS t0 FROM s),
 prior AS (SELECT s1, 1 - s1 AS s0, t1 / (t0 + t1) AS p1_target, t0 / (t0 + t1) AS p0_target FROM raw)"""


def _marked(spark, sf):
    rows = _predicted(spark, sf)
    calibration = F.col("has_label") & (hash_uniform("doc_id", 23) < 0.3)
    marks = F.array_compact(F.array(F.when(F.col("has_label"), "train").otherwise("target"), F.when(calibration, F.lit("calibration"))))
    return rows.withColumn("marks", marks)


@BOOK.add(
    "shf7_corrected_prior",
    f"WITH {_BBSE} SELECT CAST(1 AS INTEGER) AS label, {q('s1')} AS source, {q('p1_target')} AS target FROM prior UNION ALL SELECT CAST(0 AS INTEGER), {q('s0')}, {q('p0_target')} FROM prior",
)
def shf7(spark, sf):
    out = corrected_prior(_marked(spark, sf), "marks", "truth", "predicted", [0, 1])
    return out.select("label", r("source").alias("source"), r("target").alias("target"))


@BOOK.add(
    "shf7_reweighted_posterior",
    f"WITH {_BBSE} SELECT lang, {q('avg(p1 * p1_target / s1 / (p1 * p1_target / s1 + (1 - p1) * p0_target / s0))')} AS p1 FROM p, prior WHERE NOT has_label GROUP BY lang",
)
def shf7_posterior(spark, sf):
    rows = _marked(spark, sf)
    prior = {x["label"]: x for x in corrected_prior(rows, "marks", "truth", "predicted", [0, 1]).collect()}
    source, target = ([prior[c][k] for c in (0, 1)] for k in ("source", "target"))
    out = rows.where("not has_label").withColumn("p", reweighted_posterior("p1", source, target))
    return out.groupBy("lang").agg(r(F.avg("p")).alias("p1"))


# Balance predicts a market segment; source customers are nations below 13, target ones the rest.
_SHIFT = """c AS (SELECT c_custkey AS id, c_nationkey < 13 AS train, c_acctbal / 1000.0 AS raw, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1.0 ELSE 0.0 END AS y FROM customer),
  k AS (SELECT avg(raw) AS m, stddev_pop(raw) AS d FROM c WHERE train), z AS (SELECT id, train, (raw - m) / d AS x, y, 1.0 AS w FROM c, k), src AS (SELECT * FROM z WHERE train), tgt AS (SELECT * FROM z WHERE NOT train)"""


def _shift_rows(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_nationkey") < 13).alias("train"), (F.col("c_acctbal") / 1000.0).alias("x"),
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY").cast("int").alias("y"),
    )
    return standardise(rows, ["x"], F.col("train"))


@BOOK.add(
    "shf8_baseline_and_upper_bound",
    f"""WITH {_SHIFT}, {newton_chain("src", 9, prefix="s")}, {newton_chain("tgt", 9, prefix="t")}, e AS (SELECT 'source' AS fit, y, 1.0/(1.0+exp(-(a+b*x))) AS p FROM tgt, s_fit UNION ALL SELECT 'target', y, 1.0/(1.0+exp(-(a+b*x))) FROM tgt, t_fit)
    SELECT fit, {q("avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END)")} AS accuracy, {q("avg(p)")} AS mean_p FROM e GROUP BY fit""",
)
def shf8(spark, sf):
    rows = _shift_rows(spark, sf)
    target = rows.where("not train")
    out = []
    for name, train in (("source", rows.where("train")), ("target", target)):
        scored = score_with(target, logistic_regression(train, ["x"], "y"), ["x"], "eta").withColumn("p", logistic("eta"))
        out.append(scored.agg(M.accuracy("y", "p").alias("a"), F.avg("p").alias("m")).select(F.lit(name).alias("fit"), r("a").alias("accuracy"), r("m").alias("mean_p")))
    return union_all(out)


_LDA = f"""d AS (SELECT event_id AS id, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS y, value / 10.0 AS x1, {u("event_id", 31)} AS x2 FROM events),
  n AS (SELECT sum(y) AS n1, count(*) - sum(y) AS n0 FROM d), g AS (SELECT y, avg(x1) AS m1, avg(x2) AS m2, count(*) AS n, sum(x1*x1) AS s11, sum(x1*x2) AS s12, sum(x2*x2) AS s22 FROM d GROUP BY y),
  p AS (SELECT sum(s11 - n*m1*m1)/(sum(n)-2) AS v11, sum(s12 - n*m1*m2)/(sum(n)-2) AS v12, sum(s22 - n*m2*m2)/(sum(n)-2) AS v22, sum(n) AS nn FROM g),
  f AS (SELECT y, (v22*m1 - v12*m2)/(v11*v22-v12*v12) AS b1, (v11*m2 - v12*m1)/(v11*v22-v12*v12) AS b2, m1, m2, ln(n * 1.0 / nn) AS lp FROM g, p),
  w AS (SELECT max(b1) FILTER (y=1) - max(b1) FILTER (y=0) AS b1, max(b2) FILTER (y=1) - max(b2) FILTER (y=0) AS b2,
    sum(CASE WHEN y=1 THEN 1 ELSE -1 END * (lp - 0.5 * (m1*b1 + m2*b2))) AS b0 FROM f)"""


def _lda_rows(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").isin("click", "view").cast("int").alias("y"), (F.col("value") / 10.0).alias("x1"), hash_uniform("event_id", 31).alias("x2")
    )


@BOOK.add("cls1_linear_discriminant", f"WITH {_LDA} SELECT id, {q('1.0/(1.0+exp(-(b0 + b1*x1 + b2*x2)))', 5)} AS p, CASE WHEN b0 + b1*x1 + b2*x2 > 0 THEN 1 ELSE 0 END AS predicted FROM d, w")
def cls1(spark, sf):
    rows = _lda_rows(spark, sf)
    fit = linear_discriminant(rows, ["x1", "x2"], "y")
    return rows.select("id", r(fit.probability(), 5).alias("p"), fit.predicted().alias("predicted"))


@BOOK.add(
    "cls1_class_covariances",
    " UNION ALL ".join(
        f"SELECT label, 'e{i}' AS row_term, 'e{j}' AS col_term, {q(f'covar_samp(CAST(embedding[{i + 1}] AS DOUBLE), CAST(embedding[{j + 1}] AS DOUBLE))')} AS value FROM embeddings GROUP BY label"
        for i in range(3) for j in range(i, 3)
    ),
)
def cls1_covariance(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", *[F.get("embedding", i).cast("double").alias(f"e{i}") for i in range(3)])
    out = covariance_rows(rows, ["e0", "e1", "e2"], ["label"])
    return out.select("label", "row_term", "col_term", r("value").alias("value"))


@BOOK.add("cls1_discriminant_all_dimensions")
def cls1_wide(spark, sf):
    """64 covariates: the Gram comes from matrix products per batch."""
    rows = table(spark, sf, "embeddings")
    xs = [F.get("embedding", i).cast("double") for i in range(64)]
    fit = linear_discriminant(rows.withColumn("y", (F.col("label") < 5).cast("int")), xs, "y")
    return rows.select("vec_id", fit.predicted().alias("predicted"), r(fit.probability(), 5).alias("p"))


_RHOS = (0.0, 0.1, 0.3)
_NOISY = f"""c0 AS (SELECT c_custkey AS id, c_acctbal / 1000.0 AS x, CASE WHEN c_acctbal > 4500 THEN 1 ELSE 0 END AS clean FROM customer),
  c1 AS (SELECT rho, id, x, clean, {u("id", 33)} < 0.7 AS train, CASE WHEN {u("id", 34)} < rho THEN 1 - clean ELSE clean END AS y0 FROM c0, (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.3::DOUBLE)) v(rho)),
  s AS (SELECT rho, x, CAST(y0 AS DOUBLE) AS y, 1.0 AS w FROM c1 WHERE train)"""


def _noisy_rows(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000.0).alias("x"), (F.col("c_acctbal") > 4500).cast("int").alias("clean"), (hash_uniform("c_custkey", 33) < 0.7).alias("train")
    )


@BOOK.add(
    "cls3_noisy_label_discriminant",
    f"""WITH {_NOISY}, g AS (SELECT rho, y, avg(x) AS m, count(*) AS n, sum(x*x) AS ss FROM s GROUP BY 1, 2),
    p AS (SELECT rho, sum(ss - n*m*m)/(sum(n)-2) AS v, sum(n) AS nn FROM g GROUP BY rho),
    f AS (SELECT g.rho, sum(CASE WHEN y=1 THEN 1 ELSE -1 END * (ln(n*1.0/nn) - 0.5*m*m/v)) AS b0, sum(CASE WHEN y=1 THEN 1 ELSE -1 END * m/v) AS b1 FROM g JOIN p USING (rho) GROUP BY g.rho)
    SELECT f.rho, {q("avg(CASE WHEN (b0+b1*x > 0) = (clean = 1) THEN 1.0 ELSE 0.0 END)")} AS accuracy FROM f JOIN c1 ON f.rho = c1.rho AND NOT train GROUP BY f.rho""",
)
def cls3(spark, sf):
    out = discriminant_accuracy(_noisy_rows(spark, sf), "id", ["x"], "clean", "train", _RHOS, 34)
    return out.select("rho", r("accuracy").alias("accuracy"))


# Separable when the labels are clean, so only the noisy settings have a finite logistic fit.
@BOOK.add(
    "cls3_noisy_label_logistic",
    f"""WITH {_NOISY.replace("(VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.3::DOUBLE))", "(VALUES (0.1::DOUBLE), (0.3::DOUBLE))")}, {newton_chain("s", 12, ["rho"])}
    SELECT n_fit.rho, {q("avg(CASE WHEN (a+b*x > 0) = (clean = 1) THEN 1.0 ELSE 0.0 END)")} AS accuracy FROM n_fit JOIN c1 ON n_fit.rho = c1.rho AND NOT train GROUP BY n_fit.rho""",
)
def cls3_logistic(spark, sf):
    out = grouped_logistic_accuracy(_noisy_rows(spark, sf), "id", ["x"], "clean", "train", (0.1, 0.3), 34)
    return out.select("rho", r("accuracy").alias("accuracy"))

