"""Linear, logistic and quantile fits, and their semi-supervised versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gramwise.catalog.support import DOCUMENTS, STUDY, Book, documents, newton_chain, plane, q, r, study, u, weighted_line
from gramwise.functions.hashing import hash_uniform
from gramwise.operators import iterate as I
from gramwise.operators import semisup as P
from gramwise.operators.moments import coefficient_rows, least_squares
from gramwise.operators.ranks import attach
from gramwise.operators.sampling import kfold
from gramwise.operators.sliced import bandwidth_errors, sliced_semisupervised
from gramwise.plans.semisup_study import coefficients_by_seed, compare, status_counts

BOOK = Book()


def _terms(fits, names, digits=6):
    rows = coefficient_rows(fits, names)
    keep = [c for c in rows.columns if c not in ("n", "status", "iterations", "idx", "theta")]
    return rows.select(*keep, r("theta", digits).alias("theta"))


def _vector(spark, names, theta, digits=6):
    return _terms(I.fit_frame(spark, theta), names, digits)


def _line_sql(source: str, a: str, b: str, keys: str = "", name: str = "x", digits: int = 6) -> str:
    return f"SELECT {keys}'intercept' AS term, {q(a, digits)} AS theta FROM {source} UNION ALL SELECT {keys}'{name}' AS term, {q(b, digits)} AS theta FROM {source}"


_P0, _P1, _P2 = plane("x", "t", "y")


@BOOK.add("mod1_least_squares", f"WITH {STUDY}, f AS (SELECT setup, {_P0} AS a, {_P1} AS b, {_P2} AS c FROM study GROUP BY setup) {_line_sql('f', 'a', 'b', 'setup, ')} UNION ALL SELECT setup, 't', {q('c')} FROM f")
def mod1(spark, sf):
    return _terms(least_squares(study(spark, sf), ["x", "t"], "y", by=["setup"]), ["x", "t"])


_SLOPE, _ICPT = weighted_line("w")


@BOOK.add("mod1_signed_weights", f"WITH {STUDY}, s AS (SELECT *, {u('id', 12)} - 0.2 AS w FROM study), f AS (SELECT setup, {_ICPT} AS a, {_SLOPE} AS b FROM s GROUP BY setup) {_line_sql('f', 'a', 'b', 'setup, ')}")
def mod1_weighted(spark, sf):
    rows = study(spark, sf).withColumn("w", hash_uniform("id", 12) - 0.2)
    return _terms(least_squares(rows, ["x"], "y", "w", ["setup"]), ["x"])


_LAB = f"{DOCUMENTS}, s AS (SELECT *, 1.0::DOUBLE AS w FROM docs WHERE has_label)"


@BOOK.add("mod2_logistic", f"WITH {_LAB}, {newton_chain('s')} {_line_sql('n_fit', 'a', 'b')}")
def mod2(spark, sf):
    return _terms(I.logistic_regression(documents(spark, sf).where("has_label"), ["x"], "y"), ["x"])


@BOOK.add("mod2_logistic_by_group", f"WITH {STUDY}, s AS (SELECT setup, x, CAST(t AS DOUBLE) AS y, 0.5 + {u('id', 13)} AS w FROM study), {newton_chain('s', 9, ['setup'])} {_line_sql('n_fit', 'a', 'b', 'setup, ')}")
def mod2_grouped(spark, sf):
    rows = study(spark, sf).withColumn("w", 0.5 + hash_uniform("id", 13))
    return _terms(I.logistic_regression(rows, ["x"], "t", "w", ["setup"]), ["x"])


@BOOK.add("mod4_signed_newton", f"WITH {STUDY}, s AS (SELECT x, CAST(t AS DOUBLE) AS y, {u('id', 14)} - 0.1 AS w FROM study), {newton_chain('s', 9)} {_line_sql('n_fit', 'a', 'b')}")
def mod4(spark, sf):
    rows = study(spark, sf).withColumn("w", hash_uniform("id", 14) - 0.1)
    return _terms(I.logistic_regression(rows, ["x"], "t", "w", start="linear"), ["x"])


def _descent_chain(source: str, steps: int, rate: float, slope: str) -> str:
    """CTEs of unrolled descent steps from (0, 0); ``slope`` is the loss derivative in the linear predictor e."""
    parts = ["d0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for k in range(steps):
        parts.append(
            f"d{k + 1} AS MATERIALIZED (SELECT any_value(a) - {rate} * avg(w * g) AS a, any_value(b) - {rate} * avg(w * g * x) AS b FROM "
            f"(SELECT s.*, t.a, t.b, {slope} AS g FROM (SELECT s.*, t.a + t.b * s.x AS e FROM {source} s, d{k} t) s, d{k} t))"
        )
    return ", ".join(parts)


@BOOK.add("mod5_descent_logistic", f"WITH {STUDY}, s AS (SELECT x, CAST(t AS DOUBLE) AS y, {u('id', 14)} - 0.1 AS w FROM study), {_descent_chain('s', 10, 0.05, '1.0/(1.0+exp(-e)) - y')} {_line_sql('d10', 'a', 'b')}")
def mod5(spark, sf):
    rows = study(spark, sf).withColumn("w", hash_uniform("id", 14) - 0.1)
    theta, _, _ = I.gradient_descent(rows, ["x"], "t", [0.0, 0.0], 0.05, "logistic", "w", max_iter=10)
    return _vector(spark, ["x"], theta)


@BOOK.add("mod5_descent_quantile", f"WITH {STUDY}, s AS (SELECT x, y, 1.0 AS w FROM study), {_descent_chain('s', 6, 20.0, 'CASE WHEN y <= e THEN 0.5 ELSE -0.5 END')} {_line_sql('d6', 'a', 'b')}")
def mod5_quantile(spark, sf):
    theta, _, _ = I.gradient_descent(study(spark, sf), ["x"], "y", [0.0, 0.0], 20.0, "quantile", max_iter=6)
    return _vector(spark, ["x"], theta)


@BOOK.add("mod6_loss_scores", f"WITH {STUDY}, s AS (SELECT setup, CASE WHEN y <= 200 + 2 * x THEN 0.75 ELSE -0.25 END AS g, x FROM study) SELECT setup, {q('avg(g)')} AS s0, {q('avg(g * x)')} AS s1 FROM s GROUP BY setup")
def mod6(spark, sf):
    s0, s1 = I.score_vector("y", 200 + 2 * F.col("x"), ["x"], "quantile", 0.25)
    return study(spark, sf).groupBy("setup").agg(r(F.avg(s0)).alias("s0"), r(F.avg(s1)).alias("s1"))


@BOOK.add("mod3_quantile_intercept_only", f"WITH {STUDY} SELECT setup, {q('quantile_disc(y, 0.25)')} AS quantile FROM study GROUP BY setup")
def mod3_intercept(spark, sf):
    return I.weighted_quantile(study(spark, sf), "y", 0.25, by=["setup"]).select("setup", r("quantile").alias("quantile"))


@BOOK.add("mod3_quantile_regression")
def mod3(spark, sf):
    rows = study(spark, sf)
    theta, status = I.quantile_regression(rows, ["x", "t"], "y", 0.25)
    gap = I.subgradient(rows, ["x", "t"], "y", theta, 0.25)
    out = _vector(spark, ["x", "t"], theta, 4)
    return out.withColumn("status", F.lit(status)).withColumn("largest_subgradient", F.lit(float(abs(gap).max())))


# --- labelled and unlabelled documents -------------------------------------------------------------------

# Calibration weights on (x, x^2): c1 + (1 - c1)(1 + (mean_U - mean_L)' C^-1 (z - mean_L)).
_CAL = f"""{DOCUMENTS}, m AS (SELECT count(*) FILTER (has_label) AS n, count(*) FILTER (NOT has_label) AS nu,
  avg(x) FILTER (has_label) AS l1, avg(x*x) FILTER (has_label) AS l2, avg(x) FILTER (NOT has_label) AS u1, avg(x*x) FILTER (NOT has_label) AS u2,
  var_pop(x) FILTER (has_label) AS v1, var_pop(x*x) FILTER (has_label) AS v2, covar_pop(x, x*x) FILTER (has_label) AS v12 FROM docs),
k AS (SELECT *, n * 1.0 / (n + nu) AS c1, ((u1-l1)*v2-(u2-l2)*v12)/(v1*v2-v12*v12) AS b1, ((u2-l2)*v1-(u1-l1)*v12)/(v1*v2-v12*v12) AS b2 FROM m),
s AS (SELECT doc_id, lang, x, y, c1 + (1 - c1) * (1 + b1*(x-l1) + b2*(x*x-l2)) AS w FROM docs, k WHERE has_label)"""


@BOOK.add("ssl1_calibration_weights", f"WITH {_CAL} SELECT doc_id, {q('w')} AS w FROM s")
def ssl1(spark, sf):
    docs = documents(spark, sf)
    cal = P.calibration(docs, ["x"], "has_label", order=2)
    return docs.where("has_label").select("doc_id", r(cal.weight).alias("w"))


@BOOK.add("ssl2_calibrated_linear", f"WITH {_CAL}, f AS (SELECT {_ICPT} AS a, {_SLOPE} AS b FROM s) {_line_sql('f', 'a', 'b')}")
def ssl2(spark, sf):
    fit, _ = P.calibrated_fit(documents(spark, sf), ["x"], "y", "has_label", order=2)
    return _terms(fit, ["x"])


@BOOK.add("ssl2_calibrated_logistic", f"WITH {_CAL}, {newton_chain('s')} {_line_sql('n_fit', 'a', 'b', digits=5)}")
def ssl2_logistic(spark, sf):
    fit, _ = P.calibrated_fit(documents(spark, sf), ["x"], "y", "has_label", order=2, loss="logistic")
    return _terms(fit, ["x"], 5)


@BOOK.add("ssl2_calibrated_quantile")
def ssl2_quantile(spark, sf):
    rows = study(spark, sf).withColumn("has_label", hash_uniform("id", 15) < 0.2)
    fit, _ = P.calibrated_fit(rows, ["x"], "y", "has_label", order=2, loss="quantile", tau=0.5)
    return _terms(fit, ["x"], 4)


def _sandwich_sql(theta: str, factor: str, logistic: bool = False) -> str:
    """CTEs of the cross-fitted errors on the basis (1, x): ``theta`` is a relation (a, b), the result se(s0, s1)."""
    p = "1.0/(1.0+exp(-(a+b*x)))" if logistic else "(a+b*x)"
    c = f"{p}*(1-{p})" if logistic else "1.0"
    w = [f"(s{i} - f*(oa{i} + ob{i}*x))" for i in (0, 1)]
    w2 = [f"(f*(ta{i} + tb{i}*x))" for i in (0, 1)]
    pairs = ((0, 0), (0, 1), (1, 1))
    return f"""fl AS (SELECT doc_id, x, y, has_label, CAST(floor({u("doc_id", 16)} * 5) AS INTEGER) AS fold FROM docs),
  nn AS (SELECT count(*) FILTER (has_label) AS n, count(*) FILTER (NOT has_label) AS nu, {factor} AS f FROM fl),
  sc AS (SELECT x, fold, {p} - y AS s0, ({p} - y)*x AS s1 FROM fl, {theta} WHERE has_label),
  ak AS (SELECT k.fold, regr_intercept(s0, x) AS oa0, regr_slope(s0, x) AS ob0, regr_intercept(s1, x) AS oa1, regr_slope(s1, x) AS ob1 FROM sc JOIN range(5) k(fold) ON sc.fold <> k.fold GROUP BY k.fold),
  al AS (SELECT regr_intercept(s0, x) AS ta0, regr_slope(s0, x) AS tb0, regr_intercept(s1, x) AS ta1, regr_slope(s1, x) AS tb1 FROM sc),
  v1 AS (SELECT {", ".join(f"avg({w[i]} * {w[j]}) AS v{i}{j}" for i, j in pairs)} FROM sc JOIN ak USING (fold), nn),
  v2 AS (SELECT {", ".join(f"avg({w2[i]} * {w2[j]}) AS v{i}{j}" for i, j in pairs)}, avg({c}) AS h0, avg({c}*x) AS h1, avg({c}*x*x) AS h2 FROM fl, al, nn, {theta} WHERE NOT has_label),
  vv AS (SELECT n, v1.v00 + n*1.0/nu*v2.v00 AS c00, v1.v01 + n*1.0/nu*v2.v01 AS c01, v1.v11 + n*1.0/nu*v2.v11 AS c11, h2/(h0*h2-h1*h1) AS i00, -h1/(h0*h2-h1*h1) AS i01, h0/(h0*h2-h1*h1) AS i11 FROM v1, v2, nn),
  se AS (SELECT sqrt((i00*i00*c00 + 2*i00*i01*c01 + i01*i01*c11)/n) AS s0, sqrt((i01*i01*c00 + 2*i01*i11*c01 + i11*i11*c11)/n) AS s1 FROM vv)"""


_CAL1 = f"""{DOCUMENTS}, m AS (SELECT count(*) FILTER (has_label) * 1.0 / count(*) AS c1, avg(x) FILTER (has_label) AS l1, avg(x) FILTER (NOT has_label) AS u1, var_pop(x) FILTER (has_label) AS v1 FROM docs),
s AS (SELECT x, y, c1 + (1 - c1) * (1 + (u1 - l1) / v1 * (x - l1)) AS w FROM docs, m WHERE has_label), th AS (SELECT {_ICPT} AS a, {_SLOPE} AS b FROM s)"""


@BOOK.add("ssl3_standard_errors", f"WITH {_CAL1}, {_sandwich_sql('th', 'count(*) FILTER (NOT has_label) * 1.0 / count(*)')} {_line_sql('se', 's0', 's1').replace('AS theta', 'AS se')}")
def ssl3(spark, sf):
    docs = kfold(documents(spark, sf), "doc_id", 5, 16)
    fit, _ = P.calibrated_fit(docs, ["x"], "y", "has_label", order=1)
    theta = fit.first()["theta"]
    se = P.sandwich_errors(docs, ["x"], "y", "has_label", "fold", theta, 1)
    return _vector(spark, ["x"], se).withColumnRenamed("theta", "se")


@BOOK.add("ssl3_standard_errors_logistic", f"WITH {_CAL1.split(', th AS')[0]}, {newton_chain('s', 12)}, {_sandwich_sql('n_fit', 'count(*) FILTER (NOT has_label) * 1.0 / count(*)', True)} {_line_sql('se', 's0', 's1', digits=5).replace('AS theta', 'AS se')}")
def ssl3_logistic(spark, sf):
    docs = kfold(documents(spark, sf), "doc_id", 5, 16)
    fit, _ = P.calibrated_fit(docs, ["x"], "y", "has_label", order=1, loss="logistic")
    se = P.sandwich_errors(docs, ["x"], "y", "has_label", "fold", fit.first()["theta"], 1, "logistic")
    return _vector(spark, ["x"], se, 5).withColumnRenamed("theta", "se")


@BOOK.add("ssl3_standard_errors_quantile")
def ssl3_quantile(spark, sf):
    rows = kfold(study(spark, sf).withColumn("has_label", hash_uniform("id", 15) < 0.2), "id", 5, 16)
    fit, _ = P.calibrated_fit(rows, ["x"], "y", "has_label", order=1, loss="quantile")
    se = P.sandwich_errors(rows, ["x"], "y", "has_label", "fold", fit.first()["theta"], 1, "quantile", 0.5, draws=500)
    return _vector(spark, ["x"], se, 4).withColumnRenamed("theta", "se")


@BOOK.add("ssl4_order_selection")
def ssl4(spark, sf):
    docs = documents(spark, sf).withColumn("half", (hash_uniform("doc_id", 17) < 0.5).cast("int"))
    best, criteria = P.choose_order(docs, ["x"], "y", "has_label", "half", 3)
    return criteria.select("order", r("criterion").alias("criterion"), (F.col("order") == best).alias("chosen"))


@BOOK.add(
    "ssl5_ridge_guard",
    f"""WITH {STUDY}, m AS (SELECT count(*) + 10.0 AS g11, sum(x) AS g12, sum(x*x) + 10.0 AS g22, sum(y) AS b1, sum(x*y) AS b2 FROM study),
    f AS (SELECT (b1*g22-b2*g12)/(g11*g22-g12*g12) AS a, (b2*g11-b1*g12)/(g11*g22-g12*g12) AS b FROM m) {_line_sql("f", "a", "b")}""",
)
def ssl5(spark, sf):
    return _terms(least_squares(study(spark, sf), ["x"], "y", ridge=10.0), ["x"])


_PI0, _PI1, _PI2 = plane("u", "v", "rj")


@BOOK.add(
    "ssl6_partial_information",
    f"""WITH {DOCUMENTS}, m AS (SELECT avg(x) AS mx, var_pop(x) AS vx FROM docs), s AS (SELECT x, y, (x - mx) / vx AS u, x * (x - mx) / vx - 1 AS v, y * (x - mx) / vx AS rj FROM docs, m WHERE has_label),
    f AS (SELECT avg(y) - {_PI0} * avg(x) AS a, {_PI0} AS b FROM s) {_line_sql("f", "a", "b")}""",
)
def ssl6(spark, sf):
    return _vector(spark, ["x"], P.partial_information(documents(spark, sf), ["x"], "y", "has_label"))


@BOOK.add("ssl7_sliced_estimator")
def ssl7(spark, sf):
    docs = documents(spark, sf).withColumns({"x2": F.length("source").cast("double") + hash_uniform("doc_id", 19), "x": F.col("x")})
    rows = kfold(docs, "doc_id", 2, 18)
    fits = sliced_semisupervised(rows, "doc_id", ["x", "x2"], "y", "has_label", "fold", 2, slices=2, directions=1, grid=(0.5, 1.0))
    parts = [_vector(spark, ["x", "x2"], v).withColumn("method", F.lit(k)) for k, v in fits.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@BOOK.add(
    "ssl8_bandwidth_cv",
    f"""WITH {DOCUMENTS}, s AS (SELECT doc_id, x, y, CAST(floor({u("doc_id", 18)} * 4) AS INTEGER) AS fold FROM docs WHERE has_label),
    h AS (SELECT * FROM (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) v(h)),
    p AS (SELECT h.h, a.doc_id, any_value(a.y) AS y, sum(exp(-(a.x-b.x)*(a.x-b.x)/(2*h.h*h.h)) / sqrt(2*pi()) * b.y) AS top, sum(exp(-(a.x-b.x)*(a.x-b.x)/(2*h.h*h.h)) / sqrt(2*pi())) AS bottom
      FROM s a JOIN s b ON a.fold <> b.fold, h GROUP BY h.h, a.doc_id)
    SELECT h, {q("sum((y - top / (bottom + 1e-6)) * (y - top / (bottom + 1e-6)))", 5)} AS error FROM p GROUP BY h""",
)
def ssl8(spark, sf):
    docs = kfold(documents(spark, sf).where("has_label"), "doc_id", 4, 18)
    out = bandwidth_errors(docs, "doc_id", F.array("x"), "y", "fold", [0.1, 0.5, 1.0, 2.0], 1)
    return out.select("h", r("error", 5).alias("error"))


def _ratio_chain(steps: int) -> str:
    """CTEs of unrolled moment-matching steps on the basis (1, x); the last is ratio(a, b)."""
    parts = ["r0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for k in range(steps):
        name = "ratio" if k + 1 == steps else f"r{k + 1}"
        parts.append(
            f"{name} AS MATERIALIZED (SELECT a-((h22*(h11-1)-h12*(h12-u1))/(h11*h22-h12*h12)) AS a, b-((h11*(h12-u1)-h12*(h11-1))/(h11*h22-h12*h12)) AS b FROM "
            f"(SELECT any_value(t.a) AS a, any_value(t.b) AS b, avg(exp(t.a+t.b*x)) AS h11, avg(exp(t.a+t.b*x)*x) AS h12, avg(exp(t.a+t.b*x)*x*x) AS h22 FROM lab, r{k} t), mu)"
        )
    return ", ".join(parts)


_RATIO = f"{DOCUMENTS}, lab AS (SELECT * FROM docs WHERE has_label), mu AS (SELECT avg(x) AS u1 FROM docs WHERE NOT has_label), {_ratio_chain(12)}, s AS (SELECT x, y, exp(a + b * x) AS w FROM lab, ratio)"


@BOOK.add("ssl9_density_ratio_linear", f"WITH {_RATIO}, f AS (SELECT {_ICPT} AS a, {_SLOPE} AS b FROM s) {_line_sql('f', 'a', 'b', digits=5)}")
def ssl9(spark, sf):
    fit, _ = P.density_ratio_fit(documents(spark, sf), ["x"], "y", "has_label")
    return _terms(fit, ["x"], 5)


@BOOK.add("ssl9_density_ratio_logistic", f"WITH {_RATIO}, {newton_chain('s')} {_line_sql('n_fit', 'a', 'b', digits=4)}")
def ssl9_logistic(spark, sf):
    fit, _ = P.density_ratio_fit(documents(spark, sf), ["x"], "y", "has_label", loss="logistic")
    return _terms(fit, ["x"], 4)


@BOOK.add("ssl10_density_ratio_errors", f"WITH {_RATIO}, th AS (SELECT {_ICPT} AS a, {_SLOPE} AS b FROM s), {_sandwich_sql('th', '1.0')} {_line_sql('se', 's0', 's1', digits=5).replace('AS theta', 'AS se')}")
def ssl10(spark, sf):
    docs = kfold(documents(spark, sf), "doc_id", 5, 16)
    fit, _ = P.density_ratio_fit(docs, ["x"], "y", "has_label")
    se = P.sandwich_errors(docs, ["x"], "y", "has_label", "fold", fit.first()["theta"], 1, factor=1.0)
    return _vector(spark, ["x"], se, 5).withColumnRenamed("theta", "se")


# Imputer: the mean label per language among labelled documents.
_IMP = f"{DOCUMENTS}, g AS (SELECT lang, avg(y) AS h FROM docs WHERE has_label GROUP BY lang), i AS (SELECT docs.*, g.h FROM docs JOIN g USING (lang))"
_VARIANTS = """v AS (SELECT 'supervised' AS variant, x, y AS z FROM i WHERE has_label UNION ALL SELECT 'imputed', x, CASE WHEN has_label THEN y ELSE h END FROM i
  UNION ALL SELECT 'train', x, h FROM i WHERE has_label UNION ALL SELECT 'every', x, h FROM i)"""
_DEBIASED = """w AS (SELECT max(a) FILTER (variant='supervised') AS sa, max(b) FILTER (variant='supervised') AS sb, max(a) FILTER (variant='imputed') AS ia, max(b) FILTER (variant='imputed') AS ib,
  max(a) FILTER (variant='train') AS ta, max(b) FILTER (variant='train') AS tb, max(a) FILTER (variant='every') AS ea, max(b) FILTER (variant='every') AS eb FROM f),
o AS (SELECT 'supervised' AS method, sa AS a, sb AS b FROM w UNION ALL SELECT 'imputed', ia, ib FROM w UNION ALL SELECT 'debiased', ea - (ta - sa), eb - (tb - sb) FROM w)"""


def imputed_documents(spark, sf):
    docs = documents(spark, sf)
    means = docs.where("has_label").groupBy("lang").agg(F.avg("y").alias("h"))
    return attach(docs, means, ["lang"])


@BOOK.add("ssl11_ssl12_debiased_linear", f"WITH {_IMP}, {_VARIANTS}, f AS (SELECT variant, regr_intercept(z, x) AS a, regr_slope(z, x) AS b FROM v GROUP BY variant), {_DEBIASED} {_line_sql('o', 'a', 'b', 'method, ')}")
def ssl12(spark, sf):
    return _terms(P.debiased_linear(imputed_documents(spark, sf), ["x"], "y", "h", "has_label"), ["x"])


@BOOK.add("ssl12_debiased_logistic", f"WITH {_IMP}, {_VARIANTS}, s AS (SELECT variant, x, z AS y, 1.0 AS w FROM v), {newton_chain('s', 12, ['variant'])}, f AS (SELECT * FROM n_fit), {_DEBIASED} {_line_sql('o', 'a', 'b', 'method, ', digits=5)}")
def ssl12_logistic(spark, sf):
    return _terms(P.debiased_logistic(imputed_documents(spark, sf), ["x"], "y", "h", "has_label"), ["x"], 5)


@BOOK.add("ssl12_debiased_quantile")
def ssl12_quantile(spark, sf):
    rows = study(spark, sf).withColumns({"has_label": hash_uniform("id", 15) < 0.2, "h": 240.0 + 3.0 * F.col("x") + 20.0 * hash_uniform("id", 20)})
    return _terms(P.debiased_quantile(rows, ["x"], "y", "h", "has_label", 0.5), ["x"], 4)


@BOOK.add("ssl13_full_data_truth", f"WITH {STUDY}, f AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM study) {_line_sql('f', 'a', 'b')}")
def ssl13(spark, sf):
    return _terms(least_squares(study(spark, sf), ["x"], "y"), ["x"])


_SEEDS = (1, 2, 3)
_CAL_LINE_S, _CAL_LINE_I = weighted_line("w")
_STUDY_SEEDS = f"""{STUDY}, n AS (SELECT CAST(floor(10 * count(*) / 100) AS BIGINT) AS k FROM study),
z AS (SELECT s.*, seed, row_number() OVER (PARTITION BY seed ORDER BY {u("id", "seed")}, id) <= (SELECT k FROM n) AS lab FROM study s, (VALUES (1), (2), (3)) g(seed)),
p AS (SELECT seed, {_P0} AS p0, {_P1} AS p1, {_P2} AS p2 FROM z WHERE lab GROUP BY seed), i AS (SELECT z.*, p0 + p1 * x + p2 * t AS h FROM z JOIN p USING (seed)),
v AS (SELECT seed, 'supervised' AS variant, x, y AS r FROM i WHERE lab UNION ALL SELECT seed, 'imputed', x, CASE WHEN lab THEN y ELSE h END FROM i UNION ALL SELECT seed, 'train', x, h FROM i WHERE lab UNION ALL SELECT seed, 'every', x, h FROM i),
f AS (SELECT seed, variant, regr_intercept(r, x) AS a, regr_slope(r, x) AS b FROM v GROUP BY 1, 2),
w AS (SELECT seed, max(a) FILTER (variant='supervised') AS sa, max(b) FILTER (variant='supervised') AS sb, max(a) FILTER (variant='imputed') AS ia, max(b) FILTER (variant='imputed') AS ib,
  max(a) FILTER (variant='train') AS ta, max(b) FILTER (variant='train') AS tb, max(a) FILTER (variant='every') AS ea, max(b) FILTER (variant='every') AS eb FROM f GROUP BY seed),
c AS (SELECT seed, count(*) FILTER (lab) * 1.0 / count(*) AS c1, avg(x) FILTER (lab) AS l1, avg(x) FILTER (NOT lab) AS u1, var_pop(x) FILTER (lab) AS v1 FROM i GROUP BY seed),
cw AS (SELECT i.seed, i.x, i.y, c1 + (1 - c1) * (1 + (u1 - l1) / v1 * (i.x - l1)) AS w FROM i JOIN c USING (seed) WHERE lab),
cf AS (SELECT seed, {_CAL_LINE_I} AS a, {_CAL_LINE_S} AS b FROM cw GROUP BY seed),
o AS (SELECT seed, 'supervised' AS method, sa AS a, sb AS b FROM w UNION ALL SELECT seed, 'imputed', ia, ib FROM w UNION ALL SELECT seed, 'debiased', ea - (ta - sa), eb - (tb - sb) FROM w UNION ALL SELECT seed, 'calibrated', a, b FROM cf),
truth AS (SELECT regr_intercept(y, x) AS ta, regr_slope(y, x) AS tb FROM study)"""


@BOOK.add(
    "ssl14_comparison_over_seeds",
    f"""WITH {_STUDY_SEEDS} SELECT method, 'intercept' AS term, {q("avg((a-ta)*(a-ta))", 5)} AS mse, count(*) AS fits FROM o, truth GROUP BY method
    UNION ALL SELECT method, 'x', {q("avg((b-tb)*(b-tb))", 5)}, count(*) FROM o, truth GROUP BY method""",
)
def ssl14(spark, sf):
    out = compare(study(spark, sf), "id", ["x"], "y", ["x", "t"], _SEEDS, 10)
    return out.select("method", "term", r("mse", 5).alias("mse"), "fits")


@BOOK.add("ssl14_coefficients", f"WITH {_STUDY_SEEDS} {_line_sql('o', 'a', 'b', 'CAST(seed AS INTEGER) AS seed, method, ', digits=5)}")
def ssl14_coefficients(spark, sf):
    return _terms(coefficients_by_seed(study(spark, sf), "id", ["x"], "y", ["x", "t"], _SEEDS, 10), ["x"], 5)


_LOGIT_SEEDS = f"""{STUDY}, n AS (SELECT CAST(floor(30 * count(*) / 100) AS BIGINT) AS k FROM study),
z AS (SELECT s.x, s.y / 250.0 AS v, CAST(s.t AS DOUBLE) AS y, seed, row_number() OVER (PARTITION BY seed ORDER BY {u("id", "seed")}, id) <= (SELECT k FROM n) AS lab FROM study s, (VALUES (1), (2)) g(seed)),
li AS (SELECT seed, v, y, 1.0 AS w FROM z WHERE lab), {newton_chain("li", 8, ["seed"], x="v", prefix="i")}, i AS (SELECT z.*, 1.0/(1.0+exp(-(a+b*v))) AS h FROM z JOIN i_fit USING (seed)),
vs AS (SELECT seed, 'supervised' AS variant, x, y, 1.0 AS w FROM i WHERE lab UNION ALL SELECT seed, 'imputed', x, CASE WHEN lab THEN y ELSE h END, 1.0 FROM i UNION ALL SELECT seed, 'train', x, h, 1.0 FROM i WHERE lab UNION ALL SELECT seed, 'every', x, h, 1.0 FROM i),
{newton_chain("vs", 8, ["seed", "variant"], prefix="f")},
w AS (SELECT seed, max(a) FILTER (variant='supervised') AS sa, max(b) FILTER (variant='supervised') AS sb, max(a) FILTER (variant='imputed') AS ia, max(b) FILTER (variant='imputed') AS ib,
  max(a) FILTER (variant='train') AS ta, max(b) FILTER (variant='train') AS tb, max(a) FILTER (variant='every') AS ea, max(b) FILTER (variant='every') AS eb FROM f_fit GROUP BY seed),
c AS (SELECT seed, count(*) FILTER (lab) * 1.0 / count(*) AS c1, avg(x) FILTER (lab) AS l1, avg(x) FILTER (NOT lab) AS u1, var_pop(x) FILTER (lab) AS v1 FROM i GROUP BY seed),
cw AS (SELECT i.seed, i.x, i.y, c1 + (1 - c1) * (1 + (u1 - l1) / v1 * (i.x - l1)) AS w FROM i JOIN c USING (seed) WHERE lab), {newton_chain("cw", 8, ["seed"], prefix="c")},
o AS (SELECT seed, 'supervised' AS method, sa AS a, sb AS b FROM w UNION ALL SELECT seed, 'imputed', ia, ib FROM w UNION ALL SELECT seed, 'debiased', ea - (ta - sa), eb - (tb - sb) FROM w UNION ALL SELECT seed, 'calibrated', a, b FROM c_fit),
tr AS (SELECT x, y, 1.0 AS w FROM z WHERE seed = 1), {newton_chain("tr", 8, prefix="t")}"""


@BOOK.add(
    "ssl14_logistic_comparison",
    f"""WITH {_LOGIT_SEEDS} SELECT method, 'intercept' AS term, {q("avg((o.a-t_fit.a)*(o.a-t_fit.a))")} AS mse, count(*) AS fits FROM o, t_fit GROUP BY method
    UNION ALL SELECT method, 'x', {q("avg((o.b-t_fit.b)*(o.b-t_fit.b))")}, count(*) FROM o, t_fit GROUP BY method""",
)
def ssl14_logistic(spark, sf):
    rows = study(spark, sf).withColumn("v", F.col("y") / 250.0)
    out = compare(rows, "id", ["x"], "t", ["v"], (1, 2), 30, loss="logistic")
    return out.select("method", "term", r("mse").alias("mse"), "fits")


@BOOK.add("ssl14_status_counts", "SELECT method, 'ok' AS status, CAST(3 AS BIGINT) AS n FROM (VALUES ('supervised'), ('imputed'), ('debiased'), ('calibrated')) v(method)")
def ssl14_status(spark, sf):
    return status_counts(coefficients_by_seed(study(spark, sf), "id", ["x"], "y", ["x", "t"], _SEEDS, 10))

