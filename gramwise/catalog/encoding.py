"""Projections, encodings, filters, stacking and scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from gramwise.catalog.support import DOCUMENTS, STUDY, Book, documents, long_form, q, r, study, table, u, union_all
from gramwise.functions import scalars as S
from gramwise.functions.hashing import hash_uniform
from gramwise.operators import encode as E
from gramwise.operators.moments import covariance_rows, means, moments, second_moment_rows
from gramwise.operators.sampling import kfold

BOOK = Book()


@BOOK.add("prj1_drop_null_rows", f"WITH {DOCUMENTS} SELECT lang, count(*) AS n, {q('avg(y)')} AS y FROM docs WHERE y IS NOT NULL GROUP BY lang")
def prj1(spark, sf):
    kept = E.drop_null_rows(documents(spark, sf))
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), r(F.avg("y")).alias("y"))


@BOOK.add("prj1_null_report", f"WITH {DOCUMENTS} SELECT count(*) AS rows, count(y) AS kept, count(*) - count(y) AS removed FROM docs")
def prj1_report(spark, sf):
    return E.null_report(documents(spark, sf), ["y", "x"])


@BOOK.add("prj2_prj12_target_blocks", f"WITH {DOCUMENTS} SELECT {q('target')} AS target, count(*) AS n, {q('sum(x)', 4)} AS x FROM (SELECT y AS target, x FROM docs WHERE has_label UNION ALL SELECT 0.5, x FROM docs WHERE NOT has_label) GROUP BY 1")
def prj2(spark, sf):
    docs = documents(spark, sf)
    labelled = E.split_target(docs.where("has_label"), "y", "response")
    unlabelled = docs.where("not has_label").withColumn("guess", F.lit(0.5))
    both = E.combine_blocks([(labelled, "response"), (unlabelled, "guess")], ["x"])
    return both.groupBy(r("target").alias("target")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("x"), 4).alias("x"))


@BOOK.add("prj4_label_codes", "SELECT lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS code, count(*) AS n FROM documents GROUP BY lang")
def prj4(spark, sf):
    return E.encode_labels(table(spark, sf, "documents"), "lang").groupBy("lang", "code").agg(F.count(F.lit(1)).alias("n"))


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _level_sql(source: str, column: str, key: str, drop_first: bool) -> str:
    cond = f"WHERE v > (SELECT min({column}) FROM {source})" if drop_first else ""
    return f"""SELECT '{column}_' || v AS term, CAST(n AS DOUBLE) AS value, s AS keys FROM
    (SELECT {column} AS v, count(*) AS n, CAST(sum({key}) AS BIGINT) AS s FROM {source} GROUP BY 1) {cond}"""


def _level_sums(df, prefix, key):
    names = [c for c in df.columns if c.startswith(prefix)]
    one = df.agg(*[F.sum(F.col(f"`{c}`")).cast("double").alias(f"v{i}") for i, c in enumerate(names)], *[F.sum(F.col(f"`{c}`") * F.col(key)).alias(f"k{i}") for i, c in enumerate(names)])
    cells = [F.struct(F.lit(c).alias("term"), F.col(f"v{i}").alias("value"), F.col(f"k{i}").alias("keys")) for i, c in enumerate(names)]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


@BOOK.add("prj5_dummies_drop_first", _level_sql("customer", "c_mktsegment", "c_custkey", True))
def prj5(spark, sf):
    df = E.dummies(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], drop_first=True)
    return _level_sums(df, "c_mktsegment_", "c_custkey")


@BOOK.add(
    "prj5_dummy_rows",
    """SELECT "column", level, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM (SELECT 'p_brand' AS "column", p_brand AS level, p_partkey FROM part UNION ALL SELECT 'p_type', p_type, p_partkey FROM part)
    WHERE level <> CASE WHEN "column" = 'p_brand' THEN (SELECT min(p_brand) FROM part) ELSE (SELECT min(p_type) FROM part) END GROUP BY 1, 2""",
)
def prj5_rows(spark, sf):
    """The encoding for columns with too many levels to become table columns."""
    rows = E.dummy_rows(table(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), ["p_partkey"], ["p_brand", "p_type"], drop_first=True)
    return rows.groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"))


@BOOK.add("prj6_dummies_all_levels", _level_sql("orders", "o_orderpriority", "o_orderkey", False))
def prj6(spark, sf):
    df = E.dummies(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], drop_first=False)
    return _level_sums(df, "o_orderpriority_", "o_orderkey")


@BOOK.add(
    "prj7_standardise",
    f"""WITH s AS (SELECT avg(p_size) ms, stddev_pop(p_size) ss, avg(p_retailprice) mp, stddev_pop(p_retailprice) sp FROM part)
    SELECT p_partkey, {q("(p_size - ms) / ss")} AS p_size, {q("(p_retailprice - mp) / sp")} AS p_retailprice FROM part, s""",
)
def prj7(spark, sf):
    df = E.standardise(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return df.select("p_partkey", r("p_size").alias("p_size"), r("p_retailprice").alias("p_retailprice"))


@BOOK.add(
    "prj8_prj9_train_fit_scaling",
    f"""WITH s AS (SELECT avg(o_totalprice) m, stddev_pop(o_totalprice) d FROM orders WHERE {u("o_orderkey", 3)} >= 0.3)
    SELECT o_orderkey, {u("o_orderkey", 3)} >= 0.3 AS train, {q("(o_totalprice - m) / d")} AS y FROM orders, s""",
)
def prj8(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("y")).withColumn("train", hash_uniform("o_orderkey", 3) >= 0.3)
    return E.standardise(rows, ["y"], F.col("train")).select("o_orderkey", "train", r("y").alias("y"))


_Z = ("1.0", "l_quantity", "l_discount", "l_quantity*l_quantity", "l_discount*l_discount")
_ZN = ("intercept", "q", "d", "q^2", "d^2")


@BOOK.add(
    "prj10_prj11_agg2_polynomial_gram",
    " UNION ALL ".join(
        f"SELECT '{_ZN[i]}' AS row_term, '{_ZN[j]}' AS col_term, {q(f'avg(({_Z[i]})*({_Z[j]}))')} AS value FROM lineitem" for i in range(5) for j in range(i, 5)
    ),
)
def prj11(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
    gram = moments(rows, E.polynomial_columns(["q", "d"], 2, intercept=False))
    out = second_moment_rows(gram, E.polynomial_names(["q", "d"], 2))
    return out.select("row_term", "col_term", r("value").alias("value"))


@BOOK.add("agg1_basis_means", " UNION ALL ".join(f"SELECT '{n}' AS term, {q(f'avg({z})')} AS value FROM lineitem" for n, z in zip(_ZN, _Z, strict=True)))
def agg1(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
    m = means(rows, E.polynomial_columns(["q", "d"], 2))
    return spark.createDataFrame([(n, float(v)) for n, v in zip(_ZN, m, strict=True)], "term string, value double").select("term", r("value").alias("value"))


@BOOK.add(
    "agg3_weighted_gram",
    " UNION ALL ".join(
        f"SELECT l_returnflag, '{a}' AS term, {q(f'sum(({w})*{e})/1e6')} AS value FROM lineitem GROUP BY l_returnflag"
        for w in ["l_discount-0.03"]
        for a, e in (("w", "1"), ("wx", "l_quantity"), ("wxx", "l_quantity*l_quantity"), ("wy", "l_extendedprice"), ("wxy", "l_quantity*l_extendedprice"))
    ),
)
def agg3(spark, sf):
    """Signed weights; one aggregate over a non-unique table, so no key is needed."""
    w = F.col("l_discount") - 0.03
    rows = moments(table(spark, sf, "lineitem"), ["l_quantity"], [w * F.col("l_extendedprice")], w, ["l_returnflag"])
    named = rows.select(
        "l_returnflag", *[(F.get(F.col(a), i) / 1e6).alias(n) for n, a, i in (("w", "g", 0), ("wx", "g", 1), ("wxx", "g", 2), ("wy", "b", 0), ("wxy", "b", 1))]
    )
    return long_form(named, ["l_returnflag"])


@BOOK.add(
    "agg4_covariance",
    " UNION ALL ".join(
        f"SELECT l_linestatus, '{a}' AS row_term, '{b}' AS col_term, {q(f'covar_samp({a},{b})')} AS value FROM lineitem GROUP BY l_linestatus"
        for a, b in (("l_quantity", "l_quantity"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_discount"), ("l_discount", "l_tax"), ("l_tax", "l_tax"))
    ),
)
def agg4(spark, sf):
    out = covariance_rows(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], ["l_linestatus"])
    return out.select("l_linestatus", "row_term", "col_term", r("value").alias("value"))


@BOOK.add("prj13_bind_columns", f"WITH {DOCUMENTS} SELECT d.doc_id, {q('d.x')} AS x, CAST(l.quality AS INTEGER) AS quality FROM docs d JOIN labels l ON d.doc_id = l.doc_id")
def prj13(spark, sf):
    docs = documents(spark, sf).select("doc_id", "x")
    out = E.bind_columns(docs, table(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"])
    return out.select("doc_id", r("x").alias("x"), "quality")


@BOOK.add("prj14_counterfactual_rows", f"WITH {STUDY} SELECT setup, v.t, count(*) AS n, {q('avg(x + 2.0 * v.t)')} AS f FROM study, (VALUES (0), (1)) v(t) GROUP BY setup, v.t")
def prj14(spark, sf):
    rows = E.counterfactual_rows(study(spark, sf), "t")
    return rows.groupBy("setup", "t").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.col("x") + 2.0 * F.col("t"))).alias("f"))


@BOOK.add("prj15_prj16_arm_filter", f"WITH {STUDY} SELECT count(*) AS n, {q('avg(y)')} AS y, {q('avg(x)')} AS x FROM study WHERE t = 1")
def prj16(spark, sf):
    modifiers, controls = E.split_features(["x", "y"], 1)
    rows = E.arm(study(spark, sf), "t", 1).select("t", *controls, *modifiers)
    return rows.agg(F.count(F.lit(1)).alias("n"), r(F.avg("y")).alias("y"), r(F.avg("x")).alias("x"))


@BOOK.add("prj17_region", f"SELECT CASE WHEN (value - 10) / 5 >= -1 AND (value - 10) / 5 <= 1 THEN 'interpolation' ELSE 'extrapolation' END AS region, count(*) AS n, {q('avg(value)')} AS value FROM events GROUP BY 1")
def prj17(spark, sf):
    rows = table(spark, sf, "events").withColumn("region", E.region((F.col("value") - 10) / 5))
    return rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value")).alias("value"))


@BOOK.add("prj18_cast_to_double", f"SELECT {q('sum(CAST(substr(p_brand, 7) AS DOUBLE))')} AS brand, {q('sum(CAST(p_size AS DOUBLE))')} AS size FROM part")
def prj18(spark, sf):
    rows = table(spark, sf, "part").select(F.expr("substr(p_brand, 7)").alias("brand"), F.col("p_size").alias("size"))
    return E.to_double(rows, ["brand", "size"]).agg(r(F.sum("brand")).alias("brand"), r(F.sum("size")).alias("size"))


@BOOK.add(
    "prj19_flip_labels",
    f"""SELECT rho, CAST(sum(CASE WHEN {u("doc_id", 11)} < rho THEN 1 - quality ELSE quality END) AS BIGINT) AS ones,
    CAST(sum(CASE WHEN {u("doc_id", 11)} < rho THEN 1 ELSE 0 END) AS BIGINT) AS flipped FROM labels, (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.3::DOUBLE)) v(rho) GROUP BY rho""",
)
def prj19(spark, sf):
    grid = table(spark, sf, "labels").withColumn("rho", F.explode(F.array(F.lit(0.0), F.lit(0.1), F.lit(0.3))))
    noisy = grid.withColumn("noisy", E.flip_labels("quality", "doc_id", F.col("rho"), 11))
    return noisy.groupBy("rho").agg(F.sum("noisy").alias("ones"), F.sum((F.col("noisy") != F.col("quality")).cast("int")).alias("flipped"))


@BOOK.add(
    "prj20_set4_fractional_rows",
    f"""WITH {DOCUMENTS}, e AS (SELECT lang, y, 1.0::DOUBLE AS w FROM docs WHERE has_label
      UNION ALL SELECT lang, 1.0, CASE WHEN lang = 'en' THEN 0.7 ELSE 0.4 END FROM docs WHERE NOT has_label
      UNION ALL SELECT lang, 0.0, 1.0 - CASE WHEN lang = 'en' THEN 0.7 ELSE 0.4 END FROM docs WHERE NOT has_label)
    SELECT lang, y, count(*) AS n, {q("sum(w)")} AS w FROM e GROUP BY lang, y""",
)
def prj20(spark, sf):
    docs = documents(spark, sf).withColumn("p1", F.when(F.col("lang") == "en", 0.7).otherwise(0.4))
    out = E.fractional_rows(docs, "p1", F.col("has_label"))
    return out.groupBy("lang", "y").agg(F.count(F.lit(1)).alias("n"), r(F.sum("w")).alias("w"))


@BOOK.add("prj21_region_weight", f"SELECT CASE WHEN p_size / 50.0 > 0.5 THEN 5.0::DOUBLE ELSE 0.2::DOUBLE END AS w, count(*) AS n, {q('sum(p_size)')} AS size FROM part GROUP BY 1")
def prj21(spark, sf):
    rows = table(spark, sf, "part").withColumn("w", E.region_weight(F.col("p_size") / 50.0, 5.0))
    return rows.groupBy("w").agg(F.count(F.lit(1)).alias("n"), r(F.sum("p_size")).alias("size"))


@BOOK.add("prj22_tilt_weights", f"SELECT p_size, {q('sum(e) / (SELECT sum(exp(0.05 * p_size - 0.0001 * p_retailprice)) FROM part)', 9)} AS w FROM (SELECT p_size, exp(0.05 * p_size - 0.0001 * p_retailprice) AS e FROM part) GROUP BY p_size")
def prj22(spark, sf):
    rows = E.tilt_weights(table(spark, sf, "part"), ["p_size", "p_retailprice"], [0.05, -0.0001])
    return rows.groupBy("p_size").agg(r(F.sum("w"), 9).alias("w"))


@BOOK.add("set3_fold_outputs", f"SELECT CAST(floor({u('o_orderkey', 4)} * 5) AS INTEGER) AS fold, count(*) AS n, {q('avg(o_totalprice)', 4)} AS y FROM orders GROUP BY 1")
def set3(spark, sf):
    return kfold(table(spark, sf, "orders"), "o_orderkey", 5, 4).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), r(F.avg("o_totalprice"), 4).alias("y"))


@BOOK.add(
    "set5_level_union",
    f"""WITH s AS (SELECT DISTINCT l_discount AS d FROM lineitem), v AS (SELECT (1 - d) / 2 AS level FROM s UNION ALL SELECT (1 + d) / 2 FROM s UNION ALL SELECT d FROM s)
    SELECT DISTINCT {q("level", 3)} AS level FROM v""",
)
def set5(spark, sf):
    discounts = table(spark, sf, "lineitem").select(F.col("l_discount").alias("d")).distinct()
    levels = discounts.select(F.explode(F.array((1 - F.col("d")) / 2, (1 + F.col("d")) / 2, F.col("d"))).alias("level"))
    return levels.select(r("level", 3).alias("level")).distinct()


_SCALARS = {
    "sin": (lambda x: F.sin(x), "sin(x)"),
    "cos": (lambda x: F.cos(x), "cos(x)"),
    "exp": (lambda x: F.exp(-x), "exp(-x)"),
    "log": (lambda x: F.log(F.abs(x) + 1.0), "ln(abs(x) + 1.0)"),
    "softplus": (lambda x: S.softplus(x), "ln(1.0 + exp(x))"),
    "logistic": (lambda x: S.logistic(x), "1.0 / (1.0 + exp(-x))"),
    "sqrt": (lambda x: F.sqrt(F.abs(x)), "sqrt(abs(x))"),
    "power": (lambda x: F.pow(x, F.lit(3.0)), "x * x * x"),
    "floor_ceil": (lambda x: F.floor(x) + 2 * F.ceil(x), "floor(x) + 2 * ceil(x)"),
    "half_even": (lambda x: S.half_even(F.round(x * 2) / 2), "round_even(round(x * 2) / 2, 0)"),
    "clip": (lambda x: S.clip(x, -1.0, 1.5), "least(greatest(x, -1.0), 1.5)"),
    "at_least": (lambda x: S.at_least(x, 0.25), "greatest(x, 0.25)"),
    "at_most": (lambda x: S.at_most_value(x, 0.25), "least(x, 0.25)"),
    "step": (lambda x: S.step_function(x, 0.5, -1.0, 2.0), "CASE WHEN x >= 0.5 THEN 2.0 ELSE -1.0 END"),
    "guard": (lambda x: S.finite_or(F.when(x > 0, x).otherwise(F.lit(float("inf"))), 1.0, 1e-7), "CASE WHEN x > 0 THEN x ELSE 1e-7 END"),
    "class": (lambda x: S.to_class(S.logistic(x)), "CASE WHEN 1.0 / (1.0 + exp(-x)) >= 0.5 THEN 1 ELSE 0 END"),
    "gaussian": (lambda x: S.gaussian_density(x), f"exp(-x * x / 2.0) / {math.sqrt(2 * math.pi)!r}"),
    "normal_quantile": (lambda x: S.normal_quantile(0.975, x, 2.0), "x + 2.0 * 1.9599639845400539"),
    "band": (lambda x: S.band(x, F.abs(x), 0.5)[1], "x + 1.96 * sqrt(abs(x) + 0.25)"),
    "pinball": (lambda x: S.pinball(0.3, x), "CASE WHEN x >= 0 THEN 0.3 * x ELSE -0.7 * x END"),
    "check_score": (lambda x: S.check_score(x, 0.5, 0.3), "CASE WHEN x <= 0.5 THEN 0.7 ELSE -0.3 END"),
    "logistic_score": (lambda x: S.logistic_score(1.0, x), "1.0 / (1.0 + exp(-x)) - 1.0"),
    "linear_score": (lambda x: S.linear_score(x, 2.0), "2.0 - x"),
    "min_kernel": (lambda x: S.min_kernel(x, 0.7, 4.0), "least(x, 0.7) / 4.0"),
    "rbf_kernel": (lambda x: S.rbf_kernel(x * x, 0.5), "exp(-0.5 * x * x)"),
    "dot": (lambda x: S.dot([x, x], [2.0, -0.5]), "1.5 * x"),
    "array_dot": (lambda x: S.array_dot(F.array(x, x), F.array(F.lit(1.0), x)), "x + x * x"),
    "squared_distance": (lambda x: S.squared_distance(F.array(x, F.lit(1.0)), F.array(F.lit(0.5), F.lit(3.0))), "(x - 0.5) * (x - 0.5) + 4.0"),
    "inside": (lambda x: S.inside(x, -0.5, 0.5), "CASE WHEN x BETWEEN -0.5 AND 0.5 THEN 1 ELSE 0 END"),
    "same": (lambda x: S.same(F.floor(x), F.ceil(x)), "CASE WHEN floor(x) = ceil(x) THEN 1 ELSE 0 END"),
    "grid_difference": (lambda x: F.get(S.differences(F.array(x, x * x)), 0), "x * x - x"),
}


@BOOK.add(
    "scalar_functions",
    f"WITH v AS (SELECT (value - 10.0) / 5.0 AS x FROM events) {' UNION ALL '.join(f'SELECT {chr(39)}{n}{chr(39)} AS term, {q(f"avg({s})")} AS value FROM v' for n, (_, s) in _SCALARS.items())}",
)
def scalar_functions(spark, sf):
    rows = table(spark, sf, "events").select(((F.col("value") - 10.0) / 5.0).alias("x"))
    return long_form(rows.agg(*[F.avg(fn(F.col("x"))).alias(n) for n, (fn, _) in _SCALARS.items()]), [])


@BOOK.add(
    "scalar_grids",
    f"""SELECT grid, CAST(k AS INTEGER) AS k, {q("v")} AS v, (SELECT count(*) FROM part WHERE p_size / 10.0 <= v) AS below FROM (
    SELECT 'integer' AS grid, k, (k - 45) / 10.0 AS v FROM range(91) t(k) UNION ALL SELECT 'linear', k, k * 5.0 / 20 FROM range(21) t(k)
    UNION ALL SELECT 'geometric', k, 0.01 * power(2, k) FROM range(10) t(k) UNION ALL SELECT 'levels', k, x FROM (VALUES (0, 0.05), (1, 0.25), (2, 0.5), (3, 0.75)) l(k, x))""",
)
def scalar_grids(spark, sf):
    """Grids built inside Spark, each point counted against the sizes of all parts."""
    grids = {
        "integer": S.integer_grid(-45, 45, 10.0),
        "linear": S.linspace(0.0, 5.0, 21),
        "geometric": S.geometric_grid(0.01, 2.0, 10),
        "levels": S.level_set([0.25, 0.5], [0.75, 0.5], [0.05]),
    }
    # A size first counts at the smallest grid point that reaches it; a running sum over the points does the rest.
    entries = F.array(*[
        F.struct(F.lit(g).alias("grid"), F.size(F.filter(a, lambda v: v < F.col("p_size") / 10.0)).alias("k")) for g, a in grids.items()
    ])
    first = table(spark, sf, "part").select(F.explode(entries).alias("e")).groupBy("e.grid", "e.k").agg(F.count(F.lit(1)).alias("n"))
    points = union_all([spark.range(1).select(F.lit(g).alias("grid"), F.posexplode(a).alias("k", "v")) for g, a in grids.items()])
    running = Window.partitionBy("grid").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    joined = points.join(first, ["grid", "k"], "left")
    return joined.select("grid", "k", r("v").alias("v"), F.coalesce(F.sum("n").over(running), F.lit(0)).alias("below"))
