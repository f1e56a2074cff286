"""Distance joins: nearest rows, votes, kernel smoothing and kernel expansions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gramwise.catalog.support import Book, q, r, table, u
from gramwise.functions.hashing import hash_uniform
from gramwise.operators import neighbors as N
from gramwise.operators.classify import choose_k, neighbour_cv, neighbour_predictions
from gramwise.plans.noise_study import neighbour_accuracy

BOOK = Book()

# Labelled vectors are a hash sample, the others the unlabelled side; y = 1 for labels below 5.
_VEC = f"""v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, {u("vec_id", 71)} < 0.4 AS lab,
  CAST(floor({u("vec_id", 72)} * 5) AS INTEGER) AS fold FROM embeddings), l AS (SELECT * FROM v WHERE lab), n AS (SELECT * FROM v WHERE NOT lab),
  d AS (SELECT n.id AS qid, l.id AS rid, l.label, l.y, round(power(list_distance(n.e, l.e), 2), 9) AS dist FROM n, l)"""


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", "label", (F.col("label") < 5).cast("int").alias("y"), (hash_uniform("vec_id", 71) < 0.4).alias("lab"),
        F.floor(hash_uniform("vec_id", 72) * 5).cast("int").alias("fold"),
    )


def _sides(spark, sf):
    rows = _vectors(spark, sf)
    return rows.where("lab"), rows.where("not lab")


_BLOCKS = {"block_rows": 64, "broadcast_bytes": 0}


_TOP = f"{_VEC}, o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS place FROM d)"


@BOOK.add("jon4_nearest_join", f"WITH {_TOP} SELECT qid, CAST(label AS INTEGER) AS label, {q('dist', 5)} AS dist FROM o WHERE place = 1")
def jon4(spark, sf):
    labelled, rest = _sides(spark, sf)
    near = N.nearest_join(rest, labelled, 1, "id", "id", "embedding", "label")
    first = F.get("neighbours", 0)
    return near.select("qid", first["payload"].cast("int").alias("label"), r(first["dist"], 5).alias("dist"))


@BOOK.add("srt2_win6_nearest_rows", f"WITH {_TOP} SELECT qid, CAST(place AS INTEGER) AS place, rid, {q('dist', 5)} AS dist FROM o WHERE place <= 5")
def win6(spark, sf):
    labelled, rest = _sides(spark, sf)
    rows = N.neighbour_rows(N.nearest_join(rest, labelled, 8, "id", "id", "embedding", "y"))
    top = N.rank_limited(rows.drop("place"), "qid", ["dist", "rid"], 5)
    return top.select("qid", "place", "rid", r("dist", 5).alias("dist"))


@BOOK.add("srt2_nearest_rows_in_blocks", f"WITH {_TOP} SELECT qid, CAST(place AS INTEGER) AS place, rid, {q('dist', 5)} AS dist FROM o WHERE place <= 5")
def win6_blocks(spark, sf):
    """The same join along the path for reference tables too large to broadcast."""
    labelled, rest = _sides(spark, sf)
    rows = N.neighbour_rows(N.nearest_join(rest, labelled, 5, "id", "id", "embedding", "y", **_BLOCKS))
    return rows.select("qid", "place", "rid", r("dist", 5).alias("dist"))


_KS = (1, 4, 9)
_VOTES = "k AS (SELECT * FROM (VALUES (1), (4), (9)) t(k))"


@BOOK.add(
    "jon5_neighbour_votes",
    f"WITH {_TOP}, {_VOTES} SELECT qid, k, CAST(CASE WHEN sum(y) * 2 > k THEN 1 ELSE 0 END AS INTEGER) AS predicted FROM o JOIN k ON o.place <= k.k GROUP BY qid, k",
)
def jon5(spark, sf):
    labelled, rest = _sides(spark, sf)
    return neighbour_predictions(labelled, rest, "id", "embedding", "y", _KS, [0, 1])


_CV = f"""{_VEC}, p AS (SELECT a.id, a.fold, a.y AS truth, b.y, row_number() OVER (PARTITION BY a.id ORDER BY round(power(list_distance(a.e, b.e), 2), 9), b.id) AS place FROM l a JOIN l b ON a.fold <> b.fold),
    {_VOTES}, hits AS (SELECT k, id, any_value(fold) AS fold, CASE WHEN (CASE WHEN sum(y) * 2 > k THEN 1 ELSE 0 END) = any_value(truth) THEN 1.0 ELSE 0.0 END AS hit FROM p JOIN k ON place <= k GROUP BY k, id),
    per AS (SELECT k, fold, avg(hit) AS a FROM hits GROUP BY 1, 2), cv AS (SELECT k, avg(a) AS accuracy FROM per GROUP BY k)"""


@BOOK.add("cls2_neighbour_cv", f"WITH {_CV} SELECT k, {q('accuracy')} AS accuracy FROM cv")
def cls2(spark, sf):
    labelled, _ = _sides(spark, sf)
    return neighbour_cv(labelled, "id", "embedding", "y", "fold", _KS, [0, 1]).select("k", r("accuracy").alias("accuracy"))


@BOOK.add(
    "cls2_chosen_k_accuracy",
    f"""WITH {_CV}, best AS (SELECT k FROM cv ORDER BY round(accuracy, 12) DESC, k LIMIT 1), o AS (SELECT d.*, n.y AS truth, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS place FROM d JOIN n ON n.id = d.qid),
    c AS (SELECT qid, CASE WHEN (CASE WHEN sum(y) * 2 > any_value(k) THEN 1 ELSE 0 END) = any_value(truth) THEN 1.0 ELSE 0.0 END AS hit FROM o, best WHERE place <= k GROUP BY qid)
    SELECT k, {q("avg(hit)")} AS accuracy FROM c, best GROUP BY k""",
)
def cls2_chosen(spark, sf):
    labelled, rest = _sides(spark, sf)
    k = choose_k(neighbour_cv(labelled, "id", "embedding", "y", "fold", _KS, [0, 1]))
    found = neighbour_predictions(labelled, rest, "id", "embedding", "y", [k], [0, 1])
    joined = found.join(rest.select(F.col("id").alias("qid"), "y"), "qid")
    return joined.groupBy("k").agg(r(F.avg((F.col("predicted") == F.col("y")).cast("double"))).alias("accuracy"))


@BOOK.add(
    "cls3_noisy_label_neighbours",
    f"""WITH {_VEC}, tr AS (SELECT id, e, rho, CASE WHEN {u("id", 73)} < rho THEN 1 - y ELSE y END AS noisy, CAST(floor({u("id", 73)} * 3) AS INTEGER) AS part FROM l, (VALUES (0.0::DOUBLE), (0.2::DOUBLE)) r(rho)),
    kk AS (SELECT * FROM (VALUES (1), (5)) t(k)),
    p AS (SELECT a.rho, a.id, a.part, a.noisy AS truth, b.noisy, row_number() OVER (PARTITION BY a.rho, a.id ORDER BY round(power(list_distance(a.e, b.e), 2), 9), b.id) AS place FROM tr a JOIN tr b ON a.rho = b.rho AND a.part <> b.part),
    hits AS (SELECT rho, k, id, any_value(part) AS part, CASE WHEN (CASE WHEN sum(noisy) * 2 > k THEN 1 ELSE 0 END) = any_value(truth) THEN 1.0 ELSE 0.0 END AS hit FROM p JOIN kk ON place <= k GROUP BY rho, k, id),
    per AS (SELECT rho, k, part, avg(hit) AS a FROM hits GROUP BY 1, 2, 3), cv AS (SELECT rho, k, round(avg(a), 12) AS a FROM per GROUP BY 1, 2),
    best AS (SELECT rho, k FROM (SELECT *, row_number() OVER (PARTITION BY rho ORDER BY a DESC, k) AS i FROM cv) WHERE i = 1),
    o AS (SELECT tr.rho, n.id AS qid, n.y AS truth, tr.noisy, row_number() OVER (PARTITION BY tr.rho, n.id ORDER BY round(power(list_distance(n.e, tr.e), 2), 9), tr.id) AS place FROM n, tr),
    c AS (SELECT rho, qid, any_value(k) AS k, CASE WHEN (CASE WHEN sum(noisy) * 2 > any_value(k) THEN 1 ELSE 0 END) = any_value(truth) THEN 1.0 ELSE 0.0 END AS hit FROM o JOIN best USING (rho) WHERE place <= k GROUP BY rho, qid)
    SELECT rho, any_value(k) AS k, {q("avg(hit)")} AS accuracy FROM c GROUP BY rho""",
)
def cls3(spark, sf):
    out = neighbour_accuracy(_vectors(spark, sf), "id", "embedding", "y", "lab", [0.0, 0.2], 73, [1, 5], [0, 1], 3)
    return out.select("rho", "k", r("accuracy").alias("accuracy"))


_SMOOTH = f"""WITH {_VEC}, h AS (SELECT * FROM (VALUES (0, 0.3::DOUBLE), (1, 0.8::DOUBLE)) t(i, h)) SELECT qid, CAST(i AS INTEGER) AS i,
  {q("sum(exp(-dist/(2*h*h))/sqrt(2*pi()) * label) / (sum(exp(-dist/(2*h*h))/sqrt(2*pi())) + 1e-6)", 5)} AS smooth FROM d, h GROUP BY qid, i"""


@BOOK.add("jon6_kernel_smoother", _SMOOTH)
def jon6(spark, sf):
    labelled, rest = _sides(spark, sf)
    out = N.kernel_smooth(rest, labelled, "id", "id", "embedding", "label", [0.3, 0.8])
    return out.select("qid", F.posexplode("smooth").alias("i", "s")).select("qid", "i", r("s", 5).alias("smooth"))


@BOOK.add("jon6_kernel_smoother_in_blocks", _SMOOTH)
def jon6_blocks(spark, sf):
    labelled, rest = _sides(spark, sf)
    out = N.kernel_smooth(rest, labelled, "id", "id", "embedding", "label", [0.3, 0.8], **_BLOCKS)
    return out.select("qid", F.posexplode("smooth").alias("i", "s")).select("qid", "i", r("s", 5).alias("smooth"))


@BOOK.add("jon7_rbf_expansion", f"WITH {_VEC} SELECT qid, {q('sum((label - 4.5) / 10.0 * exp(-dist / 64.0))', 5)} AS value FROM d GROUP BY qid")
def jon7(spark, sf):
    labelled, rest = _sides(spark, sf)
    points = labelled.withColumn("alpha", (F.col("label") - 4.5) / 10.0)
    out = N.kernel_expansion(rest, points, "id", "id", "embedding", "alpha", "rbf", 1.0 / 64.0)
    return out.select("qid", r("value", 5).alias("value"))


@BOOK.add(
    "jon7_min_kernel_expansion",
    f"""WITH p AS (SELECT p_partkey AS id, p_size / 50.0 AS x, (p_retailprice - 1000.0) / 100.0 AS a, {u("p_partkey", 74)} < 0.1 AS s FROM part),
    g AS (SELECT x, sum(a) AS a FROM p WHERE s GROUP BY x), t AS (SELECT DISTINCT x FROM p), k AS (SELECT t.x, sum(least(t.x, g.x) * g.a) / 100.0 AS v FROM t, g GROUP BY t.x)
    SELECT id AS qid, {q("v", 5)} AS value FROM p JOIN k USING (x) WHERE NOT s""",
)
def jon7_min(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.array(F.col("p_size") / 50.0).alias("v"), ((F.col("p_retailprice") - 1000.0) / 100.0).alias("a"), (hash_uniform("p_partkey", 74) < 0.1).alias("s")
    )
    out = N.kernel_expansion(rows.where("not s"), rows.where("s"), "id", "id", "v", "a", "min", scale=100.0)
    return out.select("qid", r("value", 5).alias("value"))


# Orders in the plane: price in 997s and days since 1992 in hundreds; a hash sample is the reference side.
_PLANE = f"""o AS (SELECT o_orderkey AS id, o_totalprice / 997.0 AS a, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 100.0 AS b, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
  {u("o_orderkey", 75)} < 0.2 AS ref, CAST(floor({u("o_orderkey", 76)} * 4) AS INTEGER) AS fold FROM orders)"""
_PLANE_PAIRS = f"""WITH {_PLANE}, d AS (SELECT n.id AS qid, l.id AS rid, l.y, round(power(n.a - l.a, 2) + power(n.b - l.b, 2), 9) AS dist FROM o n, o l WHERE l.ref AND NOT n.ref),
  p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS place FROM d)
  SELECT qid, CAST(place AS INTEGER) AS place, rid, {q("dist", 5)} AS dist FROM p WHERE place <= 4"""


def _plane(spark, sf):
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.array((F.col("o_totalprice") / 997.0).cast("double"), (days / 100.0).cast("double")).alias("v"), (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        (hash_uniform("o_orderkey", 75) < 0.2).alias("ref"), F.floor(hash_uniform("o_orderkey", 76) * 4).cast("int").alias("fold"),
    )


@BOOK.add("srt2_nearest_orders", _PLANE_PAIRS)
def nearest_orders(spark, sf):
    """Four nearest orders in the plane, most cells of which no order has to visit."""
    rows = _plane(spark, sf)
    near = N.neighbour_rows(N.nearest_join(rows.where("not ref"), rows.where("ref"), 4, "id", "id", "v", "y"))
    return near.select("qid", "place", "rid", r("dist", 5).alias("dist"))


@BOOK.add("srt2_nearest_orders_by_visits", _PLANE_PAIRS)
def nearest_orders_by_visits(spark, sf):
    """The same rows along the path of a large reference table: visits dealt by cell, in two rounds."""
    rows = _plane(spark, sf)
    near = N.neighbour_rows(N.nearest_join(rows.where("not ref"), rows.where("ref"), 4, "id", "id", "v", "y", block_rows=1000, broadcast_bytes=0))
    return near.select("qid", "place", "rid", r("dist", 5).alias("dist"))


@BOOK.add(
    "cls2_neighbour_cv_of_orders",
    f"""WITH {_PLANE}, l AS (SELECT * FROM o WHERE ref), p AS (SELECT a.id, a.fold, a.y AS truth, b.y, row_number() OVER (PARTITION BY a.id ORDER BY round(power(a.a - b.a, 2) + power(a.b - b.b, 2), 9), b.id) AS place FROM l a JOIN l b ON a.fold <> b.fold),
    {_VOTES}, hits AS (SELECT k, id, any_value(fold) AS fold, CASE WHEN (CASE WHEN sum(y) * 2 > k THEN 1 ELSE 0 END) = any_value(truth) THEN 1.0 ELSE 0.0 END AS hit FROM p JOIN k ON place <= k GROUP BY k, id),
    per AS (SELECT k, fold, avg(hit) AS a FROM hits GROUP BY 1, 2) SELECT k, {q("avg(a)")} AS accuracy FROM per GROUP BY k""",
)
def cls2_orders(spark, sf):
    rows = _plane(spark, sf).where("ref")
    return neighbour_cv(rows, "id", "v", "y", "fold", _KS, [0, 1]).select("k", r("accuracy").alias("accuracy"))


@BOOK.add(
    "jon6_smooth_orders",
    f"""WITH {_PLANE}, l AS (SELECT a, b, y FROM o WHERE ref), w AS (SELECT n.id AS qid, l.y, exp(-round(power(n.a - l.a, 2) + power(n.b - l.b, 2), 9) / (2 * 0.25)) / sqrt(2 * pi()) AS kern FROM o n, l WHERE NOT n.ref)
    SELECT qid, {q("sum(kern * y) / (sum(kern) + 1e-6)", 5)} AS smooth FROM w GROUP BY qid""",
)
def jon6_orders(spark, sf):
    """A bandwidth of half a unit: cells beyond the kernel's reach are not visited."""
    rows = _plane(spark, sf)
    out = N.kernel_smooth(rows.where("not ref"), rows.where("ref"), "id", "id", "v", "y", [0.5])
    return out.select("qid", r(F.get("smooth", 0), 5).alias("smooth"))
