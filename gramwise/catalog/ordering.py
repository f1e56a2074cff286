"""Ranks, edges, bins, lookups and accumulated local effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from gramwise.catalog.support import Book, q, r, table, u
from gramwise.functions import lookups as L
from gramwise.functions.hashing import hash_uniform
from gramwise.operators import ranks as R
from gramwise.operators.explain import accumulated_effects
from gramwise.operators.score import score_column

BOOK = Book()
BINS = 20


def _edges(source: str, column: str, bins: int = BINS) -> str:
    """SQL of the distinct edges of one column: k/bins order statistics by the (N-1) rule."""
    return f"""(WITH s AS (SELECT CAST({column} AS DOUBLE) AS v, row_number() OVER (ORDER BY {column}) AS rn, count(*) OVER () AS n FROM {source}),
    k AS (SELECT k, CASE WHEN k = 0 THEN 1 WHEN k = {bins} THEN n WHEN ((n - 1) * k) % {bins} = 0 THEN greatest(((n - 1) * k) // {bins}, 1)
    ELSE ((n - 1) * k) // {bins} + 1 END AS want FROM range({bins + 1}) t(k), (SELECT count(*) AS n FROM {source}))
    SELECT DISTINCT v FROM s JOIN k ON s.rn = k.want)"""


@BOOK.add("win1_quantile_edges", f"SELECT feature, {q('v')} AS value FROM (SELECT 'price' AS feature, v FROM {_edges('part', 'p_retailprice')} UNION ALL SELECT 'size', v FROM {_edges('part', 'p_size')})")
def win1(spark, sf):
    part = table(spark, sf, "part")
    cells = F.array(F.struct(F.lit("price").alias("feature"), F.col("p_retailprice").alias("x")), F.struct(F.lit("size").alias("feature"), F.col("p_size").cast("double").alias("x")))
    long = part.select(F.explode(cells).alias("c")).select("c.*")
    return R.order_statistic_edges(long, "x", BINS, ["feature"]).select("feature", r("value").alias("value"))


@BOOK.add(
    "p6_win5_prefix_rank",
    "SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS rank, CAST(sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS through FROM orders",
)
def p6(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    ranked = R.prefix(rows, ["o_totalprice", "o_orderkey"], "o_custkey", ["o_orderstatus"])
    return ranked.select("o_orderkey", "o_orderstatus", F.col("rank").cast("long").alias("rank"), F.col("through").cast("long").alias("through"))


@BOOK.add(
    "win2_win3_running_effects",
    f"""WITH b AS (SELECT p_size AS bin, avg(p_retailprice) / 1000.0 AS eff FROM part GROUP BY p_size), c AS (SELECT bin, sum(eff) OVER (ORDER BY bin) AS cumulative FROM b)
    SELECT bin, {q("cumulative")} AS cumulative, {q("coalesce(lag(cumulative) OVER (ORDER BY bin), 0.0)")} AS previous, {q("(cumulative + coalesce(lag(cumulative) OVER (ORDER BY bin), 0.0)) / 2")} AS midpoint FROM c""",
)
def win2(spark, sf):
    bins = table(spark, sf, "part").groupBy(F.col("p_size").alias("bin")).agg((F.avg("p_retailprice") / 1000.0).alias("eff"))
    out = R.running_effects(bins, "bin", "eff")
    return out.select("bin", *[r(c).alias(c) for c in ("cumulative", "previous", "midpoint")])


@BOOK.add(
    "jon8_bin_join",
    f"""WITH e AS (SELECT v, row_number() OVER (ORDER BY v) AS i FROM {_edges("part", "p_retailprice")}),
    b AS (SELECT CASE WHEN p_retailprice = (SELECT min(v) FROM e) THEN 1 ELSE (SELECT count(*) FROM e WHERE v < p_retailprice) END AS bin, p_retailprice FROM part)
    SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, {q("avg(p_retailprice)")} AS price FROM b GROUP BY 1""",
)
def jon8(spark, sf):
    part = table(spark, sf, "part").select("p_retailprice")
    edges = sorted(x["value"] for x in R.order_statistic_edges(part, "p_retailprice", BINS).collect())
    rows = part.withColumn("bin", L.bin_of("p_retailprice", L.literal_array(edges)))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r(F.avg("p_retailprice")).alias("price"))


@BOOK.add(
    "jon9_piecewise_linear",
    f"""SELECT p_size, {q("CASE WHEN p_size <= 5 THEN 1.0 WHEN p_size <= 20 THEN 1.0 + (p_size - 5) * 2.0 / 15 WHEN p_size <= 40 THEN 3.0 + (p_size - 20) * (-2.5) / 20 ELSE 0.5 END")} AS f, count(*) AS n FROM part GROUP BY p_size""",
)
def jon9(spark, sf):
    rows = table(spark, sf, "part").withColumn("f", L.interpolate("p_size", [5, 20, 40], [1.0, 3.0, 0.5]))
    return rows.groupBy("p_size", r("f").alias("f")).agg(F.count(F.lit(1)).alias("n"))


@BOOK.add(
    "jon10_bilinear_grid",
    f"""WITH p AS (SELECT p_partkey, p_size / 10.0 AS a, (p_retailprice - 900.0) / 100.0 AS b FROM part),
    c AS (SELECT *, least(greatest(CAST(floor(a) AS INTEGER), 0), 3) AS i, least(greatest(CAST(floor(b) AS INTEGER), 0), 3) AS j FROM p),
    f AS (SELECT *, a - i AS s, b - j AS t FROM c)
    SELECT p_partkey, {q("(1-s)*(1-t)*(i*i+2*j) + s*(1-t)*((i+1)*(i+1)+2*j) + (1-s)*t*(i*i+2*(j+1)) + s*t*((i+1)*(i+1)+2*(j+1))")} AS f FROM f""",
)
def jon10(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("a"), ((F.col("p_retailprice") - 900.0) / 100.0).alias("b"))
    grid = [[float(i * i + 2 * j) for j in range(5)] for i in range(5)]
    return part.select("p_partkey", r(L.bilinear("a", "b", grid)).alias("f"))


_ALE = f"""e AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM {_edges("part", "p_retailprice")}),
    b AS (SELECT p_size, CASE WHEN p_retailprice = (SELECT min(v) FROM e) THEN 1 ELSE (SELECT count(*) FROM e WHERE v < p_retailprice) END AS bin FROM part),
    d AS (SELECT b.bin, ((h.v / 1000.0) * (h.v / 1000.0) + (h.v / 1000.0) * p_size / 50.0) - ((l.v / 1000.0) * (l.v / 1000.0) + (l.v / 1000.0) * p_size / 50.0) AS delta FROM b JOIN e h ON h.i = b.bin JOIN e l ON l.i = b.bin - 1),
    m AS (SELECT e.i AS bin, e.v AS edge, count(d.delta) AS size, coalesce(avg(d.delta), 0.0) AS mean FROM e LEFT JOIN d ON d.bin = e.i GROUP BY 1, 2),
    c AS (SELECT *, sum(mean) OVER (ORDER BY bin) AS cum FROM m), g AS (SELECT *, (cum + coalesce(lag(cum) OVER (ORDER BY bin), 0.0)) / 2 AS mid FROM c)"""


@BOOK.add(
    "ale1_accumulated_effect",
    f"WITH {_ALE} SELECT 'price' AS feature, CAST(bin AS INTEGER) AS bin, {q('edge')} AS edge, size, {q('cum - (SELECT sum(size * mid) / sum(size) FROM g)')} AS eff FROM g",
)
def ale1(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_retailprice").alias("price"), (F.col("p_size") / 50.0).alias("size"))
    predict = lambda c: (c["price"] / 1000.0) * (c["price"] / 1000.0) + (c["price"] / 1000.0) * c["size"]
    out = accumulated_effects(rows, ["price"], predict, ["price", "size"], BINS)
    return out.select("feature", "bin", r("edge").alias("edge"), "size", r("eff").alias("eff"))


def _ale_sql(feature: str, expr: str, other: str, value: str, bins: int, band: bool = False) -> str:
    """SQL of one feature's curve: ``expr`` is the model with the feature as {v}; ``other`` are extra row columns."""
    at = lambda side: expr.format(v=f"{side}.v")
    half = "CASE WHEN size > 1 THEN 1.959963984540054 * sd / sqrt(size) ELSE 0.0 END"
    tail = f", {q(f'eff - {half}')} AS lower, {q(f'eff + {half}')} AS upper" if band else f", {q('edge')} AS edge, size"
    return f"""SELECT '{feature}' AS feature, bin, {q("eff")} AS eff{tail} FROM (WITH src AS (SELECT {value} AS f, {other} FROM part), e AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM {_edges("src", "f", bins)}),
    b AS (SELECT src.*, CASE WHEN f = (SELECT min(v) FROM e) THEN 1 ELSE (SELECT count(*) FROM e WHERE v < f) END AS bin FROM src),
    d AS (SELECT b.bin, ({at("h")}) - ({at("l")}) AS delta FROM b JOIN e h ON h.i = b.bin JOIN e l ON l.i = b.bin - 1),
    m AS (SELECT e.i AS bin, e.v AS edge, count(d.delta) AS size, coalesce(avg(d.delta), 0.0) AS mean, stddev_samp(d.delta) AS sd FROM e LEFT JOIN d ON d.bin = e.i GROUP BY 1, 2),
    c AS (SELECT *, sum(mean) OVER (ORDER BY bin) AS cum FROM m), g AS (SELECT *, (cum + coalesce(lag(cum) OVER (ORDER BY bin), 0.0)) / 2 AS mid FROM c)
    SELECT CAST(bin AS INTEGER) AS bin, edge, size, sd, cum - (SELECT sum(size * mid) / sum(size) FROM g) AS eff FROM g)"""


@BOOK.add("ale1_confidence_band", _ale_sql("price", "{v} * size_ / 1000.0", "p_size / 50.0 AS size_", "p_retailprice", BINS, band=True))
def ale1_band(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_retailprice").alias("price"), (F.col("p_size") / 50.0).alias("size"))
    out = accumulated_effects(rows, ["price"], lambda c: c["price"] * c["size"] / 1000.0, ["price", "size"], BINS, band=0.95)
    return out.select("feature", "bin", *[r(c).alias(c) for c in ("eff", "lower", "upper")])


class _Polynomial:
    """A stand-in for a user's model: anything with ``predict``."""

    def predict(self, x):
        return 0.5 * x[:, 0] ** 2 - x[:, 1] + 0.1 * x[:, 0] * x[:, 1]


@BOOK.add(
    "ale2_many_features",
    _ale_sql("price", "0.5 * {v} * {v} - size_ + 0.1 * {v} * size_", "p_size / 50.0 AS size_", "p_retailprice / 1000.0", 10)
    + " UNION ALL "
    + _ale_sql("size", "0.5 * price_ * price_ - {v} + 0.1 * price_ * {v}", "p_retailprice / 1000.0 AS price_", "p_size / 50.0", 10),
)
def ale2(spark, sf):
    """Two features of a batch-scored model in one pass."""
    rows = table(spark, sf, "part").select((F.col("p_retailprice") / 1000.0).alias("price"), (F.col("p_size") / 50.0).alias("size"))
    predict = lambda c: score_column(spark, _Polynomial(), [c["price"], c["size"]])
    out = accumulated_effects(rows, ["price", "size"], predict, bins=10)
    return out.select("feature", "bin", r("edge").alias("edge"), "size", r("eff").alias("eff"))


@BOOK.add("udf1_udf5_batch_scoring", f"SELECT p_partkey, {q('0.5 * s * s - p_retailprice / 1000.0 + 0.1 * s * p_retailprice / 1000.0')} AS prediction FROM (SELECT *, p_size / 50.0 AS s FROM part)")
def udf1(spark, sf):
    part = table(spark, sf, "part")
    score = score_column(spark, _Polynomial(), [F.col("p_size") / 50.0, F.col("p_retailprice") / 1000.0])
    return part.select("p_partkey", r(score).alias("prediction"))


_PIT = f"(floor({u('event_id', 21)} * 500) / 500.0)"


@BOOK.add(
    "agg18_ks_distance",
    f"""WITH d AS (SELECT event_type, {_PIT} AS v FROM events), c AS (SELECT event_type, v, count(*) AS n FROM d GROUP BY 1, 2),
    s AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY v) AS hi, sum(n) OVER (PARTITION BY event_type) AS total FROM c)
    SELECT event_type, {q("max(greatest(hi / total - v, v - (hi - n) / total))")} AS ks, CAST(max(total) AS BIGINT) AS n FROM s GROUP BY event_type""",
)
def agg18(spark, sf):
    rows = table(spark, sf, "events").select("event_type", (F.floor(hash_uniform("event_id", 21) * 500) / 500.0).alias("pit"))
    return R.uniform_ks(rows, "pit", ["event_type"]).select("event_type", r("ks").alias("ks"), "n")


@BOOK.add(
    "agg19_density_histogram",
    f"""WITH d AS (SELECT event_type, {u("event_id", 21)} AS v FROM events) SELECT event_type, CAST(least(floor(v * 20), 19) AS INTEGER) AS bin, count(*) AS n,
    {q("count(*) * 20.0 / (SELECT count(*) FROM events x WHERE x.event_type = d.event_type)")} AS density FROM d GROUP BY 1, 2""",
)
def agg19(spark, sf):
    rows = table(spark, sf, "events").select("event_type", hash_uniform("event_id", 21).alias("pit"))
    return R.density_histogram(rows, "pit", 20, ["event_type"]).select("event_type", "bin", "n", r("density").alias("density"))

