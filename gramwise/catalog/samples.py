"""Samples, splits, folds, resampling, parameter grids and anti joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gramwise.catalog.support import Book, q, r, table, u
from gramwise.functions.hashing import hash_uniform
from gramwise.operators import sampling as P
from gramwise.operators.encode import region_weight

BOOK = Book()


@BOOK.add("p2_hash_uniform", f"SELECT o_orderkey, {q(u('o_orderkey', 7), 12)} AS u FROM orders")
def p2(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", r(hash_uniform("o_orderkey", 7), 12).alias("u"))


@BOOK.add("smp1_srt3_cap_rows", f"SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY {u('o_orderkey', 1)}, o_orderkey LIMIT 1250)")
def smp1(spark, sf):
    return P.cap_rows(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 1250, 1)


@BOOK.add(
    "smp2_labelled_sample",
    f"""WITH s AS (SELECT CAST(floor(10 * count(*) / 100) AS BIGINT) AS k FROM orders), ranked AS
    (SELECT o_orderkey, row_number() OVER (ORDER BY {u("o_orderkey", 2)}, o_orderkey) AS rn FROM orders)
    SELECT o_orderkey, rn <= k AS is_labelled FROM ranked, s""",
)
def smp2(spark, sf):
    return P.flag_labelled(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 10, seed=2)


@BOOK.add(
    "smp3_jon3_complement",
    f"""SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM
    (SELECT o_orderkey FROM orders ORDER BY {u("o_orderkey", 2)}, o_orderkey LIMIT 1000))""",
)
def smp3(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    return P.complement(orders, P.cap_rows(orders, "o_orderkey", 1000, 2), "o_orderkey")


@BOOK.add(
    "smp4_train_test_exact",
    f"""WITH n AS (SELECT CAST(ceil(0.3 * count(*)) AS BIGINT) AS k FROM events), ranked AS
    (SELECT event_id, row_number() OVER (ORDER BY {u("event_id", 42)}, event_id) AS rn FROM events)
    SELECT event_id, CASE WHEN rn <= k THEN 'test' ELSE 'train' END AS split FROM ranked, n""",
)
def smp4(spark, sf):
    return P.train_test_split(table(spark, sf, "events").select("event_id"), "event_id", test_fraction=0.3, seed=42)


@BOOK.add("smp4_train_test_by_hash", f"SELECT event_id, CASE WHEN {u('event_id', 43)} < 0.3 THEN 'test' ELSE 'train' END AS split FROM events")
def smp4_hash(spark, sf):
    return P.train_test_split(table(spark, sf, "events").select("event_id"), "event_id", test_fraction=0.3, seed=43, exact=False)


@BOOK.add(
    "smp4_train_size",
    f"""SELECT split, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT event_id, CASE WHEN row_number() OVER
    (ORDER BY {u("event_id", 44)}, event_id) <= 500 THEN 'train' ELSE 'test' END AS split FROM events) GROUP BY split""",
)
def smp4_size(spark, sf):
    rows = P.train_test_split(table(spark, sf, "events").select("event_id"), "event_id", train_size=500, seed=44)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@BOOK.add(
    "smp5_stratified_split",
    f"""WITH ranked AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {u("event_id", 5)}, event_id) AS rn,
    count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_id, event_type, rn <= CAST(round(0.2 * n) AS BIGINT) AS is_calibration FROM ranked""",
)
def smp5(spark, sf):
    return P.stratified_split(table(spark, sf, "events").select("event_id", "event_type"), "event_id", "event_type", 0.2, 5)


@BOOK.add("smp6_smp7_folds", f"SELECT event_id, CAST(floor({u('event_id', 6)} * 5) AS INTEGER) AS fold FROM events")
def smp6(spark, sf):
    return P.kfold(table(spark, sf, "events").select("event_id"), "event_id", 5, 6)


@BOOK.add(
    "smp6_balanced_folds",
    f"SELECT event_id, CAST((row_number() OVER (ORDER BY {u('event_id', 6)}, event_id) - 1) % 5 AS INTEGER) AS fold FROM events",
)
def smp6_balanced(spark, sf):
    return P.kfold(table(spark, sf, "events").select("event_id"), "event_id", 5, 6, balanced=True)


@BOOK.add(
    "smp8_head_tail_split",
    """WITH n AS (SELECT CAST(round(count(*) / 2) AS BIGINT) AS k FROM orders), ranked AS
    (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn FROM orders)
    SELECT o_orderkey, CASE WHEN rn <= k THEN 'head' ELSE 'tail' END AS part FROM ranked, n""",
)
def smp8(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return P.head_tail_split(orders, ["o_totalprice", "o_orderkey"], round(orders.count() / 2)).select("o_orderkey", "part")


@BOOK.add("smp9_permutation", f"SELECT o_orderkey, row_number() OVER (ORDER BY {u('o_orderkey', 9)}, o_orderkey) AS rank FROM orders")
def smp9(spark, sf):
    """The order key of a permutation, made visible by a distributed rank."""
    from gramwise.operators.ranks import hash_rank

    return hash_rank(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 9).select("o_orderkey", F.col("rank").cast("long").alias("rank"))


@BOOK.add(
    "smp10_weighted_resample",
    """WITH w AS (SELECT p_partkey, p_size, CASE WHEN p_size > 25 THEN 5 ELSE 1 END AS w FROM part),
    c AS (SELECT *, sum(w) OVER (ORDER BY p_partkey) AS upto, sum(w) OVER () AS total, count(*) OVER () AS n FROM w),
    k AS (SELECT p_partkey, p_size, CAST(floor(n * upto / total + 0.5) - floor(n * (upto - w) / total + 0.5) AS BIGINT) AS copies FROM c)
    SELECT p_partkey, count(*) AS drawn, CAST(max(i) AS BIGINT) AS last_copy, CAST(max(p_size) AS INTEGER) AS p_size FROM k, range(1, 10) t(i) WHERE i <= copies GROUP BY p_partkey""",
)
def smp10(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size").withColumn("w", F.when(F.col("p_size") > 25, 5).otherwise(1))
    drawn = P.weighted_resample(part, ["p_partkey"], "w", part.count(), 0.5)
    return drawn.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("drawn"), F.max("copy").cast("long").alias("last_copy"), F.max("p_size").alias("p_size"))


@BOOK.add(
    "smp10_induced_shift",
    f"""WITH w AS (SELECT p_partkey, p_size, CASE WHEN p_size > 25 THEN 5.0 ELSE 0.2 END AS w FROM part),
    c AS (SELECT *, sum(w) OVER (ORDER BY p_partkey) AS upto, sum(w) OVER () AS total FROM w),
    k AS (SELECT p_size, CAST(floor(3000 * upto / total + 0.25) - floor(3000 * (upto - w) / total + 0.25) AS BIGINT) AS copies FROM c)
    SELECT CAST(sum(copies) AS BIGINT) AS rows, {q("sum(copies * p_size) / sum(copies)", 1)} AS size FROM k""",
)
def smp10_shift(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size").withColumn("w", region_weight(F.col("p_size") / 50.0, 5.0))
    drawn = P.weighted_resample(part, ["p_partkey"], "w", 3000, 0.25)
    return drawn.agg(F.count(F.lit(1)).alias("rows"), r(F.avg("p_size"), 1).alias("size"))


@BOOK.add(
    "jon11_parameter_grid",
    f"""SELECT t.tau, s.seed, CAST(m AS VARCHAR) AS method, count(*) AS n FROM (VALUES (0.25::DOUBLE), (0.5::DOUBLE)) t(tau), (VALUES (1), (2), (3)) s(seed), (VALUES ('a'), ('b')) g(m), orders
    WHERE {u("o_orderkey", "s.seed")} < t.tau GROUP BY 1, 2, 3""",
)
def jon11(spark, sf):
    """Settings become columns of the data; one grouped aggregate replaces nested loops."""
    grid = P.parameter_grid(spark, tau=[0.25, 0.5], seed=[1, 2, 3], method=["a", "b"])
    settings = [(g["tau"], g["seed"], g["method"]) for g in grid.collect()]
    cells = F.array(*[F.struct(F.lit(t).alias("tau"), F.lit(s).alias("seed"), F.lit(m).alias("method")) for t, s, m in settings])
    rows = table(spark, sf, "orders").select("o_orderkey", F.explode(cells).alias("g")).select("o_orderkey", "g.*")
    return rows.where(hash_uniform("o_orderkey", F.col("seed")) < F.col("tau")).groupBy("tau", "seed", "method").agg(F.count(F.lit(1)).alias("n"))
