"""Sources and sinks: tables written by Spark in the layout in question and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from gramwise.catalog.support import Book, q, r, table
from gramwise.session import scratch_path
from gramwise.sources import readers, writers

BOOK = Book()
HEADER = ("% a comment", "@relation part", "@attribute p_partkey NUMERIC", "@attribute 'p_brand' {b1,b2}", "@attribute p_size INTEGER", "@attribute price REAL", "@data", "")


def _attribute_lines(df):
    """Data lines of each task below a copy of the header."""
    line = F.concat_ws(
        ",", F.col("p_partkey").cast("string"), F.concat(F.lit("'"), F.col("p_brand"), F.lit("'")),
        F.when(F.col("p_size") % 7 == 0, "?").otherwise(F.col("p_size").cast("string")), F.col("p_retailprice").cast("string"),
    )

    def with_header(batches):
        yield pd.DataFrame({"value": list(HEADER)})
        yield from batches

    return df.select(line.alias("value")).mapInPandas(with_header, "value string")


@BOOK.add(
    "src1_attribute_table",
    f"""SELECT p_brand, count(*) AS n, count(CASE WHEN p_size % 7 <> 0 THEN 1 END) AS n_size, {q("sum(CASE WHEN p_size % 7 <> 0 THEN p_size END)")} AS size_sum,
    {q("avg(p_retailprice)", 4)} AS price FROM part GROUP BY p_brand""",
)
def src1(spark, sf):
    path = scratch_path(spark, "attributes")
    _attribute_lines(table(spark, sf, "part")).write.text(path)
    df = readers.read_attribute_table(spark, path)
    return df.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.count("p_size").alias("n_size"), r(F.sum("p_size")).alias("size_sum"), r(F.avg("price"), 4).alias("price")
    )


@BOOK.add("src1_decode_bytes", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def src1_bytes(spark, sf):
    raw = table(spark, sf, "part").select(F.encode("p_type", "UTF-8").alias("p_type"))
    return readers.decode_binary(raw).groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("src3_positional_csv", f"SELECT p_brand AS _c1, count(*) AS n, {q('sum(p_retailprice)', 2)} AS total FROM part GROUP BY p_brand")
def src3(spark, sf):
    path = scratch_path(spark, "positional")
    table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice").write.csv(path)
    df = readers.read_positional(spark, path, ["long", "string", "string", "int", "double"], keep=[1, 4])
    return df.groupBy("_c1").agg(F.count(F.lit(1)).alias("n"), r(F.sum("_c4"), 2).alias("total"))


@BOOK.add("src4_delimited", f"SELECT count(*) AS n, {q('avg(c_acctbal)')} AS mean, CAST(max(c_custkey) AS BIGINT) AS last FROM customer")
def src4(spark, sf):
    path = scratch_path(spark, "delimited")
    table(spark, sf, "customer").select("c_acctbal", "c_custkey").write.csv(path, sep=";", header=True)
    df = readers.read_delimited(spark, path, "effect double, id long", sep=";", header=True)
    return df.agg(F.count(F.lit(1)).alias("n"), r(F.avg("effect")).alias("mean"), F.max("id").alias("last"))


@BOOK.add(
    "src5_replicate_folder",
    f"""SELECT o_orderstatus AS setup, CAST(CAST(o_custkey % 2 AS INTEGER) AS VARCHAR) AS scenario, CAST(o_orderkey % 2 AS INTEGER) AS rep, count(*) AS n,
    {q("sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)")} AS treated, {q("avg(o_totalprice)", 4)} AS y
    FROM orders GROUP BY 1, 2, 3""",
)
def src5(spark, sf):
    root = scratch_path(spark, "replicates")
    orders = table(spark, sf, "orders")
    treated = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int")
    for setup in ("O", "F", "P"):
        for scenario in (0, 1):
            for rep in (0, 1):
                part = orders.where((F.col("o_orderstatus") == setup) & (F.col("o_custkey") % 2 == scenario) & (F.col("o_orderkey") % 2 == rep))
                part.select(treated, "o_totalprice").write.csv(f"{root}/{setup}/{scenario}/{rep}.csv")
    df = readers.read_replicates(spark, root, "t double, y double")
    return df.groupBy("setup", "scenario", "rep").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("t")).alias("treated"), r(F.avg("y"), 4).alias("y")
    )


@BOOK.add("src6_named_tab_table", f"SELECT {q('avg(p_size)')} AS size_mean, {q('avg(p_retailprice)')} AS price_mean, count(*) AS n FROM part")
def src6(spark, sf):
    path = scratch_path(spark, "named")
    table(spark, sf, "part").select("p_size", "p_retailprice").write.csv(path, sep="\t")
    df = readers.read_named(spark, path, ["size", "price"])
    return df.agg(r(F.avg("size")).alias("size_mean"), r(F.avg("price")).alias("price_mean"), F.count(F.lit(1)).alias("n"))


@BOOK.add("src7_rename_and_split", f"SELECT CAST(s_nationkey AS INTEGER) AS nation, {q('avg(s_acctbal)')} AS y, count(*) AS n FROM supplier GROUP BY 1")
def src7(spark, sf):
    from gramwise.operators.encode import split_target

    df = readers.rename_all(table(spark, sf, "supplier"), ["key", "name", "nation", "balance"])
    return split_target(df, "balance").groupBy("nation").agg(r(F.avg("y")).alias("y"), F.count(F.lit(1)).alias("n"))


@BOOK.add("src8_snk1_results", f"SELECT event_type, count(*) AS n, {q('sum(value)', 4)} AS total FROM events WHERE event_type <> 'error' GROUP BY event_type")
def src8(spark, sf):
    """One partition is never written; one is written twice and replaced, not doubled."""
    path = scratch_path(spark, "results")
    events = table(spark, sf, "events").where(F.col("event_type") != "error").select("event_id", "event_type", "value")
    writers.write_results(events, path, ["event_type"])
    writers.write_results(events.where(F.col("event_type") == "click"), path, ["event_type"])
    results = readers.read_results(spark, path)
    return readers.result_counts(results, "event_type").join(
        results.groupBy("event_type").agg(r(F.sum("value"), 4).alias("total")), "event_type"
    )


@BOOK.add(
    "src9_stored_predictions",
    f"SELECT event_type, {q('avg((value - 2.0 * (event_id % 5)) * (value - 2.0 * (event_id % 5)))')} AS mse FROM events GROUP BY event_type",
)
def src9(spark, sf):
    path = scratch_path(spark, "predictions")
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    writers.write_results(events.select("event_id", "event_type", (F.col("event_id") % 5 * 2.0).alias("p")), path, ["event_type"])
    joined = readers.with_predictions(events, readers.read_results(spark, path), "event_id", "p")
    return joined.groupBy("event_type").agg(r(F.avg((F.col("value") - F.col("p")) * (F.col("value") - F.col("p")))).alias("mse"))


@BOOK.add("snk2_json_metrics", f"SELECT event_type, count(*) AS n, {q('avg(value)')} AS mean FROM events GROUP BY event_type")
def snk2(spark, sf):
    path = scratch_path(spark, "json")
    writers.write_json(table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")), path)
    back = spark.read.schema("event_type string, n long, mean double").json(path)
    return back.select("event_type", "n", r("mean").alias("mean"))


@BOOK.add(
    "snk3_csv_four_decimals",
    "SELECT p_brand, CAST(p_size AS INTEGER) AS p_size, CAST(printf('%.4f', round(avg(p_retailprice), 9)) AS VARCHAR) AS price FROM part GROUP BY p_brand, p_size",
)
def snk3(spark, sf):
    path = scratch_path(spark, "csv")
    means = table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.round(F.avg("p_retailprice"), 9).alias("price"))
    writers.write_csv(means, path)
    return spark.read.schema("p_brand string, p_size int, price string").csv(path, header=True)


@BOOK.add(
    "set1_stack_frames",
    """SELECT side, count(*) AS n, count(y) AS with_y FROM (SELECT 'labelled' AS side, quality AS y FROM labels
    UNION ALL SELECT 'unlabelled', NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) GROUP BY side""",
)
def set1(spark, sf):
    from gramwise.catalog.support import documents
    from gramwise.operators.encode import stack_rows

    docs = documents(spark, sf)
    labelled = docs.where("has_label").select("doc_id", "x", "y", F.lit("labelled").alias("side"))
    unlabelled = docs.where("not has_label").select("doc_id", "x", F.lit("unlabelled").alias("side"))
    return stack_rows(unlabelled, labelled).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("with_y"))


