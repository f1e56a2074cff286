"""Removal of lines that repeat across documents, with DataFrame functions only."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window, functions as F

from gramwise.session import settle

WHITE = " \t\n\x0b\x0c\r"


def line_key(line: str | Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(WHITE)), ascii_uppercase, ascii_lowercase)


def _lines(text: str | Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed_lines(docs: DataFrame, key: str, text: str, least_chars: int) -> DataFrame:
    """(doc_id, body, pos, h1, h2) of every line that may repeat; ``body`` tells rows with the same doc_id apart."""
    own = F.col(text).cast("string")
    return (
        docs.where(F.col(key).isNotNull())
        .select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(own).alias("body"), F.posexplode(_lines(own)).alias("pos", "line"))
        .select("doc_id", "body", "pos", line_key(F.col("line")).alias("line"))
        .where(F.char_length("line") >= least_chars)
        .select("doc_id", "body", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    )


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 10, hot_lines: int = 1000) -> DataFrame:
    """(doc_id, body, n_dropped, keep_runs) of the documents that lose lines.

    keep_runs is the keep bitmap by run lengths: lines kept, lines dropped, lines kept, ...; the last kept run is left
    out. Narrow 128-bit line hashes are range-partitioned and sorted by (hash, document, position); a stream over them
    carries each hash's first document. The up to ``hot_lines`` most frequent hashes, found by a sketch over all lines,
    don't take part in that exchange: their first document is a map-side minimum of at most that many groups and goes to
    every task, so that a line of a third of all documents fills no partition. Which lines count as frequent changes
    nothing in the result.
    """
    lines = settle(_hashed_lines(docs, key, text, least_chars))
    sketch = F.expr(f"approx_top_k(h1, {hot_lines}, {20 * hot_lines})")
    hot = lines.agg(sketch.alias("top")).select(F.explode("top").alias("x")).select(F.col("x.item").alias("h1"))
    firsts = lines.join(F.broadcast(hot), "h1").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    frequent = lines.join(F.broadcast(firsts), ["h1", "h2"]).where("doc_id > first")
    by_hash = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos")
    rest = (
        lines.join(F.broadcast(hot), "h1", "left_anti").repartitionByRange("h1", "h2")
        .withColumn("first", F.first("doc_id").over(by_hash)).where("doc_id > first")
    )
    where = ["doc_id", "body"]
    dropped = frequent.select(*where, "pos").union(rest.select(*where, "pos")).repartition(*where)
    runs = (
        dropped.withColumn("island", F.col("pos") - F.dense_rank().over(Window.partitionBy(*where).orderBy("pos")))
        .groupBy(*where, "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
        .groupBy(*where).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"), F.sum(F.col("end") - F.col("start")).alias("n_dropped"))
    )
    before = lambda i: F.when(i == 0, 0).otherwise(F.get("runs", i - 1)["end"])
    return runs.select(*where, "n_dropped", F.flatten(F.transform("runs", lambda r, i: F.array(r["start"] - before(i), r["end"] - r["start"]))).alias("keep_runs"))


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 10) -> DataFrame:
    """All rows of ``docs`` with ``text`` replaced by the kept lines, and n_lines (before) and n_dropped added.

    A line key of at least ``least_chars`` code points that a smaller doc_id also holds is dropped, all its lines with
    it. A null text counts as one empty line; a row without doc_id is left as it is and holds nothing back from others;
    rows that share a doc_id are one document. Input columns named n_lines or n_dropped are replaced.
    """
    bitmaps = keep_bitmaps(docs, key, text, least_chars).select(
        F.col("doc_id").alias("__doc"), F.col("body").alias("__body"), F.col("n_dropped").alias("__dropped"), F.col("keep_runs").alias("__runs")
    )
    own = F.col(text).cast("string")
    joined = docs.join(bitmaps, (docs[key].cast("long") == bitmaps["__doc"]) & (F.xxhash64(own) == bitmaps["__body"]), "left")
    flags = F.flatten(F.transform("__runs", lambda n, i: F.array_repeat(i % 2 == 0, n)))
    kept = F.array_join(F.zip_with(_lines(own), flags, lambda line, keep: F.when(F.coalesce(keep, F.lit(True)), line)), "\n")
    base = F.coalesce(own, F.lit(""))
    return joined.withColumns({
        "n_lines": (F.char_length(base) - F.char_length(F.replace(base, F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "n_dropped": F.coalesce("__dropped", F.lit(0)).cast("long"),
        text: F.when(F.col("__runs").isNull(), base).otherwise(kept),
    }).drop("__doc", "__body", "__dropped", "__runs")


DEDUP_SQL = f"""WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM texts),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{ascii_uppercase}', '{ascii_lowercase}') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id > first) AS n_dropped,
sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE first IS NULL OR doc_id = first), '')) AS kept_sha256
FROM keyed LEFT JOIN firsts USING (key) GROUP BY doc_id"""
