"""Readers for the text layouts in use. Schemas are explicit; nothing is inferred from the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gramwise.functions.scalars import utf8

_NUMERIC = {"numeric", "real", "integer"}


def attribute_schema(header: Sequence[str]) -> T.StructType:
    """Schema of an attribute-described table from its header lines: numeric kinds are double, all others string."""
    fields = []
    for line in header:
        text = line.strip()
        if text.lower().startswith("@attribute"):
            rest = text[len("@attribute") :].strip()
            if rest[0] in "'\"":
                end = rest.index(rest[0], 1)
                name, kind = rest[1:end], rest[end + 1 :].strip()
            else:
                name, kind = rest.split(None, 1)
            fields.append(T.StructField(name, T.DoubleType() if kind.strip().lower() in _NUMERIC else T.StringType()))
    return T.StructType(fields)


def _header(spark: SparkSession, path: str) -> list[str]:
    """The lines above @data in one file of the folder; every file repeats the same header."""
    first = sorted(spark.read.text(path).inputFiles())[0]
    lines, wanted = [], 500
    while True:
        lines = [r["value"] for r in spark.read.text(first).take(wanted)]
        ends = [i for i, line in enumerate(lines) if line.strip().lower() == "@data"]
        if ends or len(lines) < wanted:
            return lines[: ends[0]] if ends else lines
        wanted *= 4


def read_attribute_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Dense attribute-described text files of a folder: comment, header and blank lines skipped, '?' is null.

    Give the schema when it is known; otherwise it is taken from the header.
    """
    schema = schema or attribute_schema(_header(spark, path))
    lines = spark.read.text(path).where(
        (F.trim("value") != "") & ~F.ltrim("value").startswith("%") & ~F.ltrim("value").startswith("@")
    )
    options = {"quote": "'", "nullValue": "?", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "mode": "FAILFAST"}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return lines.select(F.from_csv("value", ddl, options).alias("r")).select("r.*")


def decode_binary(df: DataFrame) -> DataFrame:
    """Every binary column as UTF-8 text."""
    return df.withColumns({f.name: utf8(f.name) for f in df.schema if isinstance(f.dataType, T.BinaryType)})


def read_positional(spark: SparkSession, path: str, types: Sequence[str], keep: Sequence[int] | None = None) -> DataFrame:
    """Headerless CSV: columns _c0, _c1, ... of the stated types, optionally only some ordinals."""
    schema = ", ".join(f"_c{i} {t}" for i, t in enumerate(types))
    df = spark.read.schema(schema).csv(path, header=False)
    return df if keep is None else df.select(*[f"_c{i}" for i in keep])


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = False) -> DataFrame:
    """Delimited numbers with an optional header line."""
    return spark.read.schema(schema).csv(path, sep=sep, header=header, enforceSchema=True)


def read_named(spark: SparkSession, path: str, names: Sequence[str], sep: str = "\t") -> DataFrame:
    """Headerless numeric table with caller-supplied column names."""
    return spark.read.schema(", ".join(f"`{n}` double" for n in names)).csv(path, sep=sep)


def rename_all(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.toDF(*names)


def read_replicates(spark: SparkSession, root: str, schema: str, header: bool = False) -> DataFrame:
    """All files <root>/<setup>/<scenario>/<replicate>.csv in one scan, with setup, scenario and rep columns.

    A replicate may be one file or a folder of part files named <replicate>.csv.
    """
    rows = spark.read.schema(schema).option("header", header).option("recursiveFileLookup", "true").csv(root)
    path = F.col("_metadata.file_path")
    found = lambda group: F.regexp_extract(path, r"([^/]+)/([^/]+)/(\d+)\.csv(?:/[^/]+)?$", group)
    return rows.select("*", found(1).alias("setup"), found(2).alias("scenario"), found(3).cast("int").alias("rep"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Partitioned results; partitions that were never written are simply absent."""
    return spark.read.parquet(path)


def result_counts(results: DataFrame, by: str) -> DataFrame:
    return results.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def with_predictions(df: DataFrame, predictions: DataFrame, key: str, name: str) -> DataFrame:
    """Earlier predictions as a column, through the row key."""
    return df.join(predictions.select(key, name), key)
