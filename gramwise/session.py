"""Session settings and the shared working folder."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

BROADCAST_BYTES = 64 * 1024 * 1024
"""Measured size up to which a table is shipped to every task; larger ones are joined by shuffle or in blocks."""


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gramwise")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python functions find it there."""
    sc = spark.sparkContext
    if getattr(sc, "_gramwise_shipped", False):
        return
    top, raw = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(raw, "w") as archive:
        for path in sorted(top.rglob("*.py")):
            archive.writestr(str(path.relative_to(top.parent)), path.read_bytes())
    target = Path(tempfile.mkdtemp(prefix="gramwise-")) / "gramwise.zip"
    target.write_bytes(raw.getvalue())
    sc.addPyFile(str(target))
    sc._gramwise_shipped = True


def checkpoint_root(spark: SparkSession) -> str:
    """The folder shared by the cluster (``spark.checkpoint.dir``); a temporary one only in local mode."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="gramwise-")
    sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; ``clear_scratch`` deletes what was written there."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    sc._gramwise_scratch = [*getattr(sc, "_gramwise_scratch", []), path]
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this application; call it once the results that read them are stored."""
    sc = spark.sparkContext
    for path in getattr(sc, "_gramwise_scratch", []):
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
    sc._gramwise_scratch = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a compressed table in the shared folder, read back: cuts the lineage of wide rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Materialise on reliable storage and cut the lineage; settling the same frame again costs nothing."""
    done = getattr(df, "_gramwise_settled", None)
    if done is None:
        checkpoint_root(df.sparkSession)
        done = df.checkpoint(eager=True)
        done._gramwise_settled = done
        df._gramwise_settled = done
    return done


def _widths(df: DataFrame) -> tuple[list, int]:
    """(aggregates: rows and widest values of the columns without a fixed width, bytes of the others in a row)."""
    parts, fixed = [F.count(F.lit(1)).alias("n")], 32
    for i, field in enumerate(df.schema):
        kind = field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            parts.append(F.max(F.octet_length(field.name)).alias(f"w{i}"))
        elif isinstance(kind, T.ArrayType):
            element = 8 if isinstance(kind.elementType, T.NumericType) else 64
            parts.append((F.max(F.size(field.name)) * element).alias(f"w{i}"))
        else:
            fixed += 8 if isinstance(kind, T.NumericType) else 64
    return parts, fixed


def _bytes(row: dict, fixed: int) -> int:
    return (row["n"] or 0) * (fixed + sum(16 + max(v or 0, 0) for name, v in row.items() if name != "n"))


def measured_bytes(df: DataFrame) -> int:
    """An upper bound of the table's size from its row count and its widest values; one pass over a stored table."""
    parts, fixed = _widths(df)
    return _bytes(df.agg(*parts).first().asDict(), fixed)


def joinable(df: DataFrame) -> DataFrame:
    """The stored table, marked for broadcast when its measured size allows; it is measured while it is stored."""
    if getattr(df, "_gramwise_settled", None) is not None:
        done = settle(df)
        size = getattr(done, "_gramwise_bytes", None)
        if size is None:
            size = done._gramwise_bytes = measured_bytes(done)
    else:
        parts, fixed = _widths(df)
        seen = Observation()
        done = settle(df.observe(seen, *parts))
        df._gramwise_settled = done
        size = done._gramwise_bytes = _bytes(seen.get, fixed)
    return F.broadcast(done) if size <= BROADCAST_BYTES else done
