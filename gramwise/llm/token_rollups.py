"""Token counts kept as additive totals, changed by signed batches that are committed once."""

from __future__ import annotations

from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from gramwise.llm.wordpieces import word_tokenizer

_STATE = "doc_id long, source string, lang string, version string, n_tokens long"
_POSTINGS = f"{_STATE}, sign int, turn long"
_TOTALS = "source string, lang string, version string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, tokenizer: str, version: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, source, lang, version, n_tokens) of every row of ``docs``; the whole text, 0 for null."""

    def each(batches):
        encoder = word_tokenizer(tokenizer)
        for batch in batches:
            out = batch.drop(columns="text").astype({"doc_id": "Int64"})
            out["version"], out["n_tokens"] = version, [len(encoder.ids(t)) for t in batch["text"]]
            yield out[["doc_id", "source", "lang", "version", "n_tokens"]]

    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text).cast("string").alias("text")
    )
    return rows.mapInPandas(each, _STATE)


class TokenRollup:
    """Totals by source, language and tokenizer version below ``root``, a folder all executors share.

    A batch writes signed postings: +1 for what a (document, version) holds from now on, -1 for what it held before. Its
    totals are the sums of its postings, and all totals are the sums over batches. A batch counts once its totals are
    complete (their _SUCCESS file); until then a repeated ``commit`` overwrites what an interrupted one left, and
    afterwards it does nothing. So a batch that is sent again changes nothing. A batch's name may hold any character
    (it is escaped in paths), but not be empty. Folders carry the batch's turn and name; every ``snapshot_every``
    batches the state is written once, so that a commit reads that snapshot and the few batches after it. One writer at a
    time is assumed.
    """

    def __init__(self, spark: SparkSession, root: str, snapshot_every: int = 16) -> None:
        self.spark, self.root, self.snapshot_every = spark, root, snapshot_every

    def _complete(self, kind: str) -> list[str]:
        """Names of the finished folders of a kind, in order of their turns."""
        sc = self.spark.sparkContext
        top = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        files = top.getFileSystem(sc._jsc.hadoopConfiguration())
        if not files.exists(top):
            return []
        folders = [s.getPath() for s in files.listStatus(top)]
        return sorted(p.getName() for p in folders if files.exists(sc._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def committed(self) -> list[str]:
        """Names of the batches that count, in their order."""
        return [unquote(folder.split("-", 1)[1]) for folder in self._complete("totals")]

    def _read(self, kind: str, schema: str, folders: list[str]) -> DataFrame:
        paths = [f"{self.root}/{kind}/{folder}" for folder in folders]
        reader = self.spark.read.schema(schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def state(self) -> DataFrame:
        """What every (document, version) holds now."""
        batches, snapshots = self._complete("totals"), self._complete("snapshots")
        start = int(snapshots[-1]) if snapshots else 0
        held = self._read("snapshots", _STATE, snapshots[-1:]).withColumns({"sign": F.lit(1), "turn": F.lit(-1).cast("long")})
        later = self._read("postings", _POSTINGS, [b for b in batches if int(b.split("-")[0]) >= start])
        last = F.max_by(F.struct("sign", "source", "lang", "n_tokens"), F.struct("turn", "sign")).alias("x")
        return held.unionByName(later).groupBy("doc_id", "version").agg(last).where("x.sign = 1").select("doc_id", "x.source", "x.lang", "version", "x.n_tokens")

    def commit(self, name: str, changes: DataFrame) -> bool:
        """Apply ``changes(op, doc_id, source, lang, version, n_tokens)``; op ``put`` inserts or revises, ``delete`` removes.

        False, and no effect, if the batch was committed before. Of several changes to one (document, version) in a
        batch one holds: a delete before puts, else the put with the largest (source, lang, n_tokens). Deleting what is
        not there, or putting what is there already, has no effect. Nulls are values like others; a null count is 0.
        """
        if not name:
            raise ValueError("a batch needs a name")
        done = self.committed()
        if name in done:
            return False
        if done and len(done) % self.snapshot_every == 0 and f"{len(done):012d}" not in self._complete("snapshots"):
            self.state().write.mode("overwrite").parquet(f"{self.root}/snapshots/{len(done):012d}")
        folder = f"{len(done):012d}-{quote(name, safe='')}"
        chosen = F.max(F.struct((F.col("op") == "delete").alias("gone"), "source", "lang", F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))).alias("new")
        new = changes.where(F.col("op").isin("put", "delete")).groupBy(F.col("doc_id").cast("long").alias("doc_id"), "version").agg(chosen)
        old = self.state().select(F.col("doc_id").alias("was"), F.col("version").alias("of"), F.struct(F.lit(False).alias("gone"), "source", "lang", "n_tokens").alias("old"))
        both = new.join(old, new["doc_id"].eqNullSafe(old["was"]) & new["version"].eqNullSafe(old["of"]), "left").where(
            ~F.col("new").eqNullSafe(F.col("old")) & ~(F.col("old").isNull() & F.col("new.gone"))
        )
        signed = F.array(
            F.when(F.col("old").isNotNull(), F.struct(F.lit(-1).alias("sign"), "old.source", "old.lang", "old.n_tokens")),
            F.when(~F.col("new.gone"), F.struct(F.lit(1).alias("sign"), "new.source", "new.lang", "new.n_tokens")),
        )
        postings = both.select("doc_id", "version", F.explode(F.filter(signed, lambda x: x.isNotNull())).alias("x")).select(
            "doc_id", "x.source", "x.lang", "version", "x.n_tokens", "x.sign", F.lit(len(done)).cast("long").alias("turn")
        )
        path = f"{self.root}/postings/{folder}"
        postings.write.mode("overwrite").parquet(path)
        sums = self.spark.read.schema(_POSTINGS).parquet(path).groupBy("source", "lang", "version").agg(
            F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens")
        )
        sums.write.mode("overwrite").parquet(f"{self.root}/totals/{folder}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) without groups that hold no document any more."""
        return self._read("totals", _TOTALS, self._complete("totals")).groupBy("source", "lang", "version").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0")
