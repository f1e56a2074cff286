"""Language identification: averaged embeddings of hashed subword n-grams, linear softmax, calibrated rejection."""

from __future__ import annotations

import io
import re
import sys
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gramwise.operators.joins import attach

UNKNOWN = "und"
_BLOCK = 1 << 20
_PRIMES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


_OTHER = re.compile(r"[\W\d_]+")


@cache
def _numerals() -> re.Pattern:
    """Numerals that count as word characters but are no letters: superscripts, fractions, Roman, circled ones."""
    found = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
    return re.compile(f"[{found}]+")


def letters_only(text: str | None) -> bytes:
    """Lower-case words between single blanks; empty where the text has no letter."""
    words = _OTHER.sub(" ", text or "").strip()
    if words and not words.replace(" ", "").isalpha():
        words = " ".join(_numerals().sub(" ", words).split())
    words = words.lower()
    return f" {words} ".encode() if words else b""


def gram_blocks(data: bytes, buckets: int):
    """Bucket numbers of all 2-, 3- and 4-byte windows with a blank at their ends at most, block by block."""
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, len(raw), _BLOCK):
        b = raw[at : at + _BLOCK + 3].astype(np.uint32)
        blank, code, out = b == 32, b, []
        for n in (2, 3, 4):
            code = code[:-1] << np.uint32(8) | b[n - 1 :]
            stop = min(len(code), _BLOCK)
            inner = ~blank[1:-1] if n == 3 else ~(blank[1:-2] | blank[2:-1]) if n == 4 else ~(blank[:-1] & blank[1:])
            own = code[:stop][inner[:stop]] * np.uint32(_PRIMES[n - 2]) ^ np.uint32(n)
            own ^= own >> np.uint32(15)
            out.append(own * np.uint32(0x27D4EB2F) >> np.uint32(32 - buckets))
        yield np.concatenate(out)


@dataclass
class LanguageModel:
    """Per bucket the share it adds to each language's logit; ``buckets`` is a number of bits."""

    languages: list[str]
    table: np.ndarray
    temperature: float
    threshold: float
    buckets: int

    def logits(self, data: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for grams in gram_blocks(data, self.buckets):
            total += self.table[grams].sum(axis=0, dtype=np.float64)
            n += len(grams)
        return total / max(1, n)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether that is enough to accept it."""
        data = letters_only(text)
        if not data or not self.languages:
            return UNKNOWN, 0.0, False
        p = _softmax(self.logits(data)[None] / self.temperature)[0]
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] >= self.threshold)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, languages=np.array(self.languages, object), table=self.table, numbers=np.array([self.temperature, self.threshold, self.buckets]))
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> LanguageModel:
        held = np.load(io.BytesIO(raw), allow_pickle=True)
        temperature, threshold, buckets = held["numbers"]
        return LanguageModel(held["languages"].tolist(), held["table"], float(temperature), float(threshold), int(buckets))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _snippets(text: str, rng: np.random.Generator):
    """The whole text in stretches of 1 to 40 words, so that short texts are learnt as well as long ones."""
    words = letters_only(text).split()
    at = 0
    while at < len(words):
        n = int(np.exp(rng.uniform(0, np.log(40.0))) + 0.5)
        yield b" " + b" ".join(words[at : at + n]) + b" "
        at += n


def fit(texts: list[str], languages: list[str], buckets: int = 18, width: int = 16, epochs: int = 2, rate: float = 4.0, reject: float = 0.001, seed: int = 1) -> LanguageModel:
    """Stochastic gradient descent on snippets of three quarters of the texts; the rest calibrates.

    Embeddings start at zero, so that n-grams never seen leave all languages equally likely. The temperature has the
    smallest log loss on the calibration snippets; a prediction is rejected below the score that ``reject`` of those
    snippets stay under.
    """
    names = sorted(set(languages))
    rng = np.random.default_rng(seed)
    parts: list[tuple[list[np.ndarray], list[int]]] = [([], []), ([], [])]
    for k, (text, language) in enumerate(zip(texts, languages, strict=True)):
        grams, labels = parts[k % 4 == 3]
        for snippet in _snippets(text, rng):
            grams.append(np.concatenate(list(gram_blocks(snippet, buckets))))
            labels.append(names.index(language))
    (grams, labels), calibration = parts[0], parts[1] if parts[1][0] else parts[0]
    embedding, weights = np.zeros((1 << buckets, width), np.float32), rng.normal(0, 1 / np.sqrt(width), (width, len(names))).astype(np.float32)
    batch, done, total = 64, 0, max(1, epochs * len(grams))
    for _ in range(epochs):
        order = rng.permutation(len(grams))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            own, y = [grams[i] for i in chosen], np.array([labels[i] for i in chosen])
            sizes = np.array([len(g) for g in own])
            flat, starts = np.concatenate(own), np.concatenate(([0], np.cumsum(sizes)[:-1]))
            hidden = np.add.reduceat(embedding[flat], starts, axis=0) / sizes[:, None]
            error = _softmax(hidden @ weights)
            error[np.arange(len(y)), y] -= 1
            step = rate * (1 - done / total) / len(y)
            back = (error @ weights.T / sizes[:, None]).astype(np.float32)
            weights -= (step * hidden.T @ error).astype(np.float32)
            np.add.at(embedding, flat, np.repeat(np.float32(-step * batch) * back, sizes, axis=0))
            done += len(chosen)
    model = LanguageModel(names, embedding @ weights, 1.0, 0.0, buckets)
    logits = np.array([model.table[g].mean(axis=0) for g in calibration[0]]).reshape(-1, len(names))
    y = np.array(calibration[1], int)
    if len(y):
        grid = np.geomspace(0.05, 20, 60)
        model.temperature = float(min(grid, key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean()))
        model.threshold = float(np.quantile(_softmax(logits / model.temperature).max(axis=1), reject))
    return model


def learn(docs: DataFrame, trainable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 300, most_languages: int | None = None) -> LanguageModel:
    """Fit on at most ``per_language`` whole documents of each language, or of the ``most_languages`` most frequent ones.

    That bound is the sample's documented size; the documents are those of smallest key hash, whatever the partitions.
    The fit runs in one task on that sample, and only the model returns to the driver.
    """
    rows = docs.where(trainable & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull()).select(
        F.xxhash64(F.col(key).cast("string")).alias("order"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")
    )
    common = rows.groupBy("lang").count()
    if most_languages is not None:
        common = common.orderBy(F.desc("count"), "lang").limit(most_languages)
    # hashes are even: four times the documents wanted lie below this part of the range, so few texts are sent on
    low = F.pmod("order", F.lit(1 << 30)) < F.lit(4.0 * per_language * (1 << 30)) / F.col("count")
    rows = attach(rows, common, ["lang"]).where(low)
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "text"))).where(f"rank <= {per_language}")
    sample = first.select("order", "lang", "text").repartition(1)

    def train(batches):
        frame = pd.concat([pd.DataFrame({"order": [], "lang": [], "text": []}), *batches]).sort_values(["order", "lang", "text"])
        frame = frame[[bool(letters_only(t)) for t in frame["text"]]]
        if len(frame):
            yield pd.DataFrame({"model": [fit(frame["text"].tolist(), frame["lang"].tolist()).dump()]})

    found = sample.mapInPandas(train, "model binary").collect()
    return LanguageModel.load(bytes(found[0]["model"])) if found else LanguageModel([], np.zeros((1, 0)), 1.0, 0.0, 18)


def predict_languages(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every row, from its whole text alone.

    A null text or one without letters is ``und`` with score 0, and so is every text where nothing could be learnt.
    ``accepted`` is false for those and below the calibrated threshold.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        for batch in batches:
            rows = [shared.value.predict(t) for t in batch["text"]]
            out = pd.DataFrame(rows, columns=["lang_pred", "score", "accepted"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInPandas(each, "doc_id long, lang_pred string, score double, accepted boolean")


def accepts(model: LanguageModel):
    """A column function of the text: whether its language is accepted. Where no language could be learnt, any letter is enough."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def accepted(text: pd.Series) -> pd.Series:
        known = shared.value
        return pd.Series([known.predict(t)[2] if known.languages else bool(letters_only(t)) for t in text], dtype=bool)

    return accepted


def held_out(key: str = "doc_id") -> Column:
    """The fold that is never learnt from: crc32 of the key's text divisible by 5, and rows without key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(True))


def identify_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted): learnt from the other folds of ``docs`` itself."""
    model = learn(docs, ~held_out())
    return predict_languages(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
