"""Rules against plain evaluation, the lasso against its optimality conditions, held-out accuracy, odd input."""

import math

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from gramwise.llm import quality_rules as q

SF = "/root/testdata/sf0.1"


def plain_statistics(text):
    text = text or ""
    words = [w for w in regex.split(r"[\x20\x09-\x0D]+", text) if w]
    chars, n = len(text), len(words)
    share = lambda pattern: len("".join(regex.findall(pattern, text))) / chars if chars else 0.0
    per = lambda pattern: len(list(regex.finditer(pattern, text))) / n if n else 0.0
    return [
        math.log1p(chars),
        math.log1p(n),
        sum(map(len, words)) / n if n else 0.0,
        share(r"\p{L}"),
        share(r"\p{Lu}"),
        share(r"\p{Nd}"),
        share(r"[.,;:!?]"),
        share(r"[\p{S}#$%&*|<>=_~^@\\/+]"),
        per(r"\n"),
        per(r"[.!?](?:\Z|[\x20\x0A])"),
        per(r"[!?]{2,}"),
        per(r"(?:^|[\x20\x0A])[^\p{L}\p{Nd}\x20\x0A]+(?=\Z|[\x20\x0A])"),
        per(r"[#$%&*|~^@+=<>_]{2,}"),
        len(set(words)) / n if n else 0.0,
        per(r"(?:^|[\x20\x0A])([^\x20\x09-\x0D]+)(?=[\x20\x0A]\1(?:\Z|[\x20\x0A]))"),
    ]


TEXTS = [None, "", "   ", "One two two THREE!! | ## 45 é. É?", "a a a a b\nc c", "x" * 300_000, "ab " * 50_000 + "end", "\t*** ||\n&&&"]


def test_statistics_equal_plain_python(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r[0]: r[1:] for r in q.text_statistics(rows).select("doc_id", *q.STATISTICS).collect()}
    for k, text in enumerate(TEXTS):
        assert got[k] == pytest.approx(plain_statistics(text), abs=1e-12), (k, dict(zip(q.STATISTICS, got[k])))


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 6))
    y = (rng.random(800) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    theta = q.lasso_logistic(x, y, 0.05, steps=5000, tol=1e-12)
    slope = x.T @ (1 / (1 + np.exp(-(theta[0] + x @ theta[1:]))) - y) / len(x)
    active = theta[1:] != 0
    assert set(np.flatnonzero(active)) == {0, 1}
    assert slope[active] == pytest.approx(-0.05 * np.sign(theta[1:][active]), abs=1e-6)
    assert (np.abs(slope[~active]) <= 0.05 + 1e-9).all()


def test_rules_of_trees_are_conjunctions_that_find_a_box():
    rng = np.random.default_rng(1)
    rows = rng.random((4000, 4))
    labels = ((rows[:, 0] > 0.5) & (rows[:, 2] <= 0.3)).astype(float)
    model = q.fit_rules(rows, labels, ["a", "b", "c", "d"])
    assert (((model.values(rows, ["a", "b", "c", "d"]) > 0.5) == (labels > 0.5)).mean()) > 0.98
    assert any({name for name, _, _ in rule} == {"a", "c"} for rule, _ in model.rules)
    assert len(model.rules) < len(q.grow_rules(rows, labels))


def test_compiled_columns_equal_plain_evaluation(spark):
    rng = np.random.default_rng(2)
    rows = rng.random((500, len(q.STATISTICS)))
    model = q.fit_rules(rows, (rows[:, 3] + rows[:, 9] > rng.random(500) * 2).astype(float), q.STATISTICS)
    assert model.rules and q.RuleEnsemble.load(model.dump()) == model
    frame = spark.createDataFrame(rows.tolist(), [*q.STATISTICS]).select(model.score().alias("s"))
    assert [r["s"] for r in frame.collect()] == pytest.approx(model.values(rows, q.STATISTICS).tolist(), abs=1e-12)


def test_held_out_accuracy_and_no_leak(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").repartition(8), spark.read.parquet(f"{SF}/labels.parquet")
    scored = q.score_quality(docs, labels)
    first = {r["doc_id"]: r for r in scored.collect()}
    assert len(first) == docs.count()
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    aside = [(first[k]["score"], first[k]["predicted"], y) for k, y in marks.items() if first[k]["held_out"]]
    good, bad = [s for s, _, y in aside if y == 1], [s for s, _, y in aside if y == 0]
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert area > 0.93 and np.mean([p == y for _, p, y in aside]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in first.values())
    # labels of the fold held out, and other columns, change nothing
    flipped = labels.withColumn("quality", F.when(q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    moved = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "score": F.lit(3), "label": F.lit(7)})
    assert {r["doc_id"]: r["score"] for r in q.score_quality(moved, flipped).collect()} == pytest.approx({k: r["score"] for k, r in first.items()})


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a b"), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (2, 0), (2, 0), (9, 1)], "doc_id long, quality int")
    got = q.score_quality(docs, labels).collect()
    assert len(got) == 5 and all(0 < r["score"] < 1 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [True]
    assert {r["score"] for r in q.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert q.score_quality(docs.limit(0), labels).count() == 0
