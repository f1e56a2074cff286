"""Rollups against recomputed totals after every batch; the registered query against brute force."""

import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gramwise.llm import queries, token_rollups

CHANGE = "op string, doc_id long, source string, lang string, version string, n_tokens long"


def totals(state):
    docs, tokens = Counter(), Counter()
    for (_, version), (source, lang, n) in state.items():
        docs[(source, lang, version)] += 1
        tokens[(source, lang, version)] += n
    return {(*k, docs[k], tokens[k]) for k in docs}


def test_batches_equal_recomputed_totals(spark, tmp_path):
    rng, state = random.Random(3), {}
    rollup = token_rollups.TokenRollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    for turn in range(4):
        rows = {}
        for _ in range(40):
            key = (rng.choice([None, *range(12)]), rng.choice(["v1", "v2"]))
            rows[key] = (rng.choice(["put", "put", "delete"]), key[0], rng.choice(["a", None]), rng.choice(["en", "de"]), key[1], rng.choice([None, 3, 5, 0]))
        changes = spark.createDataFrame(list(rows.values()), CHANGE)
        assert rollup.commit(f"b{turn}", changes) is True
        for key, (op, _, source, lang, _, n) in rows.items():
            if op == "delete":
                state.pop(key, None)
            else:
                state[key] = (source, lang, n or 0)
        assert {tuple(r) for r in rollup.totals().collect()} == totals(state)
        assert rollup.commit(f"b{turn}", changes.limit(3)) is False
    assert {tuple(r) for r in rollup.totals().collect()} == totals(state)
    assert {(r["doc_id"], r["version"]): (r["source"], r["lang"], r["n_tokens"]) for r in rollup.state().collect()} == state


def test_interrupted_and_empty_batches(spark, tmp_path):
    rollup = token_rollups.TokenRollup(spark, str(tmp_path / "r"))
    put = spark.createDataFrame([("put", 1, "a", "en", "v", 4), ("put", 1, "a", "en", "v", 4), ("other", 2, "a", "en", "v", 9)], CHANGE)
    rollup.commit("x", put)
    next((tmp_path / "r" / "totals").glob("*-x/_SUCCESS")).rename(tmp_path / "unfinished")
    assert rollup.totals().count() == 0 and rollup.commit("x", put) is True
    assert rollup.commit("none", put.limit(0)) is True
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v", 1, 4)]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_equals_brute_force(spark, sf):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    marks = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        marks.setdefault(r["doc_id"], []).append(r)
    state = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        own, n = marks.get(r["doc_id"], []), len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        if any(m["toxic"] == 1 for m in own):
            continue
        low = any(m["quality"] == 0 for m in own)
        state[(r["doc_id"], "word_bpe_49k+end" if low else "word_bpe_49k")] = (r["source"], r["lang"], n + low)
    assert {tuple(r) for r in queries.op8(spark, sf).collect()} == totals(state)


def test_names_with_any_characters_and_none_empty(spark, tmp_path):
    rollup = token_rollups.TokenRollup(spark, str(tmp_path / "r"))
    put = lambda k, n: spark.createDataFrame([("put", k, "s", "en", "v", n)], CHANGE)
    for k, name in enumerate(["2024/01", "a=b", "..", "x y%2F", "batch-é"]):
        assert rollup.commit(name, put(k, k)) is True and rollup.commit(name, put(k, 99)) is False
    assert rollup.committed() == ["2024/01", "a=b", "..", "x y%2F", "batch-é"]
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "v", 5, 10)]
    with pytest.raises(ValueError):
        rollup.commit("", put(9, 9))


def test_snapshots_change_nothing(spark, tmp_path):
    rng, state = random.Random(5), {}
    rollup = token_rollups.TokenRollup(spark, str(tmp_path / "r"), snapshot_every=2)
    for turn in range(6):
        rows = [(rng.choice(["put", "delete"]), k, "s", rng.choice(["en", None]), "v", rng.randrange(9)) for k in rng.sample(range(8), 4)]
        rollup.commit(f"b{turn}", spark.createDataFrame(rows, CHANGE))
        for op, k, source, lang, version, n in rows:
            state.pop((k, version), None)
            if op == "put":
                state[k, version] = (source, lang, n)
        assert {tuple(r) for r in rollup.totals().collect()} == totals(state)
        assert {(r["doc_id"], r["version"]): (r["source"], r["lang"], r["n_tokens"]) for r in rollup.state().collect()} == state
    assert len(list((tmp_path / "r" / "snapshots").iterdir())) == 2


def test_counting_odd_tables(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, None, None, None, 7), (1, None, None, None, 7), (None, "a b", "s", "en", 7), (2, "", "s", "en", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_tokens int")
    got = sorted(map(tuple, token_rollups.count_tokens(docs, path, "v").collect()), key=str)
    assert got == sorted([(1, None, None, "v", 0)] * 2 + [(None, "s", "en", "v", 2), (2, "s", "en", "v", 0)], key=str)
    assert token_rollups.count_tokens(docs.limit(0), path, "v").count() == 0
