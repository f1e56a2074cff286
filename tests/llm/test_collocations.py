"""Phrases and their scores against counting every phrase in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gramwise.llm import collocations as c


def slow(rows, support, reported=2000, longest=5):
    counts, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, longest + 1):
                    if i + k <= len(words):
                        counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if a >= support and len(p) > 1}
        rows = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in frequent.items()):
                continue
            score, k = min(((1000 * a * n[lang]) // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), lang, a, f[p[:k]], f[p[k:]]))
        rows.sort()
        out += [(r[3], i, r[2].decode(), r[4], r[5], r[6], n[lang], -r[0]) for i, r in enumerate(rows[:reported], 1)]
    return sorted(out)


ODD = [
    (1, None, "en"),
    (2, "", None),
    (2, "A b. a B\nA\tb, a b \x0b a b", None),
    (2, "A b. a B\nA\tb, a b \x0b a b", None),
    (None, "\x01 \x85é É\xa0x ... é É", "é"),
    (3, "a " * 500 + "!" + "ab cd ef gh ij kl " * 300, "en"),
    (4, "x\r\ny;;z" * 5, "en"),
    (5, "und", "und"),
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(["Aa", "b", "C.", "dd", "é,", "f\ng", "h  i"]) for _ in range(rng.randrange(60)))
    return ODD + [(k, text(), rng.choice(["en", "de", None])) for k in range(10, 300)]


@pytest.mark.parametrize(("support", "shards", "most_bits"), [(5, 3, 28), (40, 8, 28), (5, 1, 16), (30, 64, 28)])
def test_equals_brute_force(spark, rows, support, shards, most_bits):
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, lang string, n long, phrase string").repartition(3)
    got = c.collocations(docs, support=support, shards=shards, most_bits=most_bits, reported=50).collect()
    assert sorted(tuple(r) for r in got) == slow(rows, support, 50)


def test_full_bit_table_changes_nothing(spark, rows, monkeypatch):
    """Hits by chance bring more phrases to the exact count, which drops them."""
    monkeypatch.setattr(c, "_found", lambda keys, count, bits: c._Found(16, np.full(1 << 13, 255, np.uint8)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in c.collocations(docs, support=20).collect()) == slow(rows, 20)


def test_scores_beyond_64_bits():
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    wide = lambda x: f"cast({x} as decimal(19, 0))"
    row = spark.sql(f"select cast(1000 as decimal(4, 0)) * {wide(999_999_999_999)} * cast(99999999999999 as decimal(15, 0)) div ({wide(1_234_567_890_123)} * {wide(1_000_000_000_007)})").first()
    assert row[0] == 1000 * 999_999_999_999 * 99_999_999_999_999 // (1_234_567_890_123 * 1_000_000_000_007)


def test_empty_table(spark):
    assert c.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_words_of_a_chunk():
    texts = pa.array(["x", None, "Ab\tC.d ", "", "É!é"]).slice(1)
    t = c._Text(pa.array(["a", "a", "b", "b"]), texts, np.zeros(4, np.int64))
    assert t.words.take(pa.array(t.codes)).to_pylist() == ["ab", "c", "d", "É", "é"]
    assert t.doc.tolist() == [1, 1, 1, 3, 3] and t.joined.tolist() == [True, False, False, False]


def test_counts_leave_in_small_batches():
    """A chunk of text with many distinct words leaves the worker in batches of bounded size."""
    import pyarrow as pa

    from gramwise.llm import collocations as C

    n = 3 * C._BATCH_ROWS + 5
    text = " ".join(f"w{i}" for i in range(n)) + ", "
    given = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text]), pa.array([0], pa.int64())], names=["lang", "text", "shard"])
    out = list(C._per_chunk(C._count_words)(iter([given])))
    assert max(b.num_rows for b in out) <= C._BATCH_ROWS
    words = [w for b in out for w, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True) if w is not None and c == 1]
    assert sorted(words) == sorted(f"w{i}" for i in range(n))
