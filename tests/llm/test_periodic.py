"""Runs and Lyndon arrays against definitions spelt out word by word."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from gramwise.llm import periodic


def slow_lyndon(codes):
    out = []
    for i in range(len(codes)):
        best = 0
        for j in range(i + 1, len(codes) + 1):
            word = codes[i:j]
            if all(word < word[k:] for k in range(1, len(word))):
                best = j - i
        out.append(best)
    return out


def slow_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - i
            if length >= max(6, 4 * q):
                found.setdefault((i, length), q)
            i = end + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def slow_report(doc_id, text, planted=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if planted and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(slow_runs(words), key=lambda r: (r[0], r[2]))
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *top, digest("".join(f"{s},{z},{q}\n" for s, z, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40))
def test_lyndon_array(codes):
    assert periodic.lyndon_lengths(codes) == slow_lyndon(codes)


def test_barriers_cut_the_lyndon_array():
    left, right = [2, 1, 3, 1], [1, 2, 1, 2, 2]
    assert periodic.lyndon_lengths([0, *left, 0, *right]) == [0, *slow_lyndon(left), 0, *slow_lyndon(right)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), min_size=1, max_size=4), st.integers(0, 2**30))
def test_runs_of_small_alphabets(texts, seed):
    rng = random.Random(seed)
    texts = [t + t[: rng.randrange(1, 5)] * rng.randrange(7) for t in texts]
    codes, docs = np.array([c for t in texts for c in t], int), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    start, length, period = periodic.find_runs(codes, docs)
    at, wanted = 0, []
    for t in texts:
        wanted += [(s + at, n, q) for s, n, q in slow_runs(t)]
        at += len(t)
    assert sorted(zip(start.tolist(), length.tolist(), period.tolist())) == sorted(wanted)


def test_fibonacci_words_and_powers():
    a, b = [1], [1, 2]
    for _ in range(9):
        a, b = b, b + a
    for text in (b * 4, [1] * 500, [1, 2] * 200 + [1] * 7, ([1] * 9 + [2]) * 40):
        codes = np.array(text)
        got = periodic.find_runs(codes, np.zeros(len(codes), int))
        assert sorted(zip(*[c.tolist() for c in got])) == slow_runs(text)


ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r "),
    (4, "a\x85b\xa0c \x1cd"),
    (5, "x " * 6),
    (5, "x " * 6),
    (None, "y y y y y y z"),
    (20, "a b c " * 5 + "a"),
    (44, "one"),
    (45, "é ß é ß é ß é ß\né ß"),
]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    texts = [(k, " ".join(rng.choice("abcd") * rng.randrange(1, 3) for _ in range(rng.randrange(120)))) for k in range(100, 400)]
    return ODD + texts + [(7, "p q " * 20_000), (8, " ".join(str(i % 5000) for i in range(21_000)))]


def test_report_equals_brute_force(spark, rows):
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, start long, n_runs string")
    got = periodic.periodic_runs(docs, planted=True).drop("n_dropped").collect()
    short = [r for r in rows if r[1] is None or len(r[1]) < 2000]
    wanted = [slow_report(k, t, planted=k is not None) for k, t in short]
    long = {r["doc_id"]: r for r in got if r["doc_id"] in (7, 8)}
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in got if r["doc_id"] not in (7, 8)), key=key) == sorted(wanted, key=key)
    assert (long[7]["start"], long[7]["length"], long[7]["period"]) == (0, 40_000, 2)
    assert (long[8]["start"], long[8]["length"], long[8]["period"]) == (0, 21_000, 5000) and long[8]["n_runs"] == 1


def test_empty_table(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_brute_force_on_whole_texts(spark):
    from gramwise.llm.queries import BOOK

    sf = "/root/testdata/sf0.001"
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r)[:8] for r in BOOK.queries["op12_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        if len(text) < 6000:
            assert got[doc_id] == slow_report(doc_id, text)
