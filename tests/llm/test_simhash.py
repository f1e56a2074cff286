"""SimHash groups against a brute-force version."""

import numpy as np
import pytest
import xxhash

from gramwise.llm import simhash
from gramwise.llm.components import connected_components


def slow_print(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def slow_groups(prints, radius=4):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_groups_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = " ".join(f"w{rng.integers(50)}" for _ in range(300))
    texts = [None, "", " \t\n", "One two", "ONE two", "É É é", base, base.upper(), base + " tail", "x" * 200_000]
    texts += [base.replace("w7 ", f"v{k} ", 1) for k in range(25)] + [" ".join(f"w{rng.integers(900)}" for _ in range(40)) for _ in range(120)]
    rows = list(enumerate(texts)) + [(3, "One two")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = simhash.simhash_groups(docs).collect()
    assert len(got) == len(rows)
    prints = {i: slow_print(t) for i, t in rows}
    groups = slow_groups(prints)
    for r in got:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == groups[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == groups[r["doc_id"]])


@pytest.mark.parametrize("parts", [2, 4])
def test_near_links_find_every_pair(spark, parts):
    rng = np.random.default_rng(parts)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    values = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(12):
            values.add(int(np.bitwise_xor.reduce([s, *(np.int64(1) << np.int64(k) for k in rng.choice(63, rng.integers(1, 6), False))])))
    rows = sorted(values)
    prints = {i: v for i, v in enumerate(rows)}
    df = spark.createDataFrame([(v, i) for i, v in prints.items()], "fp long, rep long")
    links = simhash.near_links(df, tile_rows=37).collect()
    assert all((prints[r["u"]] ^ prints[r["v"]]) >= 0 for r in links)
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = slow_groups(prints)
    assert {i: found.get(i, i) for i in prints} == want


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(empty).count() == 0
    got = simhash.simhash_groups(spark.createDataFrame([(None, "a b"), (1, "a b")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(None, None), (1, 1)}
