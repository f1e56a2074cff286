"""Packing: token ids as by the library, every piece placed once, sequences gapless and few."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gramwise.llm import packing
from gramwise.llm.wordpieces import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "It's <|endoftext|> here", "á Å Straße İstanbul ΣΑΣ x\x1cy '_.'s!!'t  12 3", "日本語 テスト 🙂👍", "é  x y", "word " * 9000,
    "x" * 30_000, "A\tB\nC\r\nD", "DON'T don't 'TIS I'll we've", "½ ² Ⅷ ٣", "same same", "same same",
]


@pytest.mark.parametrize("most", [3, 100, 400_000])
def test_ids_equal_the_library(most):
    library, own = Tokenizer.from_file(PATH), WordTokenizer(PATH, most=most, most_words=most)
    for text in [*TEXTS, *TEXTS]:
        assert own.ids(text).tolist() == library.encode(text or "", add_special_tokens=False).ids


def check(rows, texts, capacity):
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for doc, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            want[(doc, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r["length"] for r in rows) // capacity)


def test_documents_are_packed_whole(spark):
    texts = [*enumerate(TEXTS), (3, "again with an id seen before"), (None, "no id")]
    docs = spark.createDataFrame([(d, t, 0, 0) for d, t in texts], "doc_id long, text string, length int, rank int")
    used, bound = check(packing.pack_documents(docs, PATH, capacity=512).collect(), texts, 512)
    assert used <= bound + 1


def test_empty_table(spark):
    got = packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() == 0


def test_plan_holds_everything_in_few_sequences():
    rng = np.random.default_rng(0)
    for sizes in (rng.integers(1, 257, 4000), np.minimum(256, rng.geometric(0.02, 3000)), np.array([100] * 50 + [56] * 50 + [129] * 30), np.array([256] * 9), np.array([1])):
        counts = Counter(sizes.tolist())
        plan = packing.packing_plan(counts, 256)
        held = Counter()
        for lengths, copies in plan:
            assert sum(lengths) <= 256 and copies > 0
            held.update({v: lengths.count(v) * copies for v in set(lengths)})
        assert held == counts
        used, bound = sum(c for _, c in plan), -(-int(sizes.sum()) // 256)
        best_fit = sum(c for _, c in packing._fill_gaps([], dict(counts), 256))
        assert used <= max(bound, best_fit) * 1.005 + 1


def test_program_solves_a_known_case():
    used = packing.configuration_program([6, 4], [60, 60], 10, step=0.05)  # sizes 6 and 4 fill 10 together: 60 sequences
    assert 60 <= sum(used.values()) < 66
    for k, wanted in ((0, 60), (1, 60)):
        assert sum(times * dict(name).get(k, 0) for name, times in used.items()) >= wanted - 1e-6


def test_knapsack_equals_exhaustive_search():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes, most = sorted(rng.integers(1, 12, 4).tolist(), reverse=True), rng.integers(1, 4, 4).tolist()
        value = rng.random(4).tolist()
        filling = packing._best_filling(sizes, value, most, 20)
        assert sum(sizes[k] * n for k, n in filling.items()) <= 20 and all(n <= most[k] for k, n in filling.items())
        free = [20 // s for s in sizes]
        best = 0.0
        for n in np.ndindex(*[f + 1 for f in free]):
            if np.dot(n, sizes) <= 20:
                best = max(best, float(np.dot(n, value)))
        whole = packing._best_filling(sizes, value, free, 20)
        assert sum(value[k] * n for k, n in whole.items()) == pytest.approx(best)


@pytest.mark.parametrize("times", [1, 40])
def test_program_places_most_pieces_at_the_bound(times):
    """The share of long pieces that configurations place, and the sequences against the least possible number."""
    rng = np.random.default_rng(2)
    sizes = np.minimum(4095, np.maximum(1, rng.lognormal(6.4, 1.1, 6000).astype(int)))
    counts = {int(k): int(n) * times for k, n in zip(*np.unique(sizes, return_counts=True), strict=True)}
    plan, placed = packing._planned(counts, 4096, 16, 96)
    held = Counter()
    for lengths, copies in plan:
        held.update({v: lengths.count(v) * copies for v in set(lengths)})
    large = sum(n for k, n in counts.items() if k > 256)
    assert held == counts and placed >= 0.8 * large
    assert sum(c for _, c in plan) <= -(-sum(k * n for k, n in counts.items()) // 4096) * 1.003 + 1


def test_batches_equal_single_texts():
    own, single = WordTokenizer(PATH, most=9, most_words=5), WordTokenizer(PATH)
    texts = pa.array([None, *TEXTS, "z" * 100 + " short " + "z" * 100])
    for part in (texts, texts.slice(3, 9), texts.slice(0, 0)):
        ids, starts = own.batch(part)
        assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [single.ids(t).tolist() for t in part.to_pylist()]
    assert all(len(u) <= 64 for u in (*own.units, *own.words))
