"""LM scores: counts against brute force, probabilities that add up, and better than single-token counts on unseen text."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from gramwise.llm import mixing

SF = "/root/testdata/sf0.001"


def slow_base(rows):
    def tokens(text):
        return [*(text or "").encode().lower().split(), None]

    def out(doc):
        return doc is None or zlib.crc32(str(doc).encode()) % 7 == 2

    counts = Counter(t for doc, text in rows if not out(doc) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    return sorted(
        ((str(d), out(d), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), total, round(sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in tokens(t)), 6)) for d, t in rows),
        key=str,
    )


@pytest.mark.parametrize("frequent", [20, 131_071])
def test_counts_equal_brute_force(spark, frequent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(None, "the of unseenword"), (7001, None), (7002, ""), (7003, "the " * 60_000 + "x" * 5000), (7003, "again")]
    table = spark.createDataFrame([(d, t, 0, 0.5) for d, t in rows], "doc_id long, text string, n int, score double")
    got = mixing.score_documents(table, frequent=frequent, sizes=(20, 18), sample=40).collect()
    own = sorted(((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str)
    assert own == slow_base(rows)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    if frequent > 20:
        held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 7000]
        # the base takes all unknown words for one; the model spells them, in about three more digits on this little text
        unknown = sum(r["n_tokens"] - r["n_known"] for r in held)
        gap = (sum(r["base_score"] for r in held) - sum(r["score"] for r in held)) / unknown
        bits = np.mean([r["bits_per_byte"] for r in held])
        assert gap < 4 and bits < 5, (gap, bits)


def test_probabilities_add_up():
    rng = np.random.default_rng(1)
    frequent = [(b"w%d" % k, int(n)) for k, n in enumerate(sorted(rng.integers(1, 90, 30), reverse=True))]
    code = mixing.Code.of(frequent, 25)
    sizes = (10, 9)
    tables = [rng.integers(0, 50, (1 << 10, 2)) for _ in range(2)]
    model = mixing.Model(code, tables, [rng.integers(0, 50, (1 << 9, 2)) for _ in range(3)], sizes)
    model.weights = rng.normal(0.3, 0.3, model.weights.shape)
    model.refine += rng.normal(0, 0.5, model.refine.shape)
    model = model.frozen()
    symbols = np.arange(31)
    e = mixing.code_events(code, symbols, np.full(31, 4), np.full(31, 9), 10)
    assert abs((2 ** np.bincount(e.owner, model.bits(e), 31)).sum() - 1) < 1e-5
    endings = [bytes([65, k]) for k in range(256)]
    e = mixing.spelling_events(endings, 9)
    second = 2 ** np.bincount(e.owner, np.where((np.arange(len(e.owner)) // 8) % 3 == 1, model.bits(e), 0), 256)
    assert abs(second.sum() - 1) < 1e-5


def test_no_text_to_learn_from(spark):
    kind = "doc_id long, text string"
    assert mixing.score_documents(spark.createDataFrame([], kind)).count() == 0
    out = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    got = mixing.score_documents(spark.createDataFrame([(out, "some words")], kind)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(3, 0, 0, 0.0)] and math.isfinite(got[0]["score"])


def test_weights_learn_from_every_text(spark):
    """Only texts behind the 300 of smallest order hold rare words, so the gates of spelling move only where these are read."""
    from pyspark.sql import functions as F

    place = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30))
    ids = [r["id"] for r in spark.range(330).orderBy(place).collect()]
    rows = [(k, "the house of the town" if n < 300 else f"the house rare{k} of word{k}x") for n, k in enumerate(ids)]
    training = spark.createDataFrame(rows, "id long, text string").select(F.xxhash64(F.col("id").cast("string")).alias("order"), "text")
    start = mixing.Model(mixing.Code.of([], 1), [], [], (10, 9))
    model, *_ = mixing.learn(training, sizes=(10, 9))
    assert np.abs(model.weights[:16] - start.weights[:16]).max() > 1e-3
    assert np.abs(model.weights[16:] - start.weights[16:]).max() > 1e-3
    several, *_ = mixing.learn(training.repartition(5), sizes=(10, 9), share=300)
    again, *_ = mixing.learn(training, sizes=(10, 9), share=300)
    assert np.abs(several.weights[16:] - start.weights[16:]).max() > 1e-3
    assert np.allclose(several.weights, again.weights, atol=1e-6) and np.allclose(several.refine, again.refine, atol=1e-5)


def test_pieces_of_a_batch_hold_the_words_of_its_texts(monkeypatch):
    """Arrow's lower case goes wrong on arrays cast from slices, so pieces are compared with Python's words."""
    import pyarrow as pa

    texts = ["Aé b  C\t", None, "", "\x0bonly one", " \n ", *(f"Über {k} The END{k}\x85 x\x1cy" for k in range(40))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    monkeypatch.setattr(mixing, "_PIECE", 64)
    got = []
    for piece in mixing.pieces(iter([batch])):
        tokens = mixing.Words.of(piece.column("text"))
        own = [[] for _ in range(tokens.texts)]
        for owner, number in zip(tokens.owner.tolist(), tokens.number.tolist(), strict=True):
            own[owner].append(tokens.distinct[number])
        got.append(own)
    assert len(got) > 5
    assert [t for own in got for t in own] == [[*(t or "").encode().lower().split(), b""] for t in texts]


def test_events_of_a_code_spell_each_symbol_in_its_context():
    """Every symbol's bits, node by node, and slots that depend on the two symbols before and the node alone."""
    rng = np.random.default_rng(3)
    code = mixing.Code.of([(b"w%d" % k, int(n)) for k, n in enumerate(sorted(rng.integers(1, 900, 50), reverse=True))], 7)
    symbols, before, before2 = (rng.integers(0, 51, 400).astype(np.int32) for _ in range(3))
    e = mixing.code_events(code, symbols, before, before2, 12)
    assert np.array_equal(np.bincount(e.owner, minlength=400), code.lengths[symbols])
    walks = {}
    slots = {}
    for owner, step, last, last2 in zip(e.owner.tolist(), *(s.tolist() for s in e.slots), strict=True):
        walks.setdefault(owner, []).append(step)
        assert last & 1 == last2 & 1 == step & 1
        assert slots.setdefault((before[owner], step >> 1), last >> 1) == last >> 1
        assert slots.setdefault((before[owner], before2[owner], step >> 1), last2 >> 1) == last2 >> 1
    by_symbol = {}
    for owner, walk in walks.items():
        assert by_symbol.setdefault(symbols[owner], tuple(walk)) == tuple(walk)
    assert len(set(by_symbol.values())) == len(by_symbol)
    counts = np.zeros_like(code.counts)
    np.add.at(counts.ravel(), code.levels.T[np.arange(len(code.levels)) < code.lengths[:, None]], np.repeat([*code.weights, 7], code.lengths))
    assert np.array_equal(counts, code.counts)


def test_fit_is_the_likeliest_for_counted_cells():
    """The score's answers equal the mixed and refined logit written out, and no small move of the weights is likelier."""
    rng = np.random.default_rng(5)
    code = mixing.Code.of([(b"w%d" % k, 60 - k) for k in range(30)], 4)
    model = mixing.Model(code, [rng.integers(0, 50, (1 << 10, 2)) for _ in range(2)], [rng.integers(0, 50, (1 << 9, 2)) for _ in range(3)], (10, 9))
    e = mixing.code_events(code, *rng.integers(0, 31, (3, 20_000)).astype(np.int32), 10)
    seen = np.bincount(model.left_out().cells(e), minlength=mixing._ROWS << mixing._CELLS + 1).reshape(mixing._ROWS, -1, 2)
    start = model.weights.copy()
    model.fit(list(seen))
    x, gate = mixing._cell_inputs()
    total = seen[:16].sum(axis=0)

    def loss(weights):
        z = np.einsum("ij,ij->i", x, weights[gate])
        return total[:, 0] @ np.logaddexp(0, z) + total[:, 1] @ np.logaddexp(0, -z) + 8 * ((weights - start) ** 2).sum()

    best = loss(model.weights)
    assert best < loss(start) - 1
    for g in set(gate[total.any(axis=1)].tolist()):
        for k in range(4):
            for move in (-1e-2, 1e-2):
                other = model.weights.copy()
                other[g, k] += move
                assert loss(other) >= best - 1e-6
    frozen = model.frozen()
    cell = frozen.cells(e)
    row, inner, bit = cell >> 18, cell >> 1 & (1 << 17) - 1, cell & 1
    mixed = np.clip(np.einsum("ij,ij->i", x[inner], model.weights[gate[inner]]), -12, 12)
    knots = np.linspace(-12, 12, 33)
    final = np.array([0.5 * m + 0.5 * np.interp(m, knots, model.refine[r]) for m, r in zip(mixed[:500], row[:500], strict=True)])
    assert np.allclose(frozen.bits(e)[:500], -np.logaddexp(0, np.where(bit[:500], -final, final)) / np.log(2), atol=1e-4)


def test_weights_do_not_depend_on_how_texts_are_dealt(spark):
    rows = [(k, f"the house rare{k % 50} of word{k}x and the town{k % 7}") for k in range(400)]
    training = spark.createDataFrame(rows, "order long, text string")
    one, *_ = mixing.learn(training.repartition(1), sizes=(10, 9))
    many, *_ = mixing.learn(training.repartition(6), sizes=(10, 9), share=100)
    assert np.array_equal(one.weights, many.weights) and np.array_equal(one.refine, many.refine)


def test_words_are_spelt_alike_one_by_one_and_by_kinds_of_bytes(monkeypatch):
    monkeypatch.setattr(mixing, "_CHUNK", 16)
    rng = np.random.default_rng(8)
    model = mixing.Model(mixing.Code.of([], 1), [rng.integers(0, 50, (1 << 10, 2)) for _ in range(2)], [rng.integers(0, 50, (1 << 9, 2)) for _ in range(3)], (10, 9)).frozen()
    spelt = [b"a", b"banana", "Übergröße".encode(), b"x" * 300, b"\x1cy", *(b"ban%d" % k for k in range(60))]
    e = mixing.spelling_events(spelt, 9)
    assert np.allclose(model.spelt_bits(spelt), np.bincount(e.owner, model.bits(e)), atol=1e-3)
    assert np.allclose(model.spelt_bits(spelt), [model.spelt_bits([w])[0] for w in spelt], atol=1e-9)
