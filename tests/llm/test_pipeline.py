"""The pipeline stage by stage against brute force, on the smallest tables and on odd rows."""

import sys
from collections import Counter
from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from gramwise.llm import langid  # noqa: E402
from tests.llm.test_linedup import slow as slow_lines  # noqa: E402
from tests.llm.test_simhash import slow_groups, slow_print  # noqa: E402

SF = "/root/testdata/sf0.001"


def check(spark, docs, tmp_path):
    columns = docs.columns
    model = langid.learn(docs, ~langid.held_out())
    rows = docs.collect()
    want = [r for r in rows if (model.predict(r["text"])[2] if model.languages else langid.letters_only(r["text"]))]
    got = corpus_pipeline.language_id(spark, docs, SF)
    assert got.columns == columns and Counter(map(str, got.collect())) == Counter(map(str, want))

    got.write.parquet(f"{tmp_path}/a")
    docs = spark.read.parquet(f"{tmp_path}/a")
    got = corpus_pipeline.line_dedup(spark, docs, SF)
    assert got.columns == columns
    pairs = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()), key=str)
    assert pairs == sorted(((d, t, len(t)) for d, _, _, t in slow_lines([(r["doc_id"], r["text"]) for r in docs.collect()])), key=str)

    got.write.parquet(f"{tmp_path}/b")
    docs = spark.read.parquet(f"{tmp_path}/b")
    got = corpus_pipeline.simhash_near_dedup(spark, docs, SF)
    rows = docs.collect()
    groups = slow_groups({r["doc_id"]: slow_print(r["text"]) for r in rows if r["doc_id"] is not None})
    assert got.columns == columns
    assert Counter(map(str, got.collect())) == Counter(str(r) for r in rows if r["doc_id"] is None or groups[r["doc_id"]] == r["doc_id"])

    got.write.parquet(f"{tmp_path}/c")
    docs = spark.read.parquet(f"{tmp_path}/c")
    pieces = corpus_pipeline.best_fit_packing(spark, docs, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = Counter()
    for r in pieces:
        lengths[r["doc_id"]] += r["length"]
    assert lengths == Counter({r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect()})
    return Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in pieces)


def test_stages_on_the_given_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = check(spark, docs, tmp_path)
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got) == want


def test_stages_on_odd_rows(spark, tmp_path):
    words = "the house of the old town and the river that was in the valley ".split()
    rows = [(k, " ".join(words[k % 5 :] + [f"word{k}"] * (k % 3)) + f"\nA line that all of them have\nown ending {k}", "en" if k % 4 else None, "s", 0) for k in range(40)]
    rows += [(50, None, "en", "s", 0), (51, "", "en", None, None), (52, "12 !", "en", "s", 0), (None, "the old town has no id here", "en", "s", 0)]
    rows += [(60, rows[3][1], "en", "s", 0), (61, rows[3][1], "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    check(spark, spark.createDataFrame(rows, schema), tmp_path)


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs
