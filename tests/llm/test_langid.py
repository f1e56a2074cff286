"""Language identification: held-out accuracy, rejection, and inputs that are no inputs."""

from pyspark.sql import functions as F

from gramwise.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs, ~langid.held_out())
    assert model.languages == ["de", "en", "es", "fr"]
    got = langid.predict_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").withColumn("held", langid.held_out())
    held = got.where("held").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.avg(F.col("accepted").cast("int")).alias("kept")).first()
    assert held["right"] > 0.97 and held["kept"] > 0.98
    for text in ("Быстрая коричневая лиса прыгает", "これは日本語の文章です", "ქართული ენა არის"):
        assert model.predict(text)[2] is False
    for text in (None, "", "12 34 !!", "___"):
        assert model.predict(text) == ("und", 0.0, False)
    assert 0 <= model.predict("a" * 3_000_000)[1] <= 1


def test_only_text_decides_and_odd_tables(spark):
    rows = [(k, ("the of and to in that is was " if k % 2 else "der die und das ist nicht von zu ") * 3, "en" if k % 2 else "de", "s", 0.5) for k in range(60)]
    rows += [(100, None, "en", None, 0.1), (101, "the of and", None, None, 0.1), (None, "der die und", "en", None, 0.1), (1, rows[1][1], "en", "s", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    got = langid.identify_languages(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[101]["lang_pred"] == "en" and by[None]["lang_pred"] == "de" and by[100]["lang_pred"] == "und" and by[None]["held_out"]
    assert all(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de") for r in got if r["doc_id"] is not None and r["doc_id"] < 60)
    again = langid.identify_languages(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert langid.identify_languages(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_numerals_are_no_letters():
    assert all(langid.letters_only(t) == b"" for t in ("²", "½ ² Ⅷ", "①②", "١٢", "_ 12 ³", "\u0301"))
    assert langid.letters_only("a² b½Ⅷ ªº é") == " a b ªº é ".encode()
    assert langid.LanguageModel(["de"], __import__("numpy").zeros((1 << 4, 1)), 1.0, 0.0, 4).predict("½ ② ²") == (langid.UNKNOWN, 0.0, False)
