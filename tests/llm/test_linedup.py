"""Line dedup against a brute-force version and the registered SQL."""

import hashlib

import duckdb

from gramwise.llm import linedup


def slow(rows, least=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    def key(line):
        return line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(lower)
    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= least:
                first[key(line)] = min(doc, first.get(key(line), doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(key(x)) < least or first[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


ROWS = [
    (5, "A shared long line\nonly five\n  a SHARED long line \t\nshort"), (2, "a shared long line\na shared long line\n\n"), (9, None), (8, ""), (7, "\n\n\n"),
    (11, "A shared long line"), (12, "été partagé ici\nx" * 3), (13, "ÉTÉ partagé ici\nété partagé ici"), (14, "\x0bA shared long line\x0c\n" * 2000 + "own ending here"),
    (2, "another text of two\na shared long line"), (None, "a shared long line\nonly once in null"), (20, "only once in null"), (5, "A shared long line\nonly five\n  a SHARED long line \t\nshort"),
]


def test_rows_equal_brute_force(spark):
    docs = spark.createDataFrame([(d, t, 0, [1]) for d, t in ROWS], "doc_id long, text string, n_lines int, runs array<int>")
    got = linedup.drop_repeated_lines(docs)
    assert set(got.columns) == {"doc_id", "text", "n_lines", "runs", "n_dropped"}
    rows = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()), key=str)
    assert rows == slow(ROWS)


def test_frequent_lines_take_the_same_way_out(spark):
    rows = [(k, f"the same header line\nline of {k % 7} groups of sevens\nown line number {k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow(rows)
    for hot in (1, 1000):
        runs = {r["doc_id"]: r["keep_runs"] for r in linedup.keep_bitmaps(docs, hot_lines=hot).collect()}
        assert len(runs) == 59 and runs[6] == [0, 1] and runs[20] == [0, 2]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in linedup.drop_repeated_lines(docs).collect()), key=str)
    assert got == want


def test_empty_table_and_sql(spark, tmp_path):
    assert linedup.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    con = duckdb.connect()
    rows = [r for r in dict(ROWS).items() if r[0] is not None]
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = sorted(con.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({linedup.DEDUP_SQL})").fetchall())
    assert got == sorted((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in slow(rows))


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = linedup.drop_repeated_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
