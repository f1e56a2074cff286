"""Run registered queries against their SQL on one folder of tables: python tools/check_queries.py <sf_dir> [name part ...]."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from gramwise.catalog import all_queries, all_sql  # noqa: E402
from gramwise.session import local_session  # noqa: E402


def family(kind: str) -> str:
    kind = kind.lower()
    for names, label in ((("bigint", "long", "hugeint"), "long"), (("integer", "int"), "int"), (("double",), "double"), (("varchar", "string"), "string")):
        if kind in names:
            return label
    return kind


def canonical(row) -> tuple:
    out = []
    for v in row:
        if isinstance(v, float) and (math.isnan(v) or v == 0.0):
            v = "nan" if math.isnan(v) else 0.0
        out.append((v is None, str(type(v).__name__ == "str"), str(v) if isinstance(v, (datetime.datetime, list)) else v))
    return tuple(out)


def main(sf_dir: str, parts: list[str]) -> int:
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    sql, bad = all_sql(), 0
    for name, fn in all_queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            columns = sorted(df.columns)
            got = sorted(canonical(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
            took = time.time() - start
            if name not in sql:
                print(f"{name}: rows only, {len(got)} rows, {took:.1f}s", flush=True)
                if not got:
                    bad += 1
                continue
            rel = con.sql(sql[name])
            order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
            names = [rel.columns[i] for i in order]
            want = sorted(canonical([row[i] for i in order]) for row in rel.fetchall())
            kinds = [family(dict(df.dtypes)[c]) for c in columns]
            theirs = [family(str(rel.types[i])) for i in order]
            problem = None
            if names != columns:
                problem = f"columns {columns} vs {names}"
            elif kinds != theirs:
                problem = f"types {list(zip(columns, kinds, theirs, strict=True))}"
            elif got != want:
                diff = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:3]
                problem = f"values: {len(got)} vs {len(want)} rows; " + " | ".join(
                    f"{[c[2] for c in a]} != {[c[2] for c in b]}" for a, b in diff
                )
            elif not got:
                problem = "no rows"
            bad += problem is not None
            print(f"{name}: {'ok' if problem is None else 'BAD ' + problem} {len(got)} rows {took:.1f}s", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name}: ERROR {type(e).__name__} {str(e)[:1500]}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
