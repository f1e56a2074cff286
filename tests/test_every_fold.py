"""Scores of all events, each by the quantiles of the folds that do not hold it."""

import duckdb
import pytest

from gramwise.catalog import all_queries, all_sql
from tools.check_queries import canonical

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["win4_pit_and_crps_of_every_fold", "uq1_interval_scores_of_every_fold"])
def test_every_event_is_scored(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    df = all_queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(canonical(r) for r in df.select(*columns).collect())
    rel = con.sql(all_sql()[name])
    order = [rel.columns.index(c) for c in columns]
    assert got == sorted(canonical([row[i] for i in order]) for row in rel.fetchall())
    if name.startswith("win4"):
        assert len(got) == spark.read.parquet(f"{SMALL}/events.parquet").count()
