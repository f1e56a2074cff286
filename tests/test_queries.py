"""Registered queries against DuckDB on the smallest tables.

A spread of areas runs by default; GRAMWISE_ALL_QUERIES=1 runs every query.
"""

import os
from pathlib import Path

import duckdb
import pytest

from gramwise.catalog import all_queries, all_sql
from tools.check_queries import canonical

SMALL = Path("/root/testdata/sf0.001")
DEFAULT = (
    "src4_delimited", "snk3_csv_four_decimals", "prj4_label_codes", "prj5_dummies_drop_first", "prj20_set4_fractional_rows", "scalar_functions",
    "smp4_train_test_exact", "smp5_stratified_split", "smp10_weighted_resample", "p6_win5_prefix_rank", "win1_quantile_edges", "agg9_median",
    "agg11_accuracy_auc", "agg24_pivot", "mod1_least_squares", "ssl1_calibration_weights", "ssl11_ssl12_debiased_linear", "ssl6_partial_information",
    "shf7_corrected_prior", "shf1_agg20_penalty_path", "cat2_two_learner", "cat6_udf3_known_nuisances", "spr2_mcp_cross_validation", "jon5_neighbour_votes", "uq1_interval_scores",
)
NAMES = sorted(all_sql()) if os.environ.get("GRAMWISE_ALL_QUERIES") else DEFAULT


@pytest.fixture(scope="module")
def con():
    if not SMALL.exists():
        pytest.skip("the test tables are not here")
    connection = duckdb.connect()
    for path in SMALL.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    df = all_queries()[name](spark, str(SMALL))
    columns = sorted(df.columns)
    got = sorted(canonical(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    rel = con.sql(all_sql()[name])
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert [rel.columns[i] for i in order] == columns
    assert got == sorted(canonical([row[i] for i in order]) for row in rel.fetchall())
    assert got


def test_every_sql_belongs_to_a_query():
    assert set(all_sql()) <= set(all_queries())
