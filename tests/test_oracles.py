"""Registered queries against their SQL twins on the smallest tables.

CHECK_QUERIES=all compares every query; the default is one or two per family.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, plain

SF = "/root/testdata/sf0.001"
QUICK = [
    "flagship", "norm_answer", "verdict", "scan_jsonl_items", "dataset_fingerprint", "fill_if_blank", "stratified_split",
    "waterfill_allocation", "validate_ids", "check_order_whole_table", "classify_glued_words", "bar_totals", "excerpt_owners",
    "cloze_items", "verify_items_train", "tiered_title_distractors", "place_options", "nested_options", "contaminated_items",
    "tally", "mc_report", "control_prior", "compare_runs", "cross_benchmark_correlation", "metric_merge",
    "test_side", "assemble_side", "content_units", "self_contradiction_join", "match_by_id",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("CHECK_QUERIES") == "all" else QUICK


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert mine == sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
