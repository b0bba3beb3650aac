"""Every registered query against its DuckDB statement, and the shape of the plans that matter at scale."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from registry import load
from tools import check

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = check.connect(FOLDER)
    assert isinstance(connection, duckdb.DuckDBPyConnection)
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    ok, _, note = check.compare(spark, con, name, FOLDER)
    assert ok is not False, note


def test_only_the_file_reader_has_no_sql():
    builds, statements = load()
    assert set(builds) - set(statements) == {"a3_read_blobs"}
    assert set(ORACLES) <= set(QUERIES)


def test_entry_is_not_empty(spark):
    found = entry_module.entry(spark)
    assert found.columns == ["gallery", "doc_id"] and found.count() == 83


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["unseen_posts_selection", "c1_moderation_holdback", "c3_cap_media_per_post", "f2_dedup_within_post",
                                  "f5_dedup_anchored", "g1_rate_limit", "h8_resolve_candidates"])
def test_windows_are_limited_before_the_shuffle(spark, name):
    text = plan(spark, name)
    windows = text.count(" Window [row_number()")
    assert windows > 0 and text.count("WindowGroupLimit") >= windows and "Partial" in text


@pytest.mark.parametrize("name", ["c5_newest_feed", "c6_recent_store", "f6_recent_keys"])
def test_recent_rows_are_a_distributed_top_k(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


@pytest.mark.parametrize("name", ["b2_extract_rows_hybrid", "b7_extract_media_all", "b8_extract_media_first"])
def test_extraction_does_not_shuffle(spark, name):
    text = plan(spark, name)
    assert "MapInPandas" in text and "Exchange" not in text


@pytest.mark.parametrize(("name", "pushed"), [("e9_prune_count", "o_orderdate"), ("d8_snapshot_diff", "LessThan(o_orderdate"), ("e8_like_counts", "ReadSchema: struct<props:string>"),
                                             ("g1_rate_limit", "ReadSchema: struct<ts:")])
def test_scans_read_and_filter_little(spark, name, pushed):
    text = plan(spark, name)
    assert pushed in text and "o_totalprice" not in text and "value:double" not in text


def test_no_python_outside_extraction_and_state(spark):
    for name in QUERIES:
        if name[:2] in ("c3", "d1", "d4", "e3", "f5", "f7", "g1", "h7", "h8", "j6", "l2"):
            text = plan(spark, name)
            assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text and "InPandas" not in text, name
