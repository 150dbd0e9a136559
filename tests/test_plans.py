"""Registered queries: equality with DuckDB, and the shape of their plans."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from askloom.operators import related
from askloom.plans.bind import RAW, Tables
from tools.check import rows

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
# The training-data queries have tests of their own.
COMPARED = [n for n in sorted(ORACLE) if not re.match(r"op[0-9]+_|pipeline", n)]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in RAW:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", COMPARED)
def test_equals_duckdb(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rel = duck.execute(ORACLE[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, rel.fetchall())


def plan(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


LAZY = [n for n in sorted(QUERIES) if not re.match(r"op[0-9]+_|pipeline|flagship|.*stream|ingest_recent|search_with|batch_search|index_|page_chains|search_miss|related_(by_k|top|cache_w)|grant_week|keyed_store|merged_stats|detect_charset", n)]


def test_no_cross_joins_and_no_row_at_a_time_python(spark, sf_dir):
    for name in LAZY:
        text = plan(spark, sf_dir, name)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert "BatchEvalPython" not in text, name


@pytest.mark.parametrize("name", ["limit_per_source", "chat_context", "recent_sessions"])
def test_top_n_per_key_is_limited_before_the_shuffle(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert re.search(r"WindowGroupLimit.*Partial", text), text


@pytest.mark.parametrize("name", ["browse_page", "miss_list", "question_list", "category_top", "payment_list", "donation_list"])
def test_pages_are_top_k(spark, sf_dir, name):
    assert "TakeOrderedAndProject" in plan(spark, sf_dir, name)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(spark, sf_dir, "donation_stats")
    assert "EqualTo(event_type,purchase)" in text
    assert "props" not in text.split("ReadSchema")[1].split(">")[0]
    text = plan(spark, sf_dir, "canonical_url")
    assert "html" not in text.split("ReadSchema")[1].split(">")[0]


def test_chunks_are_limited_before_they_meet_the_vocabulary(spark, sf_dir):
    records = Tables(spark, sf_dir).records
    words = records.selectExpr("explode(split(question, ' ')) AS keyword").distinct()
    text = related.keyword_matches(records, words, 10)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"WindowGroupLimit.*Partial", text)) == 2 and "CartesianProduct" not in text


def test_costly_plans_have_no_cross_join(spark, sf_dir):
    records = Tables(spark, sf_dir).records
    for df in (related.related_by_category(records), related.related_records(records)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text


def test_entry(spark):
    assert entry.entry(spark).columns == ["source", "inserted", "skipped", "failed", "parsed_none"]
