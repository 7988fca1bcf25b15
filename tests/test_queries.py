"""Every registered query beside its SQL, and what its plan must not contain."""

import duckdb
import pytest

import __spark_entry__ as entry
from momentloom.plans.catalog import QUERIES
from tools.compare import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


#: Queries of the optional subpackage have tests of their own.
NAMES = [n for n in entry.queries() if n in QUERIES]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, db, name):
    note, _, _ = compare(spark, db, name, SF)
    assert note.startswith(("ok", "rows-only")) and "TYPES" not in note, note


def plan_of(df):
    qe = df._jdf.queryExecution()
    return qe.executedPlan().toString()


# Queries that run a stream or write a stage while they are built.
EAGER = ("str_", "trk_07", "trk_09", "rk_01", "nov_04")


@pytest.mark.parametrize("name", [n for n in NAMES if not n.startswith(EAGER)])
def test_plan_has_no_product_or_nested_loop(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_top_k_limits_groups_before_the_shuffle(spark):
    for name in ("rk_03_top_k", "pst_03_admit_by_quota", "int_17_minute_index"):
        assert "WindowGroupLimit" in plan_of(entry.queries()[name](spark, SF)), name


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(entry.queries()["sig_01_rms"](spark, SF))
    assert "EqualTo(event_type,view)" in plan and "props" not in plan
    assert "PushedFilters: [IsNotNull(o_orderstatus)" not in plan_of(entry.queries()["an_07_total_cost"](spark, SF))
    assert "ReadSchema: struct<o_totalprice:double>" in plan_of(entry.queries()["an_07_total_cost"](spark, SF))


def test_entry(spark):
    assert entry.entry(spark).columns == ["episode_id", "window_id", "start_ms", "end_ms", "word_count", "transcript", "sentence_count"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
