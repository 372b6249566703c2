"""Every query with a SQL twin gives the same rows on sf0.001, and joins by keys only."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from werkbank import oracle, registry

DIRECTORY = "/root/testdata/sf0.001"
QUERIES, SQL = registry.QUERIES, oracle.ORACLE


@pytest.fixture(scope="module")
def db():
    return connect(DIRECTORY)


def test_every_query_has_a_twin():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, db, name):
    problem, _, _ = compare(spark, db, name, QUERIES[name], SQL[name], DIRECTORY)
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("stream_", "stored_", "daily_", "latest_"))))
def test_no_cross_join(spark, name):
    plan = QUERIES[name](spark, DIRECTORY)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    assert entry.entry(spark).columns == ["year", "month", "revenue", "order_count"]


@pytest.mark.parametrize("name", ["conversation_context", "retrieval_context", "draft_query"])
def test_last_turns_are_cut_before_the_shuffle(spark, name):
    plan = QUERIES[name](spark, DIRECTORY)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_no_table_is_hinted_for_broadcast():
    import pathlib

    root = pathlib.Path(entry.__file__).parent.joinpath("werkbank")
    assert not [line for path in root.rglob("*.py") if "llm" not in path.parts
                for line in path.read_text().splitlines() if "F.broadcast(" in line]


def test_no_local_folders():
    import pathlib

    root = pathlib.Path(entry.__file__).parent.joinpath("werkbank")
    assert not [path for path in root.rglob("*.py") if "tempfile" in path.read_text()]


# Ordered scans and document chains store a table when they are built; nothing else runs by itself.
@pytest.mark.parametrize("name", ["filter_orders_newest", "forecast_components", "website_sessions", "search_inventory_cpu"])
def test_nothing_runs_before_the_caller_acts(spark, name):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    QUERIES[name](spark, DIRECTORY)
    assert len(tracker.getJobIdsForGroup(None)) == before


def test_channels_do_not_deal_the_headers(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["order_headers"](spark, DIRECTORY)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(Vertreter" not in plan


def test_entry_without_the_llm_folders(tmp_path):
    """The driver may delete them."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(entry.__file__).parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "werkbank", tmp_path / "werkbank", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and set(q) == set(e.oracle_sql()); print(len(q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert not any(n.startswith(("op1_", "pipeline")) for n in QUERIES)


@pytest.mark.parametrize("name, scans", [("order_items", 6), ("order_item_rejects", 6), ("rebuild_logs", 8), ("incident_states", 6),
                                         ("missing_components", 8), ("open_order_shortages", 8), ("affected_orders", 8), ("co_purchase_pairs", 8),
                                         ("reprompt_history", 3), ("co_purchase_summary", 6)])
def test_plans_read_each_table_few_times(spark, name, scans):
    """What several parts of a plan need is stored once or comes from one run (the logs of ``reprompt_history`` alone read
    three tables)."""
    plan = QUERIES[name](spark, DIRECTORY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= scans
    assert plan.count("hashpartitioning") <= 14
