"""Plan shape: what reaches the scan, and what never leaves the JVM."""
import io
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as E
from vendorlake.plans import registry as R

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                "PythonUDF")
JVM_ONLY = ["daily_revenue", "executive_summary", "pricing_summary", "settlement_report",
            "quality_gate", "batch_ledger", "trace_order", "review_queue", "table_diff",
            "invoice_summary", "test_report"]


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", JVM_ONLY)
def test_no_python_in_sql_paths(spark, sf, name):
    p = plan(E.queries()[name](spark, sf))
    assert not any(n in p for n in PYTHON_NODES), name
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_marts_prune_columns(spark, sf):
    p = plan(E.queries()["daily_revenue"](spark, sf))
    assert "o_orderpriority" not in p          # unused column never read
    assert "c_acctbal" not in p and "c_mktsegment" not in p


def test_lineage_filter_pushes_down(spark, sf):
    p = plan(E.queries()["lineage_filter"](spark, sf))
    assert "PushedFilters" in p
    assert "EqualTo(stage,awaiting_review)" in p
    assert "StringStartsWith(source_file,vendor_orders_2024-01-1)" in p


def test_settlement_has_no_window_over_data_keys(spark):
    """Dedupe and first decision are aggregate + equi-join (skew-safe)."""
    from vendorlake.operators.settlement import settle
    records = spark.createDataFrame([], "batch_id string, _source_file string, _line long, order_ref string, "
                                        "vendor string, item_count int, _submitted decimal(38,10), parse_error string")
    contracts = spark.createDataFrame([], "vendor string, unit_rate double, discount_pct double")
    decisions = spark.createDataFrame([], "batch_id string, vendor string, order_ref string, decision_id long, "
                                          "decision string, note string, delay_s double")
    p = plan(settle(records, contracts, decisions))
    assert "HashAggregate" in p or "SortAggregate" in p
    assert "Window" not in p
