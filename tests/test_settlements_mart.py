"""The settlements mart: every step of its method, over the remittance of all batches."""
import pytest
from pyspark.sql import functions as F

from vendorlake.model import REMIT_COLUMNS
from vendorlake.plans import registry
from vendorlake.plans.jobs import reland_settlements


def test_the_settlements_mart_runs_the_models_tests(spark, sf):
    with pytest.warns(UserWarning, match="data tests failed.*order_ref.*unique"):
        mart = registry.q_settlements_mart(spark, sf)
    res = registry.relanded_settlements(spark, sf)
    got = {(r.column_name, r.test_name): r.failures for r in res["tests"].collect()}
    stg = res["stg_settlements"]
    assert len(got) == 10 and got["outcome", "accepted_values"] == got["vendor", "not_null"] == 0
    assert got["order_ref", "not_null"] == stg.filter("order_ref is null").count() > 0
    assert got["order_ref", "unique"] == stg.filter("order_ref is not null").groupBy("order_ref").count().filter("count > 1").count() > 0
    assert mart.agg(F.sum("orders_count")).first()[0] == stg.count()      # failing tests leave no row out


def test_a_remittance_is_relanded_through_its_contract(spark, tmp_path):
    row = ["b", "ORD-1", "acme", "1", "5.0", "5.0", "0.0", "settled", "auto", "5.0", "n"]
    header = [c.replace("_", " ").title() for c in REMIT_COLUMNS]                       # sanitized on the way in
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "part-0.csv").write_text(f"{','.join(header)}\n{','.join(row)}\n")
    res = reland_settlements(spark, str(tmp_path / "good"))
    assert res["error"] is None and [(r.vendor, r.payable_total) for r in res["mart"].collect()] == [("acme", 5.0)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.csv").write_text(f"{','.join(header[:-1])}\n{','.join(row[:-1])}\n")
    res = reland_settlements(spark, str(tmp_path / "bad"))
    assert res["mart"] is None and "lacks required columns ['note']" in res["error"]
