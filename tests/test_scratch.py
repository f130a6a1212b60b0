"""What batches leave in the shared folder, and where they shuffle."""
import os
from pathlib import Path

from vendorlake.plans.jobs import run_settlement_batch
from vendorlake.session import discard, materialize, shared_dir, shuffles_freed
from vendorlake.sources.export import write_remittance
from vendorlake.sources.landing import write_landing


def _left(spark, before):
    return {p.rsplit("-", 1)[0] for p in set(os.listdir(shared_dir(spark))) - before}


def test_a_settlement_batch_leaves_no_copies_of_its_steps(spark, tmp_path):
    rows = "".join(f"ORD-{i % 40},acme,{i},{40 * i}.00\n" for i in range(1, 60))
    (tmp_path / "vendor_orders_1.csv").write_text("order_ref,vendor,item_count,submitted_amount\n" + rows)
    contracts = spark.createDataFrame([("acme", 40.0, 0.0)], "vendor string, unit_rate double, discount_pct double")
    decisions = spark.createDataFrame([], "decision_id long, vendor string, order_ref string, decision string, note string, delay_s double")
    before = set(os.listdir(shared_dir(spark)))
    res = run_settlement_batch(spark, str(tmp_path), contracts, decisions)
    left = _left(spark, before)
    assert {"settled", "remittance", "stg"} <= left and not {"vendor_rows", "split_records"} & left
    assert all(p.name.endswith(".csv.gz") for p in Path(res["remittance"]).glob("part-*"))
    assert res["error"] is None and res["stg_settlements"].count() == res["outcomes"].count() == 40
    plain = write_remittance(res["outcomes"], str(tmp_path / "out"))                  # one to hand over stays plain
    assert {p.name[-4:] for p in Path(plain).glob("part-*")} == {".csv"}


def test_the_landing_leaves_no_runs(spark, sf, tmp_path):
    before = set(os.listdir(shared_dir(spark)))
    root = write_landing(spark, sf, str(tmp_path / "landing"))
    assert "landing-runs" not in _left(spark, before) and len(os.listdir(root)) > 10


def test_shuffles_go_with_their_statement(spark, tmp_path):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with shuffles_freed(spark):
        assert spark.conf.get(key) == "true"
        some = materialize(spark.range(1000).repartition(4, "id"), "some", "zstd")
    assert spark.conf.get(key) == before and some.count() == 1000
    discard(some, spark.range(1))
    assert not os.path.exists(some._written)
