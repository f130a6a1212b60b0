"""The reference's end-to-end known answers, on its own fixture files."""
import gzip
import os

import pytest
from pyspark.sql import functions as F

from vendorlake.operators.hygiene import apply_hygiene
from vendorlake.operators.staging import build_staging
from vendorlake.plans.jobs import InputSpec, JobSpec, run_batch, run_job, run_settlement_batch

# The settlement fixture's contracts, vendor -> (unit_rate, discount_pct).
DEMO_CONTRACTS = {"acme": (40.0, 5.0), "globex": (25.0, 0.0), "initech": (12.5, 10.0)}

ORDERS = """Order ID,Customer,Order Date,Amount,Status,record_type
1,acme,2026-08-01,120.50,completed,orders
2,acme,2026-08-01,80.00,completed,orders
3,globex,2026-08-01,42.25,CANCELLED,orders
4,globex,2026-08-02,310.10,completed,orders
5,initech,2026-08-02,55.99,Completed,orders
6,initech,2026-08-03,12.00,pending,orders
7,acme,2026-08-03,99.95,completed,orders
"""
CUSTOMERS = """Customer,Seg,RGN,record_type
acme,Enterprise,US,customers
globex,SMB,EU,customers
initech,SMB,US,customers
"""
PAYMENTS = """Payment ID,Order ID,Paid Amount,Paid Date,record_type
901,1,120.50,2026-08-02,payments
902,2,80.00,2026-08-02,payments
903,4,310.10,2026-08-03,payments
904,5,55.99,2026-08-03,payments
"""
VENDOR_ORDERS = """order_ref,vendor,item_count,submitted_amount
ORD-1001,acme,10,385.00
ORD-1002,acme,4,152.00
ORD-1003,globex,6,150.00
ORD-1004,globex,8,260.00
ORD-1005,initech,20,300.00
ORD-1006,initech,,
"""


@pytest.fixture()
def landing(tmp_path):
    (tmp_path / "orders_2026-08.csv").write_text(ORDERS)
    (tmp_path / "customers_2026-08.csv").write_text(CUSTOMERS)
    (tmp_path / "payments_2026-08.csv.gz").write_bytes(gzip.compress(PAYMENTS.encode()))
    (tmp_path / "zz_broken.csv").write_bytes(os.urandom(200))
    return str(tmp_path)


def test_demo_daily_revenue(spark):
    rows = [r.split(",")[:5] for r in ORDERS.strip().splitlines()[1:]]
    raw = spark.createDataFrame(rows, "order_id string, customer string, order_date string, "
                                      "amount string, status string")
    res = run_job(spark, JobSpec("daily-revenue", [InputSpec(raw, "raw.orders")], ("tag:orders",)))
    assert res["success"], res
    out = res["tables"]["daily_revenue"].collect()
    assert len(out) == 3
    assert abs(sum(r.total_revenue for r in out) - 666.54) < 0.01
    by_day = {str(r.order_date): (r.order_count, r.total_revenue) for r in out}
    assert by_day["2026-08-01"] == (2, 200.50)
    assert by_day["2026-08-02"] == (2, 366.09)
    assert by_day["2026-08-03"] == (1, 99.95)


def test_file_batch_and_consolidation(spark, landing):
    res = run_batch(spark, landing)
    ledger = {r.file: r for r in res["ledger"].collect()}
    rep = res["report"].first()
    assert (rep.files_processed, rep.transformed, rep.quarantined) == (4, 3, 1)
    assert ledger["zz_broken.csv"].status == "quarantined"
    assert ledger["zz_broken.csv"].error == "no route pattern matched"
    assert ledger["payments_2026-08.csv"].landed_key == "landing/payments_2026-08.csv"
    t = res["tables"]
    assert t["daily_revenue"].count() == 3
    assert t["dim_customers"].count() == 3
    assert t["fct_payments"].count() == 4
    summary = {r.segment: r for r in t["executive_summary"].collect()}
    assert len(summary) == 2
    assert abs(summary["enterprise"].revenue - 300.45) < 0.01
    assert abs(summary["enterprise"].collected - 200.50) < 0.01
    assert abs(summary["smb"].collection_rate - 1.0) < 0.001


def test_ingest_only(spark, landing):
    res = run_batch(spark, landing, dispatch_transforms=False)
    rep = res["report"].first()
    assert (rep.landed, rep.transformed, rep.quarantined) == (3, 0, 1)
    landed = res["ledger"].filter(F.col("status") == "landed").collect()
    assert sorted(r.route for r in landed) == ["customers", "orders", "payments"]
    assert all(r.landed_key.startswith("landing/") for r in landed)


def test_bad_gzip_is_quarantined(spark, tmp_path):
    (tmp_path / "payments_x.csv.gz").write_bytes(b"not gzip at all")
    (tmp_path / "orders_x.csv").write_text(ORDERS)
    res = run_batch(spark, str(tmp_path))
    ledger = {r.file: r for r in res["ledger"].collect()}
    assert ledger["payments_x.csv.gz"].status == "quarantined"
    assert "not valid gzip" in ledger["payments_x.csv.gz"].error
    assert ledger["orders_x.csv"].status == "transformed"


def test_settlement_known_answers(spark, tmp_path):
    (tmp_path / "vendor_orders_2026-08.csv").write_text(VENDOR_ORDERS)
    contracts = spark.createDataFrame(
        [(v, r, d) for v, (r, d) in DEMO_CONTRACTS.items()],
        "vendor string, unit_rate double, discount_pct double")
    decisions = spark.createDataFrame(
        [(1, "globex", "ORD-1004", "approve", "rate verified", 10.0)],
        "decision_id long, vendor string, order_ref string, decision string, note string, delay_s double")
    res = run_settlement_batch(spark, str(tmp_path), contracts,
                               decisions.withColumn("delay_s", F.col("delay_s").cast("decimal(12,2)")),
                               remit_path=str(tmp_path / "remit"))
    rep = res["report"].first()
    assert rep.orders == 6
    assert (rep.settled, rep.denied, rep.escalated, rep.duplicate, rep.errored) == (4, 1, 1, 0, 0)
    assert (rep.auto, rep.reviewer, rep.validation, rep.sla_timeout) == (3, 1, 1, 1)
    assert res["outcomes"].count() == 6
    mart = {r.vendor: r for r in res["mart"].collect()}
    assert len(mart) == 3
    assert abs(mart["acme"].payable_total - 532.00) < 0.01
    assert abs(mart["acme"].savings - 5.00) < 0.01
    assert abs(mart["globex"].payable_total - 350.00) < 0.01
    assert abs(mart["globex"].savings - 60.00) < 0.01
    assert mart["initech"].payable_total == 0.0
    assert mart["initech"].escalated_count == 1 and mart["initech"].denied_count == 1
    rows = {r.order_ref: r for r in res["outcomes"].collect()}
    assert rows["ORD-1004"].note == "rate verified"
    assert rows["ORD-1005"].note == "no decision within 300s"
    assert rows["ORD-1006"].note == "bad submitted_amount: ''"
    assert res["tests"].filter(F.col("failures") > 0).count() == 0


def test_contract_rejects_missing_columns(spark):
    from vendorlake.operators.hygiene import ContractError
    df = spark.createDataFrame([("1", "x")], "`Order ID` string, Customer string")
    with pytest.raises(ContractError, match="lacks required columns"):
        apply_hygiene(df, required=["order_id", "customer", "amount"])


def test_aliases_last_canonical_wins(spark):
    from vendorlake.operators.hygiene import alias_columns
    df = spark.createDataFrame([("a", "b")], "Cust string, Tier string")
    out = alias_columns(apply_hygiene(df), {"customer": ["cust"], "segment": ["tier"],
                                            "other": ["Tier"]})
    assert out.columns == ["customer", "other"]


def test_staging_expr_is_not_cast_again(spark):
    raw = spark.createDataFrame([("1", "a", "2026-08-01", "1.5", " Completed ")],
                                "order_id string, customer string, order_date string, "
                                "amount string, status string")
    r = build_staging(raw, "stg_orders").first()
    assert (r.order_id, r.status, r.amount) == (1, "completed", 1.5)


def test_quality_gate_rejects_only_bad_files(spark):
    from vendorlake.operators.quality import quality_gate
    raw = spark.createDataFrame(
        [("1", "a", "2026-08-01", "1.5", "completed", "good.csv"),
         ("2", "b", "2026-08-01", "abc", "completed", "bad_cast.csv"),
         ("3", "c", "2026-08-01", "1.0", "weird", "bad_value.csv"),
         ("4", "d", "2026-08-01", "1.0", "pending", "dup.csv"),
         ("4", "d", "2026-08-01", "1.0", "pending", "dup.csv")],
        "order_id string, customer string, order_date string, amount string, status string, "
        "_source_file string")
    good, rejected = quality_gate(raw, "stg_orders")
    rej = {r._source_file: r.reason for r in rejected.collect()}
    assert set(rej) == {"bad_cast.csv", "bad_value.csv", "dup.csv"}
    assert "cast failed: amount=1" in rej["bad_cast.csv"]
    assert "accepted_values(status)=1" in rej["bad_value.csv"]
    assert "unique(order_id)=1" in rej["dup.csv"]
    assert [r.order_id for r in good.collect()] == [1]


def test_accepted_values_lets_null_pass(spark):
    from vendorlake.operators.quality import run_tests
    df = spark.createDataFrame([("settled", None), ("denied", "auto")],
                               "outcome string, decision_source string")
    stg = df.selectExpr("'b' as batch_id", "'r' as order_ref", "'v' as vendor", "1 as item_count",
                        "1.0 as submitted_amount", "1.0 as priced_amount", "0.0 as variance_pct",
                        "outcome", "decision_source", "1.0 as payable_amount", "'' as note")
    res = {(r.column_name, r.test_name): r.failures for r in run_tests(stg, "stg_settlements").collect()}
    assert res[("decision_source", "accepted_values")] == 0
    assert res[("order_ref", "unique")] == 1


def test_capped_result(spark):
    from vendorlake.operators.diff import ResultTooLarge, capped_result
    df = spark.range(10)
    assert capped_result(df, 10) is df
    with pytest.raises(ResultTooLarge):
        capped_result(df, 9)


def test_discovery_window_and_pattern(spark, landing):
    from vendorlake.sources.files import discover_files
    names = [r.file_name for r in discover_files(spark, landing).collect()]
    assert names == sorted(["customers_2026-08.csv", "orders_2026-08.csv",
                            "payments_2026-08.csv.gz", "zz_broken.csv"])
    assert discover_files(spark, landing, modified_after="2999-01-01T00:00:00").count() == 0
    assert discover_files(spark, landing, pattern="*.gz").count() == 1


def test_json_job_spec_cli(spark, tmp_path, capsys):
    """A reference-shaped JSON spec runs end to end and reports ETL_RESULT."""
    import json

    from vendorlake.plans.cli import main
    drop = tmp_path / "landing"
    drop.mkdir()
    (drop / "orders.csv").write_text(ORDERS)
    spec = {"name": "daily-revenue",
            "inputs": [{"source": str(drop), "table": "raw.orders", "format": "csv",
                        "hygiene": {"sanitize_headers": True,
                                    "require_columns": ["order_id", "customer", "order_date",
                                                        "amount", "status"]}}],
            "dbt_args": ["build", "--select", "tag:orders"],
            "outputs": [{"table": "analytics.daily_revenue",
                         "destination": str(tmp_path / "daily_revenue.json"), "format": "json"}]}
    (tmp_path / "spec.json").write_text(json.dumps(spec))
    assert main(["--spec", str(tmp_path / "spec.json")]) == 0
    line = [l for l in capsys.readouterr().out.splitlines() if l.startswith("ETL_RESULT ")][-1]
    result = json.loads(line[len("ETL_RESULT "):])
    assert result["success"] and result["outputs"][0]["rows"] == 3
    rows = json.loads(spark.read.text(str(tmp_path / "daily_revenue.json")).first()[0])
    assert abs(sum(r["total_revenue"] for r in rows) - 666.54) < 0.01
    # a contract violation is a deterministic rejection
    spec["inputs"][0]["hygiene"]["require_columns"].append("discount")
    (tmp_path / "bad.json").write_text(json.dumps(spec))
    assert main(["--spec", str(tmp_path / "bad.json")]) == 1
    line = [l for l in capsys.readouterr().out.splitlines() if l.startswith("ETL_RESULT ")][-1]
    assert "lacks required columns" in json.loads(line[11:])["error"]


def test_quarantined_files_are_copied_with_reason(spark, landing, tmp_path):
    from vendorlake.sources.export import quarantine_files
    from vendorlake.sources.files import list_parts
    res = run_batch(spark, landing)
    dest = str(tmp_path / "quarantine")
    copied = quarantine_files(list_parts(spark, landing), res["ledger"], dest).collect()
    assert len(copied) == 1 and copied[0].bytes == 200
    assert (tmp_path / "quarantine" / "zz_broken.csv" / "zz_broken.csv").stat().st_size == 200
    reason = (tmp_path / "quarantine" / "zz_broken.csv" / "zz_broken.csv.reason.txt").read_text()
    assert reason == "no route pattern matched"


def test_ambiguous_headers_reject_only_their_file(spark, tmp_path):
    from vendorlake.sources.files import list_parts, read_csv_raw
    good = "Order ID,Customer,Order Date,Amount,Status\n1,acme,2026-08-01,1.00,completed\n"
    (tmp_path / "orders_good.csv").write_text(good)
    (tmp_path / "orders_dup.csv").write_text("Order ID,order id,Customer,Order Date,Amount,Status\n"
                                            "1,1,acme,2026-08-01,1.00,completed\n")
    rows, rejected = read_csv_raw(spark, list_parts(spark, str(tmp_path)),
                                  required=["order_id", "customer", "order_date", "amount", "status"])
    assert rows.count() == 1
    (row,) = rejected.collect()
    assert row.file_name == "orders_dup.csv" and "ambiguous columns ['order_id']" in row.reason


def test_no_task_sorts_a_whole_drop(spark, tmp_path, monkeypatch):
    """Drops are joined from sorted runs, one file each: plain, as gzip members, quoted."""
    import gzip
    from vendorlake.sources import adapters as A, landing as L
    made, write = [], L._write

    def counted(df, drop):
        made.append(write(df, drop).collect())
        return spark.createDataFrame(made[-1])

    monkeypatch.setattr(L, "_write", counted)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")      # keep the range partitions of a tiny input
    try:
        root = L.write_landing(spark, "/root/testdata/sf0.001", str(tmp_path / "landing"))
    finally:
        spark.conf.set(key, "true")
    runs = {r.file_name: len(r.paths) for rows in made for r in rows}
    assert max(runs.values()) > 1
    for name in runs:
        (part,) = (tmp_path / "landing" / f"_drop={name}").glob("part-*")
        data = part.read_bytes()
        text = (gzip.decompress(data) if part.name.endswith(".gz") else data).decode()
        if name.startswith(("payments", "customers", "orders", "vendor")):
            head, *lines = text.splitlines()
            firsts = [line.split(",")[0].strip('"') for line in lines]
            assert head.split(",")[0] in ("Payment ID", "Cust", "Order ID", "Customer", "order_ref") and firsts == sorted(firsts), name
    assert spark.read.option("header", True).csv(f"{root}/_drop=payments_*").count() == A.raw_payments(spark, "/root/testdata/sf0.001").count()

