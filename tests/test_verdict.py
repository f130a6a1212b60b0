"""Cases that once went wrong: lost files, wrong payments, inexact money, leaks."""
import gzip

import pytest
from pyspark.sql import functions as F

from vendorlake.operators import marts
from vendorlake.plans.jobs import InputSpec, JobSpec, OutputSpec, run_batch, run_job, run_settlement_batch
from vendorlake.sources.files import list_parts, read_csv_raw
from tests.test_fixtures import CUSTOMERS, DEMO_CONTRACTS, ORDERS, PAYMENTS, VENDOR_ORDERS


def contracts(spark):
    return spark.createDataFrame([(v, r, d) for v, (r, d) in DEMO_CONTRACTS.items()],
                                 "vendor string, unit_rate double, discount_pct double")


def decisions(spark, *rows):
    return spark.createDataFrame(list(rows), "decision_id long, vendor string, order_ref string, decision string, "
                                             "note string, delay_s double")


def test_no_file_of_a_landing_vanishes(spark, tmp_path):
    good = ORDERS.replace("record_type", "x" * 1_200_000)             # a header above 1 MiB
    names = ["orders_a.csv", "orders b#%20ü[1].csv", "orders_long.csv"]
    for n, body in zip(names, (ORDERS, ORDERS.replace(" 1,", " 1,"), good)):
        body = "\n".join(line if i == 0 else f"{i + 100 * names.index(n)}" + line[1:] for i, line in enumerate(body.strip().split("\n")))
        (tmp_path / n).write_text(body + "\n")
    (tmp_path / "orders_empty.csv").write_text("")
    (tmp_path / "_orders_hidden.csv").write_text(ORDERS)
    (tmp_path / "junk=orders_x.csv").write_text(ORDERS)
    (tmp_path / "orders_twice.csv").write_text("Order ID,Customer,Order Date,Status\n")
    (tmp_path / "customers_odd.csv").write_text("Cust,Customer,Seg,RGN\na,b,c,d\n")
    (tmp_path / "payments_tick.csv").write_text("Payment ID,Order `ID,Paid Amount,Paid Date\n1,2,3,2026-01-01\n")
    (tmp_path / "readme.txt").write_text("not data")
    res = run_batch(spark, str(tmp_path))
    ledger = {r.file: (r.status, r.error) for r in res["ledger"].collect()}
    assert len(ledger) == 9 and "readme.txt" not in ledger
    for n in ("orders_a.csv", "orders_long.csv"):
        assert ledger[n] == ("transformed", None)
    assert ledger["orders_empty.csv"] == ("quarantined", "empty file: no header")
    assert ledger["_orders_hidden.csv"][0] == ledger["junk=orders_x.csv"][0] == "quarantined"
    assert ledger["orders b#%20ü[1].csv"] == ("quarantined", "no route pattern matched")     # 'orders_*' it is not
    assert "ambiguous columns ['customer']" in ledger["customers_odd.csv"][1]
    assert ledger["payments_tick.csv"][0] == "transformed"
    assert "orders_twice.csv" in ledger["orders_twice.csv"][1] and "orders_a.csv" not in ledger["orders_twice.csv"][1]


def test_odd_names_and_quotes_are_read(spark, tmp_path):
    (tmp_path / "a b#%20ü[1].csv").write_text('"Amount, USD",note\n1,"two\nlines"\n2,"say ""hi"""\n')
    parts = list_parts(spark, str(tmp_path))
    rows, rejected = read_csv_raw(spark, parts, multi_line=True)
    assert rejected.count() == 0
    assert sorted((r.amount_usd, r.note, r._source_file) for r in rows.collect()) == [
        ("1", "two\nlines", "a b#%20ü[1].csv"), ("2", 'say "hi"', "a b#%20ü[1].csv")]


def test_a_decision_pays_its_own_vendor_only(spark, tmp_path):
    (tmp_path / "vendor_orders_1.csv").write_text("order_ref,vendor,item_count,submitted_amount,batch_id\n"
                                                  "ORD-1,acme,10,900.00,x\nORD-1,globex,8,900.00,\n")
    (tmp_path / "vendor_orders_2.csv").write_text("order_ref,vendor,item_count,submitted_amount\n"
                                                  "ORD-1,acme,10,900.00\n")
    res = run_settlement_batch(spark, str(tmp_path), contracts(spark), decisions(spark, (1, "acme", "ORD-1", "approve", "ok", 5.0)))
    got = sorted((r.vendor, r.outcome, r.decision_source) for r in res["settled"].collect())
    assert got == [("acme", "duplicate", None), ("acme", "settled", "reviewer"), ("globex", "escalated", "sla_timeout")]
    assert {r.batch_id for r in res["settled"].collect()} == {"batch"}


def test_vendor_files_that_fail_are_counted(spark, tmp_path):
    (tmp_path / "vendor_orders_ok.csv").write_text(VENDOR_ORDERS)
    (tmp_path / "vendor_orders_empty.csv").write_text("")
    (tmp_path / "vendor_orders_head.csv").write_text(VENDOR_ORDERS.split("\n")[0] + "\n")
    (tmp_path / "vendor_orders_cut.csv.gz").write_bytes(gzip.compress(VENDOR_ORDERS.encode() * 50)[:-20])
    res = run_settlement_batch(spark, str(tmp_path), contracts(spark), decisions(spark))
    assert {r.file_name for r in res["rejected"].collect()} == {
        "vendor_orders_empty.csv", "vendor_orders_head.csv", "vendor_orders_cut.csv.gz"}
    rep = res["report"].first()
    assert (rep.orders, rep.errored) == (9, 3)


def test_failing_tests_stop_the_settlement_mart(spark, tmp_path):
    body = "order_ref,vendor,item_count,submitted_amount\nORD-1,acme,10,380.00\nORD-1,globex,10,250.00\n"
    (tmp_path / "vendor_orders_1.csv").write_text(body)          # one ref of two vendors: not unique in the batch
    res = run_settlement_batch(spark, str(tmp_path), contracts(spark), decisions(spark))
    assert res["mart"] is None and "unique" in res["error"]


def test_amounts_of_any_size_are_visible(spark, tmp_path):
    (tmp_path / "vendor_orders_1.csv").write_text("order_ref,vendor,item_count,submitted_amount\n"
                                                  "A,acme,1,1e14\nB,acme,1,0.0000001\nC,rich,1,5\n")
    rich = contracts(spark).union(spark.createDataFrame([("rich", 1e6, 0.0)], "v string, r double, d double"))
    res = run_settlement_batch(spark, str(tmp_path), rich, decisions(spark))
    got = {r.order_ref: (r.outcome, r.submitted_amount) for r in res["settled"].collect()}
    assert got["A"] == ("escalated", 1e14) and got["B"] == ("escalated", 1e-7) and got["C"][0] == "errored"


def test_money_is_rounded_once(spark):
    rows = [("2026-01-01", 0.005, "completed", "c")] * 1000 + [("2026-01-02", 1e20, "completed", "c"), ("2026-01-03", float("nan"), "completed", "c")]
    stg = spark.createDataFrame(rows, "order_date string, amount double, status string, customer string")
    out = {r.order_date: r.total_revenue for r in marts.daily_revenue(stg).collect()}
    assert out["2026-01-01"] == 5.0 and out["2026-01-02"] == 1e20
    assert out["2026-01-03"] != out["2026-01-03"]                 # NaN shows
    assert marts.invoice_summary(stg.filter("amount = 0.005")).first().total == 5.0


def test_separate_jobs_leave_tables(spark, tmp_path):
    raws = {}
    for name, text in (("orders", ORDERS), ("customers", CUSTOMERS), ("payments", PAYMENTS)):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}_1.csv").write_text(text)
        raws[name] = str(tmp_path / name)
    alias = {"segment": ("seg",), "region": ("rgn",)}
    for name in raws:
        res = run_job(spark, JobSpec(name, [InputSpec(raws[name], f"raw.{name}", column_aliases=alias if name == "customers" else {})], (f"tag:{name}",)))
        assert res["success"], res["error"]
    res = run_job(spark, JobSpec("consolidation", [], ("tag:consolidated",), [OutputSpec("analytics.executive_summary", str(tmp_path / "out"))]))
    assert res["success"], res["error"]
    rows = {r.segment: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (rows["enterprise"].revenue, rows["enterprise"].collected, rows["smb"].collection_rate) == (300.45, 200.5, 1.0)
    assert not any(t.isTemporary for t in spark.catalog.listTables())


def test_a_job_with_bad_data_reports_it(spark):
    raw = spark.createDataFrame([("1", "a", "2026-08-01", "abc", "completed")],
                                "order_id string, customer string, order_date string, amount string, status string")
    res = run_job(spark, JobSpec("bad", [InputSpec(raw, "raw.bad_orders")], ("tag:orders",)), {"raw.orders": raw})
    assert not res["success"] and "abc" in res["error"]
    missing = run_job(spark, JobSpec("none", [], ("daily_revenue",), sql_models={"x": "SELECT 1"}), save=False)
    assert missing["success"] or "TABLE_OR_VIEW_NOT_FOUND" in missing["error"]


def test_batch_publishes_outputs_and_quarantine(spark, tmp_path):
    land = tmp_path / "landing"
    land.mkdir()
    (land / "orders_1.csv").write_text(ORDERS)
    (land / "zz.csv").write_text("x\n")
    res = run_batch(spark, str(land), publish=str(tmp_path / "out"))
    assert [o["table"] for o in res["outputs"]][0] == "analytics.daily_revenue"
    assert spark.read.parquet(str(tmp_path / "out" / "outputs" / "daily_revenue")).count() == 3
    assert res["quarantined"].count() == 1


def test_table_diff_counts_copies(spark):
    from vendorlake.operators.diff import table_diff
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    b = spark.createDataFrame([(1, None), (3, "y"), (3, "y")], "a int, b string")
    got = sorted((r.a, r.side) for r in table_diff(a, b).collect())
    assert got == [(1, "only_new"), (2, "only_new"), (3, "only_old"), (3, "only_old")]


def test_json_keeps_order_and_refuses_more(spark, tmp_path):
    import json
    from vendorlake.operators.diff import ResultTooLarge
    from vendorlake.sources.export import export, export_json
    df = spark.range(50).select((F.lit(50) - F.col("id")).alias("n")).orderBy("n")
    assert export_json(df, str(tmp_path / "j")) == 50
    assert [r["n"] for r in json.loads(spark.read.text(str(tmp_path / "j")).first()[0])] == list(range(1, 51))
    with pytest.raises(ResultTooLarge):
        export(df, "t", str(tmp_path / "k"), "json", max_rows=10)


def test_shared_folder_is_required_off_local(spark, monkeypatch):
    import vendorlake.session as session

    class Context:
        master = "yarn"

        _vendorlake_shipped = True

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
