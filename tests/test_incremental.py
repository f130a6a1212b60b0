"""Bucketed landing, keys across batches, diffs in detail, manifests by observation, configuration."""
import json

import pytest
from pyspark.sql import functions as F

from vendorlake.operators.diff import diff_detail, table_diff
from vendorlake.operators.landed_tables import dedupe_landed, land_bucketed
from vendorlake.operators.seen import SeenKeys
from vendorlake.plans.config import ConfigError, load_config


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# bucketed landing

def test_landed_tables_join_without_exchange(spark, tmp_path, no_broadcast):
    orders = spark.range(200).select(F.col("id").cast("int").alias("order_id"), F.lit("x").alias("customer"),
                                     F.concat(F.lit("orders_"), (F.col("id") % 3).cast("string"), F.lit(".csv")).alias("_source_file"))
    paid = spark.range(300).select((F.col("id") % 150).cast("int").alias("order_id"), F.lit(2.0).alias("paid_amount"),
                                   F.lit("payments.csv").alias("_source_file"))
    o = land_bucketed(orders, "lt.orders", ["order_id"], 4, location=str(tmp_path / "o"))
    p = land_bucketed(paid, "lt.paid", ["order_id"], 4, location=str(tmp_path / "p"))
    joined = o.join(p.groupBy("order_id").agg(F.sum("paid_amount").alias("paid")), "order_id", "left")
    assert "Exchange" not in _plan(joined)
    assert joined.count() == 200 and joined.agg(F.sum("paid")).first()[0] == 600.0
    spark.sql("DROP TABLE lt.orders")
    spark.sql("DROP TABLE lt.paid")


def test_a_rerun_replaces_its_own_files_only(spark, tmp_path):
    def rows(*r):
        return spark.createDataFrame(list(r), "k int, v string, _source_file string")

    where = tmp_path / "t"
    land_bucketed(rows((1, "a", "one.csv"), (2, "b", "one.csv"), (3, "c", "two.csv"), (None, "n", "two.csv")), "lt.again", ["k"], 2, location=str(where))
    kept = {f: f.stat().st_mtime_ns for f in (where / "_source_file=two.csv").rglob("part-*")}
    got = land_bucketed(rows((2, "B", "one.csv"), (9, "z", "new é.csv")), "lt.again", ["k"], 5)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(2, "B", "one.csv"), (3, "c", "two.csv"), (None, "n", "two.csv"), (9, "z", "new é.csv")], key=str)
    assert kept == {f: f.stat().st_mtime_ns for f in (where / "_source_file=two.csv").rglob("part-*")}
    land_bucketed(rows((7, "q", "three.csv")).drop("v"), "lt.again", ["k"])
    assert spark.table("lt.again").where("k = 7").first().v is None
    with pytest.raises(ValueError, match="no columns"):
        land_bucketed(rows((1, "a", "x")).withColumn("other", F.lit(1)), "lt.again", ["k"])
    spark.sql("DROP TABLE lt.again")


def test_dedupe_over_buckets(spark, tmp_path, no_broadcast):
    from vendorlake.operators.settlement import LIFECYCLE_KEY, dedupe_orders
    data = [("b", "v", f"r{i % 7}", f"f{i % 3}.csv", i) for i in range(40)]
    records = spark.createDataFrame(data, "batch_id string, vendor string, order_ref string, _source_file string, _line long")
    landed = land_bucketed(records, "lt.records", list(LIFECYCLE_KEY), 4, location=str(tmp_path / "r"))
    out = dedupe_landed(landed)
    assert "Exchange" not in _plan(out)
    cols = ["order_ref", "_source_file", "_line", "is_duplicate"]
    assert sorted(map(tuple, out.select(*cols).collect())) == sorted(map(tuple, dedupe_orders(records).select(*cols).collect()))
    spark.sql("DROP TABLE lt.records")


# keys across batches

def test_unique_across_batches(spark, tmp_path):
    seen = SeenKeys(spark, str(tmp_path / "seen"), expected_keys=1000)

    def batch(*keys):
        return spark.createDataFrame([(k,) for k in keys], "k string")

    def check(df, name):
        return sorted((r.key, r.n, r.first_batch) for r in seen.repeated(df, "k", name).collect())

    one = batch("a", "b", "b", None, None, "é")
    assert check(one, "1") == [("b", 2, None)]
    seen.add(one, "k", "1")
    assert check(one, "1") == [("b", 2, None)]                       # its own keys do not count against it
    two = batch("a", "c", "d", "d", None)
    assert check(two, "2") == [("a", 1, "1"), ("d", 2, None)]
    seen.add(two, "k", "2")
    seen.add(two, "k", "2")
    assert check(batch("é", "d", "x", "a"), "3") == [("a", 1, "1"), ("d", 1, "2"), ("é", 1, "1")]
    seen.add(batch(), "k", "4")
    assert check(batch(), "5") == []


def test_only_hits_are_looked_up_and_old_keys_stay_where_they_are(spark, tmp_path, no_broadcast):
    seen = SeenKeys(spark, str(tmp_path / "seen"), expected_keys=20_000)
    seen.add(spark.range(20_000).withColumn("k", F.col("id").cast("string")), "k", "1")
    new = spark.range(19_990, 40_000).withColumn("k", F.col("id").cast("string"))
    found = seen.repeated(new, "k", "2")
    assert sorted(int(r.key) for r in found.collect()) == list(range(19_990, 20_000))
    from vendorlake.session import shared_dir
    import glob
    newest = max(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/hits-*"), key=lambda p: __import__("os").path.getmtime(p))
    assert spark.read.parquet(newest).count() < 10 + 0.05 * 20_000    # of 20,010 keys
    plan = _plan(found)
    assert "BroadcastHashJoin [part" in plan and "hashpartitioning(part" not in plan


# diffs in detail

def _side(spark, rows):
    return spark.createDataFrame(rows, "k int, g string, a string, b double")


def test_diff_by_key_and_column(spark):
    base = [(i, "x", f"v{i}", float(i)) for i in range(300)]
    old = _side(spark, base + [(900, "x", "gone", 1.0), (901, None, None, None), (None, "x", "null key", 1.0), (902, "x", "p", 1.0), (902, "x", "p", 1.0),
                               (903, "x", None, 2.0)])
    new = _side(spark, [(5, "x", "changed", 5.5) if r[0] == 5 else r for r in base] +
                [(901, None, "filled", None), (None, "x", "null key", 2.0), (902, "x", "p", 1.0), (904, "x", "fresh", 1.0), (903, "x", None, 2.0)])
    got = sorted((tuple(r) for r in diff_detail(new, old, ["k", "g"], fan=8).collect()), key=str)
    assert got == sorted([(5, "x", "changed", "a", "v5", "changed"), (5, "x", "changed", "b", "5.0", "5.5"), (901, None, "changed", "a", None, "filled"),
                          (None, "x", "changed", "b", "1.0", "2.0"), (900, "x", "only_old", None, None, None), (904, "x", "only_new", None, None, None),
                          (902, "x", "repeated", None, "2", "1")], key=str)
    assert diff_detail(new, new, ["k", "g"]).count() == 0 and diff_detail(old.limit(0), old.limit(0), ["k"]).count() == 0
    assert table_diff(new, new).count() == 0


def test_equal_ranges_are_not_compared(spark):
    old = _side(spark, [(i, "x", str(i), 0.0) for i in range(5000)])
    new = old.withColumn("a", F.when(F.col("k") == 77, "other").otherwise(F.col("a")))
    from vendorlake.operators import diff
    from vendorlake.session import materialize
    kept = {}
    original = diff.materialize
    try:
        diff.materialize = lambda df, name: kept.setdefault(name, materialize(df, name))
        assert [tuple(r) for r in diff_detail(new, old, ["k"], fan=64).collect()] == [(77, "changed", "a", "77", "other")]
    finally:
        diff.materialize = original
    assert [kept[n].count() for n in ("ranges", "parts", "differing_keys")] == [1, 1, 1]


# manifests

def test_manifest_is_measured_by_the_write(spark, tmp_path):
    from vendorlake.sources.export import export, export_manifest, validate_outputs
    df = spark.createDataFrame([(1, "b", 2.5, None), (3, None, 1.25, b"x"), (2, "é" * 300, None, None)], "i int, s string, d double, raw binary")
    results = [export(df, "t", str(tmp_path / "p")), export(df.drop("raw"), "j", str(tmp_path / "j"), "json"), export(df.limit(0), "e", str(tmp_path / "e"))]
    got = {(r.table, r.column): (r.rows, r.least, r.greatest) for r in export_manifest(spark, results).collect()}
    assert got["t", "i"] == (3, "1", "3") and got["t", "s"] == (3, "b", "é" * 200) and got["j", "d"] == (3, "1.250000", "2.500000")
    assert got["e", "i"] == (0, None, None) and ("t", "raw") not in got
    assert {r.table: r.bytes > 0 and r.files > 0 for r in export_manifest(spark, results).collect()}["t"]
    checked = validate_outputs(spark, results, strict=False).collect()
    assert [bool(r.error) for r in checked] == [False, False, True]
    with pytest.raises(RuntimeError, match="no rows"):
        validate_outputs(spark, results)


def test_empty_output_quarantines_its_files_and_gz_drops_are_copied(spark, tmp_path):
    import gzip
    from vendorlake.plans.jobs import run_batch
    root = tmp_path / "landing"
    root.mkdir()
    (root / "orders_a.csv").write_text("Order ID,Customer,Order Date,Amount,Status\n")
    (root / "payments_a.csv.gz").write_bytes(gzip.compress(b"Payment ID,Order ID,Paid Amount,Paid Date\nx,1,2.0,2026-01-01\n"))
    (root / "zz_b.csv.gz").write_bytes(gzip.compress(b"a\n1\n"))
    (root / "zz_c.csv").write_text("a\n1\n")
    done = run_batch(spark, str(root), publish=str(tmp_path / "out"))
    ledger = {r.file_name: (r.status, r.error) for r in done["ledger"].collect()}
    assert {k: v[0] for k, v in ledger.items()} == dict.fromkeys(("orders_a.csv", "payments_a.csv.gz", "zz_b.csv.gz", "zz_c.csv"), "quarantined")
    assert "holds no rows" in ledger["orders_a.csv"][1]
    copied = sorted(p.name for p in (tmp_path / "out" / "quarantine").rglob("*") if p.is_file() and not p.name.startswith(".") and "reason" not in p.name)
    assert copied == ["orders_a.csv", "payments_a.csv.gz", "zz_b.csv.gz", "zz_c.csv"]


# configuration

REFUNDS = {
    "entities": [{"name": "stg_refunds", "source_table": "raw.refunds", "tags": ["refunds"], "columns": [
        {"name": "refund_id", "type": "int", "tests": ["not_null", "unique"]}, {"name": "amount", "type": "double"},
        {"name": "reason", "expr": "lower(trim(reason))", "tests": [{"accepted_values": ["damaged", "late"]}]}]}],
    "routes": [{"pattern": "refunds_*.csv", "route": "refunds", "spec": "refunds"}],
    "specs": {"refunds": {"tags": ["refunds"], "source_table": "raw.refunds", "column_aliases": {"refund_id": ["Refund No"]},
                          "outputs": ["analytics.refunds_by_reason"]}},
    "models": [{"name": "refunds_by_reason", "deps": ["stg_refunds"], "tags": ["refunds"],
                "sql": "SELECT reason, count(*) AS n, sum(amount) AS total FROM stg_refunds GROUP BY reason"}]}


def test_a_new_entity_route_and_alias_by_json_alone(spark, tmp_path, capsys):
    from vendorlake.plans.cli import main
    root = tmp_path / "landing"
    root.mkdir()
    (root / "refunds_1.csv").write_text("Refund No,Amount,Reason\n1,2.5, Late \n2,1.5,damaged\n3,1.0,late\n")
    (root / "refunds_2.csv").write_text("Refund No,Amount,Reason\n4,1.0,lost\n")
    (root / "orders_1.csv").write_text("Order ID,Customer,Order Date,Amount,Status\n1,acme,2026-08-01,1.00,completed\n")
    spec = {"landing": str(root), "publish": str(tmp_path / "out"), "config": REFUNDS}
    (tmp_path / "batch.json").write_text(json.dumps(spec))
    assert main(["--spec", str(tmp_path / "batch.json")]) == 0
    told = json.loads([x for x in capsys.readouterr().out.splitlines() if x.startswith("ETL_RESULT ")][-1][11:])
    assert told["report"] == {"files_processed": 3, "transformed": 2, "landed": 0, "quarantined": 1}
    got = spark.read.parquet(str(tmp_path / "out" / "outputs" / "refunds_by_reason")).collect()
    assert sorted((r.reason, r.n, r.total) for r in got) == [("damaged", 1, 1.5), ("late", 2, 3.5)]


def test_faults_of_a_document_are_told_together(spark):
    bad = {"entities": [{"name": "refunds", "source_table": "raw.refunds", "columns": [
        {"name": "a", "expr": "lower(nothing)"}, {"name": "b", "type": "no_type"}, {"name": "B"}, {"name": "c", "tests": ["positive"]}]},
        {"name": "stg_half"}],
        "routes": [{"pattern": "x_*.csv", "route": "x", "spec": "absent"}, {"route": "y"}],
        "specs": {"s": {"source_table": "raw.unknown", "outputs": ["analytics.none"], "colour": 1}},
        "models": [{"name": "m1", "deps": ["m2"], "sql": "SELECT 1"}, {"name": "m2", "deps": ["m1"], "sql": "SELECT 1"}], "more": 1}
    with pytest.raises(ConfigError) as e:
        load_config(spark, bad)
    text = str(e.value)
    for part in ("unknown key 'more'", "is named stg_", "column a:", "column b:", "'b' is declared twice", "unknown test 'positive'", "entity stg_half lacks",
                 "no spec 'absent'", "route y lacks ['pattern']", "unknown key 'colour'", "no entity 'stg_unknown'", "no model for its output", "need each other"):
        assert part in text, part
    sql = {**REFUNDS, "models": [{"name": "refunds_by_reason", "deps": ["stg_refunds"], "sql": "SELECT missing FROM stg_refunds"}]}
    with pytest.raises(ConfigError, match="model refunds_by_reason"):
        load_config(spark, sql)
    assert load_config(spark, {}).registry and load_config(spark, REFUNDS).entities["stg_refunds"].column_names == ["refund_id", "amount", "reason"]
