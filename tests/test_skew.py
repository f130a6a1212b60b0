"""A key holding a third of all rows: results stay whole and exact."""
from pyspark.sql import functions as F

from vendorlake.operators.quality import run_tests
from vendorlake.operators.settlement import dedupe_orders, first_decisions


def test_dedupe_with_a_hot_key(spark):
    n = 30000
    df = spark.range(n).select(
        F.lit("b").alias("batch_id"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(
            F.concat(F.lit("ORD-"), F.col("id").cast("string"))).alias("order_ref"),
        F.lit("acme").alias("vendor"),
        F.concat(F.lit("f"), (F.col("id") % 7).cast("string"), F.lit(".csv")).alias("_source_file"),
        (F.col("id") + 2).alias("_line"))
    out = dedupe_orders(df)
    assert out.count() == n                                   # nothing dropped
    hot = out.filter(F.col("order_ref") == "HOT")
    assert hot.filter(~F.col("is_duplicate")).count() == 1
    first = hot.filter(~F.col("is_duplicate")).first()
    assert (first._source_file, first._line) == ("f0.csv", 2)  # min (file, line)
    assert out.filter(F.col("is_duplicate")).count() == n // 3 - 1


def test_first_decision_with_a_hot_order(spark):
    n = 20000
    d = spark.range(n).select(
        F.col("id").alias("decision_id"), F.lit("b").alias("batch_id"), F.lit("v").alias("vendor"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(
            F.concat(F.lit("ORD-"), F.col("id").cast("string"))).alias("order_ref"),
        F.when(F.col("id") % 2 == 0, F.lit("approve")).otherwise(F.lit("deny")).alias("decision"),
        F.lit("n").alias("note"),
        ((F.lit(n) - F.col("id")) % 400).cast("decimal(12,2)").alias("delay_s"))
    fd = {r.order_ref: r for r in first_decisions(d).collect()}
    hot = d.filter((F.col("order_ref") == "HOT") & (F.col("delay_s") <= 300)) \
        .orderBy("delay_s", "decision_id").first()
    assert fd["HOT"].decision_id == hot.decision_id


def test_unique_test_with_a_hot_value(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).cast("int").alias("order_id"),
        F.lit("c").alias("customer"), F.current_date().alias("order_date"),
        F.lit(1.0).alias("amount"), F.lit("completed").alias("status"))
    res = {(r.column_name, r.test_name): r.failures for r in run_tests(df, "stg_orders").collect()}
    assert res[("order_id", "unique")] == 1


def test_line_numbers_of_a_hot_file_span_partitions(spark):
    """Range-sorted lines of one file holding a third of all rows are numbered
    by several tasks and equal a plain row_number over the file."""
    from pyspark.sql import Window

    from vendorlake.operators.settlement import record_numbers
    from vendorlake.session import materialize

    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
        ((F.col("id") * 7919) % 1000).alias("a"), F.col("id").alias("b"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")      # keep the 8 range partitions of a tiny input
    try:
        ordered = materialize(df.orderBy("k", "a", "b").select(
            "k", "a", "b", F.spark_partition_id().alias("_block_start"),
            F.monotonically_increasing_id().alias("_mid")), "hot_lines")
    finally:
        spark.conf.set(key, "true")
    assert ordered.filter(F.col("k") == 0).select("_block_start").distinct().count() > 1
    got = record_numbers(ordered, "k").select("k", "a", "b", "_line")
    want = df.select("k", "a", "b", (F.row_number().over(
        Window.partitionBy("k").orderBy("a", "b")) + 1).alias("_line"))
    assert got.count() == n
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_vendor_lines_are_numbered_behind_one_shuffle(spark):
    """The lines of an order are numbered where the join with the orders has dealt
    them; orders of many lines by a range sort, with the same numbers."""
    from vendorlake.sources import adapters as A
    sf = "/root/testdata/sf0.001"
    plain = A._numbered_lines(spark, sf)
    plan = A.raw_vendor_orders(spark, sf, once=True)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "rangepartitioning" not in plan
    sizes = plain.groupBy("l_orderkey").count()
    assert 0 < sizes.filter("count > 4").count() < sizes.count()
    mixed = A._numbered_lines(spark, sf, hot_lines=4)
    assert plain.dtypes == mixed.dtypes
    assert plain.exceptAll(mixed).isEmpty() and mixed.exceptAll(plain).isEmpty()
    assert "_line" not in A.raw_vendor_orders(spark, sf, numbered=False).columns


def test_vendor_lines_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    """A task's share does not grow with the table: the partitions do."""
    from vendorlake.session import tasks_for
    from vendorlake.sources import adapters as A
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks_for(spark, 0) == at_least and tasks_for(spark, 10 * at_least + 1, each=10) == at_least + 1
    sf = "/root/testdata/sf0.001"
    plain = A._numbered_lines(spark, sf)
    asked = []
    monkeypatch.setattr(A, "tasks_for", lambda spark, rows: asked.append(rows) or 25)
    many = A._numbered_lines(spark, sf)
    assert asked == [A.read_table(spark, sf, "lineitem").count()]
    assert many.rdd.getNumPartitions() == 25
    assert plain.exceptAll(many).isEmpty() and many.exceptAll(plain).isEmpty()
    mixed = A.raw_vendor_orders(spark, sf, numbered=False)
    assert mixed.count() == plain.count()


def test_runs_of_a_drop_grow_with_its_table(spark):
    from vendorlake.sources.landing import _write
    df = spark.range(3000).select(*[(F.col("id") + i).cast("string").alias(c) for i, c in enumerate("abcde")])
    assert len(_write(df, F.lit("x.csv"), 13).first().paths) == 13


def test_records_without_twins_are_not_shuffled(spark):
    """Only the hashes of the keys are; colliding hashes would be told apart by the keys."""
    records = spark.range(5000).select(
        F.when(F.col("id") % 5 > 0, "b").alias("batch_id"), F.lit("v").alias("vendor"),
        F.concat(F.lit("ORD-"), (F.col("id") % 4999).cast("string")).alias("order_ref"),
        F.lit("f.csv").alias("_source_file"), F.col("id").alias("_line"))
    out = dedupe_orders(records)
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().toString()
    assert [r._line for r in out.filter("is_duplicate").collect()] == []        # 0 and 4999 differ in batch_id
    again = records.withColumn("batch_id", F.lit(None).cast("string"))
    assert [r._line for r in dedupe_orders(again).filter("is_duplicate").collect()] == [4999]


def test_split_counts_are_joined_without_moving_the_rows(spark):
    from vendorlake.operators.settlement import record_numbers
    rows = spark.range(0, 1000, 1, 4).select(
        F.lit("f").alias("_source_file"), F.spark_partition_id().alias("_block_start"), F.monotonically_increasing_id().alias("_mid"), "id")
    out = record_numbers(rows)
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().toString()
    assert out.filter("_line <> id + 2").isEmpty()


def test_settlement_parses_its_files_once(spark, tmp_path, monkeypatch):
    """The rows are numbered and split from a written copy, not from a second read."""
    from vendorlake.plans import jobs
    plans, write = [], jobs.materialize

    def watched(df, name="materialized"):
        if name == "split_records":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(jobs, "materialize", watched)
    (tmp_path / "vendor_orders_1.csv").write_text("order_ref,vendor,item_count,submitted_amount\nA,v,1,10\n,v,2,x\nA,v,1,10\n")
    contracts = spark.createDataFrame([("v", "10.0", "0")], "vendor string, unit_rate string, discount_pct string")
    decisions = spark.createDataFrame([], "vendor string, order_ref string, decision_id long, decision string, note string, delay_s decimal(12,2)")
    done = jobs.run_settlement_batch(spark, str(tmp_path), contracts, decisions, multi_line=False)
    assert len(plans) == 1 and "csv" not in plans[0].lower() and "parquet" in plans[0].lower()
    assert sorted((r._line, r.order_ref, r.outcome) for r in done["settled"].collect()) == [
        (2, "A", "settled"), (3, "line-3", "denied"), (4, "A", "duplicate")]
