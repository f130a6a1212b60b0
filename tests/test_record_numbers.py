"""Record numbers (for blank order refs -> line-N) stay exact when a CSV file
is split across many partitions."""

from vendorlake.operators.settlement import split_orders
from vendorlake.sources.files import list_parts, read_csv_raw


def test_line_numbers_across_splits(spark, tmp_path):
    n = 4000
    lines = ["order_ref,vendor,item_count,submitted_amount"]
    for i in range(n):
        ref = "" if i % 7 == 0 else f"ORD-{i}"
        lines.append(f"{ref},acme,{i % 9 + 1},{100 + i}.25")
    (tmp_path / "vendor_orders_big.csv").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        parts = list_parts(spark, str(tmp_path))
        raw, rejected = read_csv_raw(spark, parts)
        assert rejected.count() == 0
        assert raw.select("_block_start").distinct().count() > 5      # really split
        rec = split_orders(raw, batch_id="b").select("order_ref", "_line", "_submitted")
        got = {r.order_ref: (r._line, float(r._submitted)) for r in rec.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == n
    for i in range(0, n, 7):
        line = i + 2                                  # header is record 1
        assert got[f"line-{line}"] == (line, 100 + i + 0.25)
    assert got["ORD-1"][0] == 3
