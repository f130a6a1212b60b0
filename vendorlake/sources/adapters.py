"""Adapters: the driver's TPC-H-ish tables -> the canonical raw inputs.

Each adapter turns whole tables into what vendors would drop: all-string
columns with vendor-style headers, deliberately messy values (case, padding,
blanks, bad numbers) so that every hygiene rule, cast gate and data test has
work to do.  Every rule here is deterministic so that the DuckDB oracle in
``ADAPTER_SQL`` builds the very same rows.

All joins are equi-joins on keys.  The record number inside a vendor file (the
lines of one order) comes from a window over the order, behind the one shuffle that
deals lines and orders to tasks by order, as many as the lines need (``tasks_for``); orders of more than ``HOT_LINES`` lines are numbered like the
file reader's files (``record_numbers``): a range sort splits them across tasks, and
only per-partition counts are windowed.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vendorlake.functions.money import MONEY
from vendorlake.operators.settlement import record_numbers
from vendorlake.session import materialize, tasks_for

TABLES = ("region nation customer supplier part orders lineitem events "
          "documents embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Fixed values of the adapters (messy source spellings on purpose).
ORDER_STATUS_TEXT = {"F": "Completed ", "O": "PENDING", "P": "cancelled"}
DECISION_BY_EVENT = {"click": "approve", "error": "deny"}
STAGE_BY_EVENT = {"view": "received", "click": "validated", "signup": "enriched",
                  "purchase": "priced", "error": "awaiting_review"}


def _case(col: str, mapping: dict[str, str], default=None):
    expr = None
    for k, v in mapping.items():
        expr = (F.when(F.col(col) == k, F.lit(v)) if expr is None
                else expr.when(F.col(col) == k, F.lit(v)))
    return expr.otherwise(F.lit(default))


def _sql_case(col: str, mapping: dict[str, str], default: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {col} {whens} ELSE {default} END"


def _money_text(col: str):
    return F.col(col).cast(MONEY).cast("string")


# ---------------------------------------------------------------------------
# raw orders:  "Order ID,Customer,Order Date,Amount,Status"
# ---------------------------------------------------------------------------
def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .select(
            F.col("o_orderkey").cast("string").alias("Order ID"),
            F.col("c_name").alias("Customer"),
            F.col("o_orderdate").cast("date").cast("string").alias("Order Date"),
            _money_text("o_totalprice").alias("Amount"),
            _case("o_orderstatus", ORDER_STATUS_TEXT).alias("Status"),
            F.concat(F.lit("orders_"), F.date_format("o_orderdate", "yyyy-MM"),
                     F.lit(".csv")).alias("_source_file"),
        )
    )


# ---------------------------------------------------------------------------
# raw customers:  "Cust,Seg,RGN"  (vendor spellings resolved by aliases)
# ---------------------------------------------------------------------------
def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    return (
        c.join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.col("c_name").alias("Cust"),
            F.concat(F.lit(" "), F.col("c_mktsegment")).alias("Seg"),
            F.col("r_name").alias("RGN"),
            F.concat(F.lit("customers_"), F.lower("r_name"),
                     F.lit(".csv")).alias("_source_file"),
        )
    )


# ---------------------------------------------------------------------------
# raw payments: "Payment ID,Order ID,Paid Amount,Paid Date"
# one payment per (l_orderkey, l_linenumber), pre-aggregated; see also
# raw_payment_lines, the ungrouped variant whose ids are not unique.
# ---------------------------------------------------------------------------
def _net_line(l: DataFrame) -> DataFrame:
    net = F.round(F.col("l_extendedprice").cast(MONEY)
                  * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")), 2)
    return l.withColumn("_net", net)


def raw_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _net_line(read_table(spark, sf_dir, "lineitem"))
    g = l.groupBy("l_orderkey", "l_linenumber").agg(
        F.sum("_net").alias("_paid"),
        F.min(F.col("l_shipdate").cast("date")).alias("_paid_date"),
    )
    return g.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("Payment ID"),
        F.col("l_orderkey").cast("string").alias("Order ID"),
        F.col("_paid").cast("string").alias("Paid Amount"),
        F.col("_paid_date").cast("string").alias("Paid Date"),
        F.concat(F.lit("payments_"), F.date_format("_paid_date", "yyyy-MM"),
                 F.lit(".csv")).alias("_source_file"),
    )


def raw_payment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _net_line(read_table(spark, sf_dir, "lineitem"))
    return l.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("Payment ID"),
        F.col("l_orderkey").cast("string").alias("Order ID"),
        F.col("_net").cast("string").alias("Paid Amount"),
        F.col("l_shipdate").cast("date").cast("string").alias("Paid Date"),
        F.concat(F.lit("payments_"), F.date_format("l_shipdate", "yyyy-MM"),
                 F.lit(".csv")).alias("_source_file"),
    )


# ---------------------------------------------------------------------------
# vendor orders: "order_ref,vendor,item_count,submitted_amount"
# one vendor file per order, one batch per order month; _line is the CSV
# record number (header = 1).  Messy cells follow part-key rules.
# ---------------------------------------------------------------------------
VENDOR_ORDER_SORT = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                     "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                     "l_linestatus", "l_shipdate")


#: Orders of more lines than this are not numbered by one task.
HOT_LINES = 1_000_000


def _vendor_lines(spark: SparkSession, sf_dir: str, hot_lines: int = HOT_LINES) -> tuple[DataFrame, DataFrame | None]:
    """The lines with their orders and suppliers, dealt by order to tasks enough for
    the table; apart from them, not dealt, those of orders of more than
    ``hot_lines`` lines, if there are any."""
    l = read_table(spark, sf_dir, "lineitem")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    s = read_table(spark, sf_dir, "supplier")
    n = tasks_for(spark, l.count())
    of_order, of_supplier = F.col("l_orderkey") == F.col("o_orderkey"), F.col("l_suppkey") == F.col("s_suppkey")

    def dealt(lines: DataFrame) -> DataFrame:
        return (lines.repartition(n, "l_orderkey").join(o.repartition(n, "o_orderkey"), of_order).join(s, of_supplier))

    hot = (l.groupBy(F.col("l_orderkey").alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
           .filter(F.col("_n") > hot_lines).select("_hot"))
    if hot.isEmpty():
        return dealt(l), None
    hot = F.broadcast(materialize(hot, "hot_orders"))       # at most 1 in hot_lines rows
    same = F.col("l_orderkey") == F.col("_hot")
    few = o.join(hot, F.col("o_orderkey") == F.col("_hot"), "left_semi")
    return dealt(l.join(hot, same, "left_anti")), l.join(hot, same, "left_semi").join(few, of_order).join(s, of_supplier)


def _numbered_lines(spark: SparkSession, sf_dir: str, hot_lines: int = HOT_LINES) -> DataFrame:
    """The vendor lines with ``_line``, on the raw columns: strings are built later,
    so little is sorted.  The window needs no shuffle of its own: the lines come dealt
    by order."""
    kept = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "s_suppkey", "s_name", "o_orderdate")
    lines, hot = _vendor_lines(spark, sf_dir, hot_lines)
    in_order = Window.partitionBy("l_orderkey").orderBy(*VENDOR_ORDER_SORT)

    def by_window(df: DataFrame) -> DataFrame:
        return df.withColumn("_line", F.row_number().over(in_order).cast("long") + 1).select(*kept, "_line")

    if hot is None:
        return by_window(lines)
    # written once, so that the per-partition counts and the rows they number come
    # from the same partitioning (a second evaluation would sample other bounds)
    ordered = materialize(
        hot.orderBy("l_orderkey", *VENDOR_ORDER_SORT)
        .select(*kept, F.spark_partition_id().alias("_block_start"), F.monotonically_increasing_id().alias("_mid")), "vendor_order_lines")
    numbered = record_numbers(ordered, "l_orderkey").select(*kept, F.col("_line").cast("long").alias("_line"))
    return by_window(lines).unionByName(numbered)


def raw_vendor_orders(spark: SparkSession, sf_dir: str, numbered: bool = True, once: bool = False) -> DataFrame:
    """``numbered``: with ``_source_file`` and ``_line``; the numbered lines are
    written to the shared folder, for readers that pass over them several times,
    unless the caller reads them ``once``."""
    if numbered:
        lines = _numbered_lines(spark, sf_dir)
    else:
        lines, hot = _vendor_lines(spark, sf_dir)
        lines = lines if hot is None else lines.unionByName(hot)
    if numbered and not once:
        lines = materialize(lines, "vendor_order_lines")
    pk = F.col("l_partkey")
    ref = (F.when(pk % 101 == 0, F.lit(None).cast("string"))
           .when(pk % 103 == 0, F.lit("  "))
           .otherwise(F.concat(F.lit("ORD-"), F.col("l_orderkey").cast("string"),
                               F.lit("-"), F.col("l_linenumber").cast("string"))))
    vendor = (F.when(pk % 107 == 0, F.lit(None).cast("string"))
              .when(F.col("s_suppkey") % 3 == 0, F.concat(F.upper("s_name"), F.lit(" ")))
              .otherwise(F.col("s_name")))
    items = (F.when(pk % 109 == 0, F.lit(None).cast("string"))
             .when(pk % 113 == 0, F.lit("n/a"))
             .when(pk % 127 == 0, F.lit("12.5"))
             .when(pk % 139 == 0, F.lit("0"))
             .otherwise(F.col("l_quantity").cast("int").cast("string")))
    submitted = (F.when(pk % 131 == 0, F.lit("n/a"))
                 .when(pk % 137 == 0, F.lit("-5.00"))
                 .when(pk % 149 == 0, F.lit(None).cast("string"))
                 .otherwise(_money_text("l_extendedprice")))
    place = [F.concat(F.lit("vendor_orders_"), F.col("l_orderkey").cast("string"),
                      F.lit(".csv")).alias("_source_file"), F.col("_line")] if numbered else []
    return lines.select(
        ref.alias("order_ref"),
        vendor.alias("vendor"),
        items.alias("item_count"),
        submitted.alias("submitted_amount"),
        *place,
        F.concat(F.lit("batch-"), F.date_format("o_orderdate", "yyyy-MM")).alias("batch_id"),
    )


# ---------------------------------------------------------------------------
# contracts: vendor -> (unit_rate, discount_pct); suppliers with a negative
# balance have no contract on file (their orders end up "errored").
# ---------------------------------------------------------------------------
def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    return s.filter(F.col("s_acctbal") >= 0).select(
        F.lower("s_name").alias("vendor"),
        (F.lit(1500) + F.lit(10) * (F.col("s_suppkey") % 10)).cast("decimal(10,4)").alias("unit_rate"),
        (F.col("s_suppkey") % 11).cast("decimal(7,4)").alias("discount_pct"),
    )


# ---------------------------------------------------------------------------
# reviewer decisions: click -> approve, error -> deny, anything else is not a
# valid decision; `value` is the delay in seconds after review opened.
# ---------------------------------------------------------------------------
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event decides on one order line; the line's batch (order month) and
    vendor (its least supplier) make the key of the order's lifecycle."""
    e = read_table(spark, sf_dir, "events")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    made = e.select(
        F.col("event_id").alias("decision_id"),
        F.floor(F.col("event_id") / 2).alias("l_orderkey"), (F.col("user_id") % 3 + 1).alias("l_linenumber"),
        F.coalesce(_case("event_type", DECISION_BY_EVENT),
                   F.col("event_type")).alias("decision"),
        F.concat(F.lit("k="), F.get_json_object("props", "$.k")).alias("note"),
        F.col("value").cast("decimal(12,2)").alias("delay_s"),
    )
    # only lines that some event names are grouped and joined further
    l = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("long"), "l_suppkey")
    n = tasks_for(spark, l.count())
    named = made.select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("long")).repartition(n, "l_orderkey", "l_linenumber")
    lines = (l.repartition(n, "l_orderkey", "l_linenumber")
             .join(named, ["l_orderkey", "l_linenumber"], "left_semi")
             .groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s_suppkey")).join(s, "s_suppkey")
             .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
             .select("l_orderkey", "l_linenumber", F.lower("s_name").alias("vendor"),
                     F.concat(F.lit("batch-"), F.date_format("o_orderdate", "yyyy-MM")).alias("batch_id")))
    return made.join(lines, ["l_orderkey", "l_linenumber"]).select(
        "decision_id", "batch_id", "vendor",
        F.concat(F.lit("ORD-"), F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias("order_ref"), "decision", "note", "delay_s")


# ---------------------------------------------------------------------------
# lifecycle events: one row per stage transition of an order run.
# ---------------------------------------------------------------------------
def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    return e.select(
        F.col("event_id"),
        F.concat(F.lit("ORD-"), F.col("user_id").cast("string")).alias("order_ref"),
        F.concat(F.lit("order-"), F.col("user_id").cast("string"), F.lit("-"), day).alias("run_id"),
        F.concat(F.lit("batch-"), day).alias("batch_id"),
        F.lit("vendor-orders").alias("route"),
        F.concat(F.lit("vendor_orders_"), day, F.lit(".csv")).alias("source_file"),
        _case("event_type", STAGE_BY_EVENT).alias("stage"),
        F.col("ts"),
    )


# ---------------------------------------------------------------------------
# review signals: a purchase opens the review of its user's order of the day;
# every other event is a signal on it (see DECISION_BY_EVENT).
# ---------------------------------------------------------------------------
def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, read as a stream."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    found = f"{path[:-1]}[{path[-1]}]"               # a pattern: a stream's plain path must be a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(found).withColumn("ts", F.col("ts").cast("timestamp"))


def review_signals(events: DataFrame) -> DataFrame:
    """Events (a table or a stream) as the input of ``streaming.order_status``."""
    opened = F.col("event_type") == "purchase"
    return events.select(
        F.concat(F.lit("batch-"), F.date_format("ts", "yyyy-MM-dd")).alias("batch_id"),
        F.concat(F.lit("vendor-"), (F.col("user_id") % 10).cast("string")).alias("vendor"),
        F.concat(F.lit("ORD-"), F.col("user_id").cast("string")).alias("order_ref"),
        F.when(opened, "opened").otherwise("decision").alias("kind"), "ts",
        F.when(~opened, F.coalesce(_case("event_type", DECISION_BY_EVENT), F.col("event_type"))).alias("decision"),
        F.when(~opened, F.concat(F.lit("k="), F.get_json_object("props", "$.k"))).alias("note"),
        F.when(~opened, F.col("event_id")).alias("decision_id"), "event_id")


def review_openings(events: DataFrame) -> DataFrame:
    """Every purchase opens a review of its own (input of ``streaming.decisions``)."""
    return review_signals(events).where(F.col("kind") == "opened").select(
        "vendor", "order_ref", F.col("event_id").alias("review_id"), F.col("ts").alias("opened_at"))


def review_decisions(events: DataFrame) -> DataFrame:
    return review_signals(events).where(F.col("kind") == "decision").select(
        "vendor", "order_ref", F.col("event_id").alias("decision_id"), F.col("ts").alias("decided_at"), "decision", "note")


# ---------------------------------------------------------------------------
# file inventory: names of vendor drops, derived row by row from the tables
# (one drop per order, customer, payment line, event and page), including
# gzip twins, wrong-case names and unroutable junk.
# ---------------------------------------------------------------------------
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer")
    l = read_table(spark, sf_dir, "lineitem")
    e = read_table(spark, sf_dir, "events")
    p = read_table(spark, sf_dir, "pages")
    s = F.col
    orders = o.select(
        F.concat(F.when(s("o_orderstatus") == "P", F.lit("ORDERS_")).otherwise(F.lit("orders_")),
                 F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_"),
                 s("o_orderkey").cast("string"), F.lit(".csv")).alias("file_name"),
        F.col("o_orderdate").cast("timestamp").alias("modified_at"))
    customers = c.select(
        F.concat(F.lit("customers_"), s("c_custkey").cast("string"),
                 F.when(s("c_acctbal") < 0, F.lit(".csv.gz")).otherwise(F.lit(".csv"))).alias("file_name"),
        F.lit("1995-01-01 00:00:00").cast("timestamp").alias("modified_at"))
    # Only payment names can repeat (one per line, and line keys are not
    # unique): collapse them on the numeric keys, then build the names.
    pay_keys = l.groupBy("l_orderkey", "l_linenumber", (s("l_returnflag") == "R").alias("_plain")) \
        .agg(F.max("l_shipdate").alias("_mtime"))
    payments = pay_keys.select(
        F.concat(F.lit("payments_"), s("l_orderkey").cast("string"), F.lit("_"),
                 s("l_linenumber").cast("string"),
                 F.when(s("_plain"), F.lit(".csv")).otherwise(F.lit(".csv.gz"))).alias("file_name"),
        s("_mtime").cast("timestamp").alias("modified_at"))
    vendor = o.select(
        F.concat(F.lit("vendor_orders_"), s("o_orderkey").cast("string"), F.lit(".csv")).alias("file_name"),
        s("o_orderdate").cast("timestamp").alias("modified_at"))
    events = e.select(
        F.concat(s("event_type"), F.lit("_"), s("event_id").cast("string"), F.lit(".json")).alias("file_name"),
        s("ts").cast("timestamp").alias("modified_at"))
    pages = p.select(
        F.concat(F.lit("zz_page_"), s("page_id").cast("string"), F.lit(".csv")).alias("file_name"),
        F.lit("1995-01-01 00:00:00").cast("timestamp").alias("modified_at"))
    # A listing holds each name once: every other source is keyed uniquely
    # (order, customer, event, page), so the union needs no global dedupe.
    return orders.unionByName(customers).unionByName(payments).unionByName(vendor) \
        .unionByName(events).unionByName(pages)


# ---------------------------------------------------------------------------
# The same adapters as DuckDB SQL (for the oracle).  Column names are the
# sanitized/aliased ones where the Spark side applies hygiene on top.
# ---------------------------------------------------------------------------
def _sql_money(col: str) -> str:
    return f"CAST(CAST({col} AS DECIMAL(18,2)) AS VARCHAR)"


ADAPTER_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "review_signals": ((), f"""
        SELECT 'batch-' || strftime(ts, '%Y-%m-%d') AS batch_id, 'vendor-' || CAST(user_id % 10 AS VARCHAR) AS vendor,
               'ORD-' || CAST(user_id AS VARCHAR) AS order_ref, event_type = 'purchase' AS opened, ts,
               coalesce({_sql_case('event_type', DECISION_BY_EVENT)}, event_type) AS decision,
               'k=' || json_extract_string(props, '$.k') AS note, event_id AS decision_id
        FROM events"""),
    "raw_orders": ((), f"""
        SELECT CAST(o.o_orderkey AS VARCHAR) AS order_id, c.c_name AS customer,
               CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR) AS order_date,
               {_sql_money('o.o_totalprice')} AS amount,
               {_sql_case('o.o_orderstatus', ORDER_STATUS_TEXT)} AS status,
               'orders_' || strftime(o.o_orderdate, '%Y-%m') || '.csv' AS _source_file
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""),
    "raw_customers": ((), """
        SELECT c.c_name AS customer, ' ' || c.c_mktsegment AS segment, r.r_name AS region,
               'customers_' || lower(r.r_name) || '.csv' AS _source_file
        FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN region r ON n.n_regionkey = r.r_regionkey"""),
    "net_lines": ((), """
        SELECT *, round(CAST(l_extendedprice AS DECIMAL(18,2))
                        * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS _net
        FROM lineitem"""),
    "raw_payments": (("net_lines",), """
        SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS payment_id,
               CAST(l_orderkey AS VARCHAR) AS order_id,
               CAST(sum(_net) AS VARCHAR) AS paid_amount,
               CAST(min(CAST(l_shipdate AS DATE)) AS VARCHAR) AS paid_date,
               'payments_' || strftime(min(CAST(l_shipdate AS DATE)), '%Y-%m') || '.csv' AS _source_file
        FROM net_lines GROUP BY l_orderkey, l_linenumber"""),
    "raw_payment_lines": (("net_lines",), """
        SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS payment_id,
               CAST(l_orderkey AS VARCHAR) AS order_id,
               CAST(_net AS VARCHAR) AS paid_amount,
               CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS paid_date,
               'payments_' || strftime(l_shipdate, '%Y-%m') || '.csv' AS _source_file
        FROM net_lines"""),
    "raw_vendor_orders": ((), f"""
        SELECT CASE WHEN l.l_partkey % 101 = 0 THEN NULL
                    WHEN l.l_partkey % 103 = 0 THEN '  '
                    ELSE 'ORD-' || CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) END AS order_ref,
               CASE WHEN l.l_partkey % 107 = 0 THEN NULL
                    WHEN s.s_suppkey % 3 = 0 THEN upper(s.s_name) || ' '
                    ELSE s.s_name END AS vendor,
               CASE WHEN l.l_partkey % 109 = 0 THEN NULL
                    WHEN l.l_partkey % 113 = 0 THEN 'n/a'
                    WHEN l.l_partkey % 127 = 0 THEN '12.5'
                    WHEN l.l_partkey % 139 = 0 THEN '0'
                    ELSE CAST(CAST(l.l_quantity AS INTEGER) AS VARCHAR) END AS item_count,
               CASE WHEN l.l_partkey % 131 = 0 THEN 'n/a'
                    WHEN l.l_partkey % 137 = 0 THEN '-5.00'
                    WHEN l.l_partkey % 149 = 0 THEN NULL
                    ELSE {_sql_money('l.l_extendedprice')} END AS submitted_amount,
               'vendor_orders_' || CAST(l.l_orderkey AS VARCHAR) || '.csv' AS _source_file,
               row_number() OVER (PARTITION BY l.l_orderkey ORDER BY
                   {', '.join('l.' + c for c in VENDOR_ORDER_SORT)}) + 1 AS _line,
               'batch-' || strftime(o.o_orderdate, '%Y-%m') AS batch_id
        FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
        JOIN orders o ON l.l_orderkey = o.o_orderkey"""),
    "contracts": ((), """
        SELECT lower(s_name) AS vendor,
               CAST(1500 + 10 * (s_suppkey % 10) AS DECIMAL(10,4)) AS unit_rate,
               CAST(s_suppkey % 11 AS DECIMAL(7,4)) AS discount_pct
        FROM supplier WHERE s_acctbal >= 0"""),
    "decisions": ((), f"""
        SELECT e.event_id AS decision_id, 'batch-' || strftime(o.o_orderdate, '%Y-%m') AS batch_id,
               lower(s.s_name) AS vendor,
               'ORD-' || CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS order_ref,
               coalesce({_sql_case('event_type', DECISION_BY_EVENT)}, event_type) AS decision,
               'k=' || json_extract_string(props, '$.k') AS note,
               CAST(value AS DECIMAL(12,2)) AS delay_s
        FROM events e
        JOIN (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS suppkey FROM lineitem GROUP BY ALL) l
          ON l.l_orderkey = floor(e.event_id / 2) AND l.l_linenumber = e.user_id % 3 + 1
        JOIN supplier s ON s.s_suppkey = l.suppkey
        JOIN orders o ON o.o_orderkey = l.l_orderkey"""),
    "lifecycle_events": ((), f"""
        SELECT event_id, 'ORD-' || CAST(user_id AS VARCHAR) AS order_ref,
               'order-' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS run_id,
               'batch-' || strftime(ts, '%Y-%m-%d') AS batch_id,
               'vendor-orders' AS route,
               'vendor_orders_' || strftime(ts, '%Y-%m-%d') || '.csv' AS source_file,
               {_sql_case('event_type', STAGE_BY_EVENT)} AS stage, ts
        FROM events"""),
    "file_inventory": (("file_listing",), """
        SELECT file_name, max(modified_at) AS modified_at FROM file_listing GROUP BY file_name"""),
    "file_listing": ((), """
        SELECT CASE WHEN o_orderstatus = 'P' THEN 'ORDERS_' ELSE 'orders_' END
                   || strftime(o_orderdate, '%Y-%m-%d') || '_' || CAST(o_orderkey AS VARCHAR) || '.csv' AS file_name,
               CAST(o_orderdate AS TIMESTAMP) AS modified_at FROM orders
        UNION ALL
        SELECT 'customers_' || CAST(c_custkey AS VARCHAR)
                   || CASE WHEN c_acctbal < 0 THEN '.csv.gz' ELSE '.csv' END,
               TIMESTAMP '1995-01-01 00:00:00' FROM customer
        UNION ALL
        SELECT 'payments_' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR)
                   || CASE WHEN l_returnflag = 'R' THEN '.csv' ELSE '.csv.gz' END,
               CAST(l_shipdate AS TIMESTAMP) FROM lineitem
        UNION ALL
        SELECT 'vendor_orders_' || CAST(o_orderkey AS VARCHAR) || '.csv', CAST(o_orderdate AS TIMESTAMP) FROM orders
        UNION ALL
        SELECT event_type || '_' || CAST(event_id AS VARCHAR) || '.json', CAST(ts AS TIMESTAMP) FROM events
        UNION ALL
        SELECT 'zz_page_' || CAST(page_id AS VARCHAR) || '.csv', TIMESTAMP '1995-01-01 00:00:00' FROM pages"""),
}
