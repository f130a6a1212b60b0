"""The registered queries: one per operator of the inventory.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the operator over the
driver's tables (through the adapters); ``ORACLE_SQL[name]`` states the same
result in DuckDB SQL.  Column names are identical on both sides.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vendorlake.model import SPECS, canonical_columns
from vendorlake.operators import marts
from vendorlake.operators.hygiene import apply_hygiene
from vendorlake.operators.staging import build_staging
from vendorlake.plans.oracle import _CONTRACT_1998, sql_str, with_ctes
from vendorlake.sources import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


# --------------------------------------------------------------------------
# landed + staged inputs (shared by many queries)
# --------------------------------------------------------------------------
def landed_orders(spark, sf):
    return apply_hygiene(A.raw_orders(spark, sf), required=canonical_columns("stg_orders"))


def landed_customers(spark, sf):
    return apply_hygiene(A.raw_customers(spark, sf),
                         aliases=SPECS["transform-spec-2"].column_aliases,
                         required=canonical_columns("stg_customers"))


def landed_payments(spark, sf):
    return apply_hygiene(A.raw_payments(spark, sf), required=canonical_columns("stg_payments"))


def staged_orders(spark, sf):
    return build_staging(landed_orders(spark, sf), "stg_orders")


def staged_customers(spark, sf):
    return build_staging(landed_customers(spark, sf), "stg_customers")


def staged_payments(spark, sf):
    return build_staging(landed_payments(spark, sf), "stg_payments")


# --------------------------------------------------------------------------
# 2.7 marts
# --------------------------------------------------------------------------
@query("daily_revenue", with_ctes("""
    SELECT order_date, count(*) AS order_count,
           CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) AS total_revenue
    FROM stg_orders WHERE status = 'completed' GROUP BY order_date ORDER BY order_date""",
                                  "stg_orders"))
def q_daily_revenue(spark, sf):
    return marts.daily_revenue(staged_orders(spark, sf))


@query("dim_customers", with_ctes("SELECT customer, segment, region FROM dim_customers",
                                  "dim_customers"))
def q_dim_customers(spark, sf):
    return marts.dim_customers(staged_customers(spark, sf))


@query("fct_payments", with_ctes(
    "SELECT payment_id, order_id, paid_amount, paid_date FROM fct_payments", "fct_payments"))
def q_fct_payments(spark, sf):
    return marts.fct_payments(staged_payments(spark, sf))


@query("executive_summary", with_ctes("""
    SELECT c.segment, count(DISTINCT o.order_id) AS orders_count,
           CAST(round(sum(CAST(o.amount AS DECIMAL(28,6))), 2) AS DOUBLE) AS revenue,
           CAST(round(coalesce(sum(p.paid_amount), 0), 2) AS DOUBLE) AS collected,
           CAST(round(coalesce(sum(p.paid_amount), 0) / sum(CAST(o.amount AS DECIMAL(28,6))), 3) AS DOUBLE)
               AS collection_rate
    FROM (SELECT * FROM stg_orders WHERE status = 'completed') o
    JOIN dim_customers c ON o.customer = c.customer
    LEFT JOIN paid p ON p.order_id = o.order_id
    GROUP BY c.segment ORDER BY c.segment""", "stg_orders", "dim_customers", "paid"))
def q_executive_summary(spark, sf):
    return marts.executive_summary(staged_orders(spark, sf),
                                   marts.dim_customers(staged_customers(spark, sf)),
                                   marts.fct_payments(staged_payments(spark, sf)))


@query("invoice_summary", with_ctes("""
    SELECT customer, count(*) AS lines, CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) AS total,
           printf('invoice.pdf for %s: %d lines, $%.2f', customer, count(*),
                  CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE)) AS invoice
    FROM stg_orders GROUP BY customer""", "stg_orders"))
def q_invoice_summary(spark, sf):
    return marts.invoice_summary(staged_orders(spark, sf))


# --------------------------------------------------------------------------
# 2.6 joins
# --------------------------------------------------------------------------
@query("join_customer_using", with_ctes("""
    SELECT o.customer, o.order_id, o.order_date, o.amount, o.status, c.segment, c.region
    FROM stg_orders o JOIN dim_customers c ON o.customer = c.customer
    WHERE o.status = 'completed'""", "stg_orders", "dim_customers"))
def q_join_customer_using(spark, sf):
    return marts.completed_with_segment(
        staged_orders(spark, sf), marts.dim_customers(staged_customers(spark, sf)))


@query("join_paid_left", with_ctes("""
    SELECT o.order_id, o.customer, o.order_date, o.amount, o.status,
           CAST(p.paid_amount AS DOUBLE) AS paid_amount
    FROM stg_orders o LEFT JOIN paid p ON p.order_id = o.order_id""", "stg_orders", "paid"))
def q_join_paid_left(spark, sf):
    from pyspark.sql import functions as F
    j = marts.orders_with_payments(staged_orders(spark, sf), marts.fct_payments(staged_payments(spark, sf)))
    return j.withColumn("paid_amount", F.col("paid_amount").cast("double"))


# --------------------------------------------------------------------------
# 2.3 hygiene / 2.4 staging
# --------------------------------------------------------------------------
@query("sanitize_headers", with_ctes(
    "SELECT order_id, customer, order_date, amount, status, _source_file FROM raw_orders", "raw_orders"))
def q_sanitize_headers(spark, sf):
    from vendorlake.operators.hygiene import sanitize_headers
    return sanitize_headers(A.raw_orders(spark, sf))


@query("alias_columns", with_ctes(
    "SELECT customer, segment, region, _source_file FROM raw_customers", "raw_customers"))
def q_alias_columns(spark, sf):
    from vendorlake.operators.hygiene import alias_columns, sanitize_headers
    return alias_columns(sanitize_headers(A.raw_customers(spark, sf)),
                         SPECS["transform-spec-2"].column_aliases)


@query("build_staging", with_ctes(
    "SELECT order_id, customer, order_date, amount, status FROM stg_orders", "stg_orders"))
def q_build_staging(spark, sf):
    return build_staging(landed_orders(spark, sf), "stg_orders")


@query("stg_orders", with_ctes(
    "SELECT order_id, customer, order_date, amount, status FROM stg_orders", "stg_orders"))
def q_stg_orders(spark, sf):
    return staged_orders(spark, sf)


@query("stg_customers", with_ctes(
    "SELECT customer, segment, region FROM stg_customers", "stg_customers"))
def q_stg_customers(spark, sf):
    return staged_customers(spark, sf)


@query("stg_payments", with_ctes(
    "SELECT payment_id, order_id, paid_amount, paid_date FROM stg_payments", "stg_payments"))
def q_stg_payments(spark, sf):
    return staged_payments(spark, sf)


# --------------------------------------------------------------------------
# 2.5 data tests and gates
# --------------------------------------------------------------------------
def staged_payment_lines(spark, sf, keep_lineage=True):
    raw = apply_hygiene(A.raw_payment_lines(spark, sf), required=canonical_columns("stg_payments"))
    return build_staging(raw, "stg_payments", keep_lineage=keep_lineage)


@query("test_not_null", with_ctes("""
    SELECT count(*) FILTER (WHERE order_id IS NULL) AS order_id,
           count(*) FILTER (WHERE customer IS NULL) AS customer,
           count(*) FILTER (WHERE order_date IS NULL) AS order_date,
           count(*) FILTER (WHERE amount IS NULL) AS amount,
           count(*) FILTER (WHERE status IS NULL) AS status
    FROM stg_orders""", "stg_orders"))
def q_test_not_null(spark, sf):
    from vendorlake.operators.quality import test_not_null
    return test_not_null(staged_orders(spark, sf),
                         ["order_id", "customer", "order_date", "amount", "status"])


@query("test_unique", with_ctes("""
    SELECT payment_id, count(*) AS n_records FROM stg_payment_lines
    WHERE payment_id IS NOT NULL GROUP BY payment_id HAVING count(*) > 1""", "stg_payment_lines"))
def q_test_unique(spark, sf):
    from vendorlake.operators.quality import test_unique
    return test_unique(staged_payment_lines(spark, sf), "payment_id")


@query("test_accepted_values", with_ctes("""
    SELECT status, count(*) AS n_records FROM raw_orders
    WHERE status IS NOT NULL AND status NOT IN ('completed', 'cancelled', 'pending')
    GROUP BY status""", "raw_orders"))
def q_test_accepted_values(spark, sf):
    from vendorlake.operators.quality import test_accepted_values
    return test_accepted_values(landed_orders(spark, sf), "status",
                                ("completed", "cancelled", "pending"))


_TEST_REPORT_SQL = """
    SELECT 'stg_payments' AS model, 'payment_id' AS column_name, 'not_null' AS test_name,
           count(*) FILTER (WHERE payment_id IS NULL) AS failures FROM stg_payment_lines
    UNION ALL SELECT 'stg_payments', 'order_id', 'not_null', count(*) FILTER (WHERE order_id IS NULL) FROM stg_payment_lines
    UNION ALL SELECT 'stg_payments', 'paid_amount', 'not_null', count(*) FILTER (WHERE paid_amount IS NULL) FROM stg_payment_lines
    UNION ALL SELECT 'stg_payments', 'paid_date', 'not_null', count(*) FILTER (WHERE paid_date IS NULL) FROM stg_payment_lines
    UNION ALL SELECT 'stg_payments', 'payment_id', 'unique', count(*) FROM
        (SELECT payment_id FROM stg_payment_lines WHERE payment_id IS NOT NULL
         GROUP BY payment_id HAVING count(*) > 1) d"""


@query("test_report", with_ctes(_TEST_REPORT_SQL, "stg_payment_lines"))
def q_test_report(spark, sf):
    from vendorlake.operators.quality import run_tests
    return run_tests(staged_payment_lines(spark, sf, keep_lineage=False), "stg_payments")


@query("cast_gate", with_ctes("""
    SELECT _source_file, column_name, bad_cells FROM (
      SELECT _source_file, 'item_count' AS column_name,
             count(*) FILTER (WHERE item_count IS NOT NULL AND NOT regexp_matches(item_count, '^[+-]?[0-9]+$'))
               AS bad_cells
      FROM raw_vendor_orders GROUP BY _source_file
      UNION ALL
      SELECT _source_file, 'submitted_amount',
             count(*) FILTER (WHERE submitted_amount IS NOT NULL AND TRY_CAST(submitted_amount AS DOUBLE) IS NULL)
      FROM raw_vendor_orders GROUP BY _source_file) t
    WHERE bad_cells > 0""", "raw_vendor_orders"))
def q_cast_gate(spark, sf):
    from vendorlake.operators.quality import cast_gate
    return cast_gate(A.raw_vendor_orders(spark, sf, once=True), "stg_settlements", ["_source_file"])


_GATE_SQL = """
    SELECT _source_file,
           'data tests failed: ' || string_agg(item, '; ' ORDER BY item) AS reason
    FROM (
      SELECT _source_file, 'unique(payment_id)=' || CAST(count(*) AS VARCHAR) AS item
      FROM (SELECT _source_file, payment_id FROM stg_payment_lines WHERE payment_id IS NOT NULL
            GROUP BY _source_file, payment_id HAVING count(*) > 1) d
      GROUP BY _source_file) t
    GROUP BY _source_file"""


@query("quality_gate", with_ctes(_GATE_SQL, "stg_payment_lines"))
def q_quality_gate(spark, sf):
    from vendorlake.operators.quality import quality_gate
    raw = apply_hygiene(A.raw_payment_lines(spark, sf), required=canonical_columns("stg_payments"))
    return quality_gate(raw, "stg_payments")[1]


@query("anti_join_rejects", with_ctes(f"""
    SELECT payment_id, order_id, paid_amount, paid_date, _source_file FROM stg_payment_lines s
    WHERE NOT EXISTS (SELECT 1 FROM ({_GATE_SQL}) r WHERE r._source_file = s._source_file)""",
                                      "stg_payment_lines"))
def q_anti_join_rejects(spark, sf):
    from vendorlake.operators.quality import quality_gate
    raw = apply_hygiene(A.raw_payment_lines(spark, sf), required=canonical_columns("stg_payments"))
    return quality_gate(raw, "stg_payments")[0]


# --------------------------------------------------------------------------
# 2.10 settlement
# --------------------------------------------------------------------------
def split_records(spark, sf, once=False):
    """Written to the shared folder, unless the caller reads them ``once``: readers that
    pass over them several times do not parse their cells again."""
    from vendorlake.operators.settlement import split_orders
    from vendorlake.session import materialize
    records = split_orders(A.raw_vendor_orders(spark, sf, once=True))
    return records if once else materialize(records, "split_records")


#: The vendor orders of a session and folder, split, numbered and landed once.
_RECORDS: dict[tuple[str, str], str] = {}


def _buckets(spark, sf):
    """Buckets for the vendor records."""
    from vendorlake.session import tasks_for
    return tasks_for(spark, A.read_table(spark, sf, "lineitem").count())


def landed_records(spark, sf):
    """The split records as a table bucketed by their lifecycle key."""
    from vendorlake.operators.landed_tables import land_bucketed
    from vendorlake.operators.settlement import LIFECYCLE_KEY
    from vendorlake.session import scratch_path
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RECORDS:
        table = f"landed.vendor_records_{_fresh()}"
        land_bucketed(split_records(spark, sf, once=True), table, list(LIFECYCLE_KEY), _buckets(spark, sf),
                      per=None, location=scratch_path(spark, "vendor-records"))
        _RECORDS[key] = table
    return spark.table(_RECORDS[key])


def settled_records(spark, sf):
    from vendorlake.operators.settlement import settle
    return settle(landed_records(spark, sf), A.contracts(spark, sf), A.decisions(spark, sf), landed=True)


def _sub(df):
    from pyspark.sql import functions as F
    return df.withColumn("submitted_amount", F.col("_submitted").cast("double")).drop("_submitted")


_SPLIT_COLS = "batch_id, _source_file, _line, order_ref, vendor, item_count"


@query("split_orders", with_ctes(f"""
    SELECT {_SPLIT_COLS}, CAST(_submitted AS DOUBLE) AS submitted_amount, parse_error FROM split""",
                                 "split"))
def q_split_orders(spark, sf):
    return _sub(split_records(spark, sf, once=True))


@query("dedupe_orders", with_ctes(f"""
    SELECT {_SPLIT_COLS}, is_duplicate FROM deduped""", "deduped"))
def q_dedupe_orders(spark, sf):
    from vendorlake.operators.settlement import dedupe_orders
    return dedupe_orders(split_records(spark, sf)).select(
        *[c.strip() for c in _SPLIT_COLS.split(",")], "is_duplicate")


@query("validate_orders", with_ctes(f"""
    SELECT {_SPLIT_COLS}, CAST(_submitted AS DOUBLE) AS submitted_amount, validation_note FROM validated
    WHERE NOT is_duplicate""", "validated"))
def q_validate_orders(spark, sf):
    from pyspark.sql import functions as F
    from vendorlake.operators.settlement import dedupe_orders, validate_orders
    v = validate_orders(dedupe_orders(split_records(spark, sf))).filter(~F.col("is_duplicate"))
    return _sub(v.drop("parse_error", "is_duplicate"))


@query("contract_lookup", with_ctes("""
    SELECT batch_id, order_ref, vendor, unit_rate, discount_pct, _has_contract AS has_contract
    FROM contracted WHERE NOT is_duplicate AND validation_note IS NULL""", "contracted"))
def q_contract_lookup(spark, sf):
    from pyspark.sql import functions as F
    from vendorlake.operators.settlement import dedupe_orders, lookup_contracts, validate_orders
    v = validate_orders(dedupe_orders(split_records(spark, sf)))
    v = v.filter(~F.col("is_duplicate") & F.col("validation_note").isNull())
    c = lookup_contracts(v, A.contracts(spark, sf))
    return c.select("batch_id", "order_ref", "vendor", "unit_rate", "discount_pct",
                    F.col("_has_contract").isNotNull().alias("has_contract"))


@query("price_orders", with_ctes("""
    SELECT batch_id, order_ref, vendor, item_count, CAST(_submitted AS DOUBLE) AS submitted_amount,
           CAST(_priced AS DOUBLE) AS priced_amount, CAST(_variance AS DOUBLE) AS variance_pct
    FROM priced WHERE NOT is_duplicate AND validation_note IS NULL AND _has_contract""", "priced"))
def q_price_orders(spark, sf):
    from pyspark.sql import functions as F
    from vendorlake.operators.settlement import (
        dedupe_orders, lookup_contracts, price_orders, validate_orders)
    v = validate_orders(dedupe_orders(split_records(spark, sf)))
    v = v.filter(~F.col("is_duplicate") & F.col("validation_note").isNull())
    p = price_orders(lookup_contracts(v, A.contracts(spark, sf))).filter(F.col("_has_contract"))
    return p.select("batch_id", "order_ref", "vendor", "item_count",
                    F.col("_submitted").cast("double").alias("submitted_amount"),
                    F.col("_priced").cast("double").alias("priced_amount"),
                    F.col("_variance").cast("double").alias("variance_pct"))


_SETTLED_COLS = ("batch_id, order_ref, vendor, _source_file, _line, outcome, decision_source, "
                 "payable_amount, note")


@query("variance_gate", with_ctes("""
    SELECT batch_id, order_ref, vendor, _source_file, _line, CAST(_variance AS DOUBLE) AS variance_pct,
           NOT _review AS auto_settled
    FROM settled WHERE outcome <> 'duplicate' AND outcome <> 'errored' AND validation_note IS NULL""",
                                  "settled"))
def q_variance_gate(spark, sf):
    from pyspark.sql import functions as F
    s = settled_records(spark, sf).filter(
        ~F.col("outcome").isin("duplicate", "errored") & F.col("validation_note").isNull())
    return s.select("batch_id", "order_ref", "vendor", "_source_file", "_line",
                    F.col("_variance").cast("double").alias("variance_pct"),
                    (~F.col("_review")).alias("auto_settled"))


@query("decision_within_sla", with_ctes("""
    SELECT s.batch_id, s.order_ref, s.vendor, s._source_file, s._line, d.decision_id, d.decision,
           d.delay_s
    FROM settled s JOIN decisions d
      ON s.batch_id = d.batch_id AND s.vendor = d.vendor AND s.order_ref = d.order_ref
    WHERE s._review AND d.decision IN ('approve', 'deny') AND d.delay_s <= 300""", "settled", "decisions"))
def q_decision_within_sla(spark, sf):
    from pyspark.sql import functions as F
    from vendorlake.model import REVIEW_SLA_SECONDS, VALID_DECISIONS
    s = settled_records(spark, sf).filter(F.col("_review")).select(
        "batch_id", "order_ref", "vendor", "_source_file", "_line")
    d = A.decisions(spark, sf).filter(F.col("decision").isin(*VALID_DECISIONS)
                                      & (F.col("delay_s") <= REVIEW_SLA_SECONDS))
    from vendorlake.operators.settlement import LIFECYCLE_KEY
    # one reviewed record per lifecycle (twins never enter review), so nothing fans out
    return s.join(d.select(*LIFECYCLE_KEY, "decision_id", "decision", "delay_s"), list(LIFECYCLE_KEY))


@query("apply_decisions", with_ctes(f"""
    SELECT {_SETTLED_COLS}, decision_id FROM settled WHERE decision_source = 'reviewer'""", "settled"))
def q_apply_decisions(spark, sf):
    from pyspark.sql import functions as F
    s = settled_records(spark, sf).filter(F.col("decision_source") == "reviewer")
    return s.select(*[c.strip() for c in _SETTLED_COLS.split(",")], "decision_id")


@query("sla_outcome", with_ctes(f"""
    SELECT {_SETTLED_COLS} FROM settled WHERE decision_source = 'sla_timeout'""", "settled"))
def q_sla_outcome(spark, sf):
    from pyspark.sql import functions as F
    s = settled_records(spark, sf).filter(F.col("decision_source") == "sla_timeout")
    return s.select(*[c.strip() for c in _SETTLED_COLS.split(",")])


@query("outcome_rows", with_ctes("SELECT * FROM outcomes", "outcomes"))
def q_outcome_rows(spark, sf):
    from vendorlake.operators.settlement import outcome_rows
    return outcome_rows(settled_records(spark, sf))


_REPORT_SQL = """
    SELECT batch_id, count(*) AS orders,
           count(*) FILTER (WHERE outcome = 'settled') AS settled,
           count(*) FILTER (WHERE outcome = 'denied') AS denied,
           count(*) FILTER (WHERE outcome = 'escalated') AS escalated,
           count(*) FILTER (WHERE outcome = 'duplicate') AS duplicate,
           count(*) FILTER (WHERE outcome = 'errored') AS errored,
           count(*) FILTER (WHERE decision_source = 'auto') AS auto,
           count(*) FILTER (WHERE decision_source = 'reviewer') AS reviewer,
           count(*) FILTER (WHERE decision_source = 'validation') AS validation,
           count(*) FILTER (WHERE decision_source = 'sla_timeout') AS sla_timeout
    FROM {settled} GROUP BY batch_id"""


@query("settlement_report", with_ctes(_REPORT_SQL.format(settled="settled"), "settled"))
def q_settlement_report(spark, sf):
    from vendorlake.operators.settlement import settlement_report
    return settlement_report(settled_records(spark, sf))


@query("stg_settlements", with_ctes("SELECT * FROM stg_settlements", "stg_settlements"))
def q_stg_settlements(spark, sf):
    from vendorlake.operators.settlement import outcome_rows
    return build_staging(outcome_rows(settled_records(spark, sf)), "stg_settlements")


_PRICING_SQL = """
    SELECT vendor, count(*) AS orders_count,
           count(*) FILTER (WHERE outcome = 'settled') AS settled_count,
           count(*) FILTER (WHERE outcome = 'denied') AS denied_count,
           count(*) FILTER (WHERE outcome = 'escalated') AS escalated_count,
           CAST(round(sum(CAST(submitted_amount AS DECIMAL(28,6))), 2) AS DOUBLE) AS submitted_total,
           CAST(round(sum(CAST(payable_amount AS DECIMAL(28,6))), 2) AS DOUBLE) AS payable_total,
           CAST(round(sum(CAST(submitted_amount AS DECIMAL(28,6)))
                      - sum(CAST(payable_amount AS DECIMAL(28,6))), 2) AS DOUBLE) AS savings
    FROM stg_settlements GROUP BY vendor ORDER BY vendor"""


@query("pricing_summary", with_ctes(_PRICING_SQL, "stg_settlements"))
def q_pricing_summary(spark, sf):
    return marts.pricing_summary(q_stg_settlements(spark, sf))


# --------------------------------------------------------------------------
# 2.1 / 2.2 files: naming, routing, duplicates, quarantine, report
# --------------------------------------------------------------------------
def _routed(spark, sf):
    from vendorlake.operators.routing import classify_route
    return classify_route(A.file_inventory(spark, sf))


@query("decompressed_name", with_ctes("""
    SELECT file_name, regexp_replace(file_name, '\\.gz$', '') AS decompressed_name FROM file_inventory""",
                                      "file_inventory"))
def q_decompressed_name(spark, sf):
    from pyspark.sql import functions as F
    from vendorlake.functions.names import decompressed_name_col
    inv = A.file_inventory(spark, sf)
    return inv.select("file_name", decompressed_name_col(F.col("file_name")).alias("decompressed_name"))


@query("classify_route", with_ctes("SELECT file_name, decompressed_name, route FROM routed", "routed"))
def q_classify_route(spark, sf):
    return _routed(spark, sf).select("file_name", "decompressed_name", "route")


@query("batch_window", with_ctes("""
    SELECT file_name, modified_at FROM file_inventory
    WHERE modified_at >= TIMESTAMP '1996-01-01 00:00:00' AND modified_at < TIMESTAMP '1997-01-01 00:00:00'""",
                                 "file_inventory"))
def q_batch_window(spark, sf):
    from vendorlake.operators.routing import batch_window
    return batch_window(A.file_inventory(spark, sf), "1996-01-01", "1997-01-01")


@query("drop_duplicates_in_batch", with_ctes(
    "SELECT file_name, route, decompressed_name, is_duplicate FROM routed_dups", "routed_dups"))
def q_drop_duplicates(spark, sf):
    from vendorlake.operators.routing import mark_duplicates
    return mark_duplicates(_routed(spark, sf)).select("file_name", "route", "decompressed_name",
                                                      "is_duplicate")


def _spec_sql() -> str:
    from vendorlake.model import REGISTRY
    whens = " ".join(f"WHEN '{r.route}' THEN '{r.spec}'" for r in REGISTRY if r.spec)
    return f"CASE route {whens} END"


@query("resolve_spec", with_ctes(f"""
    SELECT file_name, route, spec,
           CASE spec WHEN 'transform-spec-1' THEN 'raw.orders' WHEN 'transform-spec-2' THEN 'raw.customers'
                     WHEN 'transform-spec-3' THEN 'raw.payments' END AS source_table,
           CASE spec WHEN 'transform-spec-1' THEN 'stg_orders' WHEN 'transform-spec-2' THEN 'stg_customers'
                     WHEN 'transform-spec-3' THEN 'stg_payments' END AS staging_model,
           CASE spec WHEN 'transform-spec-1' THEN 'order_id,customer,order_date,amount,status'
                     WHEN 'transform-spec-2' THEN 'customer,segment,region'
                     WHEN 'transform-spec-3' THEN 'payment_id,order_id,paid_amount,paid_date' END
               AS require_columns
    FROM (SELECT file_name, route, {_spec_sql()} AS spec FROM routed WHERE route IS NOT NULL) t""", "routed"))
def q_resolve_spec(spark, sf):
    from pyspark.sql import functions as F
    from vendorlake.operators.routing import resolve_spec
    return resolve_spec(_routed(spark, sf).filter(F.col("route").isNotNull()))


@query("batch_ledger", with_ctes("SELECT * FROM ledger", "ledger"))
def q_batch_ledger(spark, sf):
    from vendorlake.operators.routing import batch_ledger
    return batch_ledger(A.file_inventory(spark, sf))


@query("quarantine", with_ctes("""
    SELECT file, quarantine_key, quarantine_reason FROM ledger WHERE status = 'quarantined'""", "ledger"))
def q_quarantine(spark, sf):
    from vendorlake.operators.routing import batch_ledger, quarantine
    return quarantine(batch_ledger(A.file_inventory(spark, sf)))


@query("ingest_only", with_ctes("""
    SELECT decompressed_name AS file, 'landed' AS status, 'landing/' || decompressed_name AS landed_key, route
    FROM routed WHERE route IS NOT NULL""", "routed"))
def q_ingest_only(spark, sf):
    from vendorlake.operators.routing import ingest_only
    return ingest_only(A.file_inventory(spark, sf))


@query("batch_report", with_ctes("""
    SELECT count(*) AS files_processed,
           count(*) FILTER (WHERE status = 'transformed') AS transformed,
           count(*) FILTER (WHERE status = 'landed') AS landed,
           count(*) FILTER (WHERE status = 'quarantined') AS quarantined
    FROM ledger""", "ledger"))
def q_batch_report(spark, sf):
    from vendorlake.operators.routing import batch_ledger, batch_report
    return batch_report(batch_ledger(A.file_inventory(spark, sf)))


# --------------------------------------------------------------------------
# 2.1 sources over a landing zone written from the tables; 2.11 sinks;
# 2.13 jobs.  A landing zone is written once per session and data dir.
# --------------------------------------------------------------------------
_LANDINGS: dict[tuple[int, str], str] = {}


def landing(spark, sf):
    from vendorlake.sources.landing import write_landing
    key = (id(spark), sf)
    if key not in _LANDINGS:
        _LANDINGS[key] = write_landing(spark, sf)
    return _LANDINGS[key]


@query("discover_files", with_ctes("SELECT drop_name AS file_name, 1 AS parts, true AS holds_bytes FROM landing_drops", "landing_drops"))
def q_discover_files(spark, sf):
    from pyspark.sql import functions as F
    from vendorlake.sources.files import discover_files
    return discover_files(spark, landing(spark, sf)).select("file_name", "parts", (F.col("length") > 0).alias("holds_bytes"))


@query("read_csv_raw", with_ctes("SELECT * FROM landed_orders_csv", "landed_orders_csv"))
def q_read_csv_raw(spark, sf):
    from pyspark.sql import functions as F
    from vendorlake.sources.files import list_parts, read_csv_raw
    parts = list_parts(spark, landing(spark, sf)).filter(F.col("file_name").startswith("orders_"))
    rows, _ = read_csv_raw(spark, parts)
    return rows.drop("_block_start", "_mid")


@query("column_contract", with_ctes(f"""
    SELECT DISTINCT 'orders_1998.csv' AS file_name, {sql_str(_CONTRACT_1998)} AS reason
    FROM raw_orders WHERE substr(order_date, 1, 4) = '1998'""", "raw_orders"))
def q_column_contract(spark, sf):
    """Drops whose header misses a required column (per header signature)."""
    from pyspark.sql import functions as F
    from vendorlake.sources.files import list_parts, read_csv_raw
    parts = list_parts(spark, landing(spark, sf)).filter(F.col("file_name").startswith("orders_"))
    return read_csv_raw(spark, parts, required=canonical_columns("stg_orders"))[1]


@query("gzip_audit", with_ctes("""
    SELECT drop_name AS file_name, CASE WHEN starts_with(drop_name, 'documents_') THEN error END AS gzip_error,
           NOT starts_with(drop_name, 'documents_') AS inflated
    FROM landing_drops JOIN landing_ledger ON file_name = drop_name WHERE drop_name LIKE '%.gz'""", "landing_drops", "landing_ledger"))
def q_gzip_audit(spark, sf):
    from pyspark.sql import functions as F
    from vendorlake.sources.files import list_parts
    from vendorlake.sources.gzip_audit import gzip_audit
    return gzip_audit(list_parts(spark, landing(spark, sf))).select(
        "file_name", "gzip_error", (F.col("decompressed_bytes") > 0).alias("inflated"))


@query("header_profile", with_ctes("""
    SELECT regexp_replace(regexp_replace(lower(trim(raw)), '[^0-9a-zA-Z]+', '_', 'g'), '^_+|_+$', '', 'g')
               AS sanitized, raw, count(*) AS files
    FROM raw_headers GROUP BY 1, 2""", "raw_headers"))
def q_header_profile(spark, sf):
    from vendorlake.sources.files import header_profile
    return header_profile(spark, landing(spark, sf))


def _proposals_sql() -> str:
    """Header proposals in rounds of mutual best pairs; five headers need five at most."""
    from vendorlake.model import ENTITIES
    names = ", ".join(f"('{e.name}', '{c}')" for e in ENTITIES.values() for c in e.column_names)
    grams = "list_distinct(list_transform(range(1, len({0}) + 2), lambda i: substr('  ' || {0} || ' ', i, 3)))"
    rounds = [f"""p0 AS (
      SELECT *, CASE WHEN header = canonical THEN 1000
                     WHEN len(header) >= 2 AND regexp_matches(canonical, '^' || regexp_replace(header, '([0-9a-z])', '\\1[0-9a-z_]*', 'g'))
                     THEN greatest(shared, 600) ELSE shared END AS score
      FROM (SELECT grp, entity, header, canonical, len(list_intersect({grams.format("header")}, {grams.format("canonical")})) * 1000
                   // len(list_distinct(list_concat({grams.format("header")}, {grams.format("canonical")}))) AS shared
            FROM (SELECT DISTINCT drop_name AS grp,
                         regexp_replace(regexp_replace(lower(trim(raw)), '[^0-9a-zA-Z]+', '_', 'g'), '^_+|_+$', '', 'g') AS header FROM raw_headers),
                 (VALUES {names}) n(entity, canonical)) t)"""]
    order = "ORDER BY score DESC, canonical, header"
    for i in range(5):
        rounds.append(f"""b{i} AS (SELECT * FROM p{i} WHERE score >= 200
          QUALIFY row_number() OVER (PARTITION BY grp, entity, header {order}) = 1 AND row_number() OVER (PARTITION BY grp, entity, canonical {order}) = 1)""")
        rounds.append(f"p{i + 1} AS (SELECT * FROM p{i} WHERE (grp, entity, header) NOT IN (SELECT grp, entity, header FROM b{i}) "
                      f"AND (grp, entity, canonical) NOT IN (SELECT grp, entity, canonical FROM b{i}))")
    chosen = " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(5))
    return f"""SELECT * FROM (WITH {", ".join(rounds)}
      SELECT entity, canonical, header, count(*) AS "groups", max(score) AS score FROM ({chosen}) WHERE header <> canonical GROUP BY ALL)"""


@query("alias_proposals", with_ctes(_proposals_sql(), "raw_headers"))
def q_alias_proposals(spark, sf):
    """Aliases worth declaring, from the headers of everything that landed."""
    from pyspark.sql import functions as F
    from vendorlake.functions.names import sanitize_col
    from vendorlake.model import ENTITIES
    from vendorlake.operators.proposals import alias_table, propose
    from vendorlake.sources.files import header_lines, list_parts
    parts = list_parts(spark, landing(spark, sf))
    headers = (header_lines(parts).join(parts.select("path", F.col("file_name").alias("group")), "path")
               .select("group", F.explode(F.from_json("header", "array<string>")).alias("raw"))
               .select("group", sanitize_col(F.col("raw")).alias("header")).distinct())
    wanted = headers.withColumn("entity", F.explode(F.array(*[F.lit(e) for e in ENTITIES])))
    return alias_table(propose(wanted, {e.name: e.column_names for e in ENTITIES.values()}))


@query("run_batch", with_ctes("SELECT * FROM landing_ledger", "landing_ledger"))
def q_run_batch(spark, sf):
    from vendorlake.plans.jobs import run_batch
    return run_batch(spark, landing(spark, sf))["ledger"]


@query("read_any", with_ctes("SELECT * FROM documents"))
def q_read_any(spark, sf):
    from vendorlake.sources.files import read_any
    return read_any(spark, "parquet", f"{sf.rstrip('/')}/documents.parquet")


@query("land_table", with_ctes(
    "SELECT order_id, customer, order_date, amount, status, _source_file FROM raw_orders", "raw_orders"))
def q_land_table(spark, sf):
    from vendorlake.operators.hygiene import land_table
    from vendorlake.session import scratch_path
    return land_table(landed_orders(spark, sf), "raw.orders", path=scratch_path(spark, "raw_orders"))


@query("read_table", with_ctes("SELECT customer, segment, region, _source_file FROM raw_customers",
                               "raw_customers"))
def q_read_table(spark, sf):
    from vendorlake.operators.hygiene import land_table
    from vendorlake.session import scratch_path
    from vendorlake.sources.files import read_table
    land_table(landed_customers(spark, sf), "raw.customers", path=scratch_path(spark, "raw_customers"))
    return read_table(spark, "raw.customers")


@query("capped_result", ORACLE_SQL["daily_revenue"])
def q_capped_result(spark, sf):
    from vendorlake.operators.diff import capped_result
    return capped_result(marts.daily_revenue(staged_orders(spark, sf)))


@query("table_diff", with_ctes("""
    (SELECT order_id, customer, order_date, amount, status, 'only_new' AS side FROM stg_orders
     EXCEPT ALL
     SELECT order_id, customer, order_date, amount, status, 'only_new' FROM legacy_orders)
    UNION ALL
    (SELECT order_id, customer, order_date, amount, status, 'only_old' FROM legacy_orders
     EXCEPT ALL
     SELECT order_id, customer, order_date, amount, status, 'only_old' FROM stg_orders)""",
                               "stg_orders", "legacy_orders"))
def q_table_diff(spark, sf):
    """Parallel run: the staging model against a legacy one that forgot trim."""
    from pyspark.sql import functions as F
    from vendorlake.operators.diff import table_diff
    new = staged_orders(spark, sf)
    legacy = landed_orders(spark, sf).selectExpr(
        "cast(order_id as int) as order_id", "customer", "cast(order_date as date) as order_date",
        "cast(amount as double) as amount", "lower(status) as status")
    return table_diff(new, legacy.select(*[F.col(c) for c in new.columns]))


@query("export_json", with_ctes("""
    SELECT CAST(order_date AS VARCHAR) AS order_date, order_count, total_revenue FROM (
      SELECT order_date, count(*) AS order_count,
             CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) AS total_revenue
      FROM stg_orders WHERE status = 'completed' GROUP BY order_date) t""", "stg_orders"))
def q_export_json(spark, sf):
    from pyspark.sql import functions as F
    from vendorlake.session import scratch_path
    from vendorlake.sources.export import export_json
    path = scratch_path(spark, "daily_revenue_json")
    export_json(marts.daily_revenue(staged_orders(spark, sf)), path)
    doc = spark.read.text(path)
    return doc.select(F.explode(F.from_json("value", "array<struct<order_date:string,"
                                                     "order_count:bigint,total_revenue:double>>")).alias("r")
                      ).select("r.*")


@query("export_parquet", ORACLE_SQL["daily_revenue"])
def q_export_parquet(spark, sf):
    from vendorlake.session import scratch_path
    from vendorlake.sources.export import export_parquet
    path = scratch_path(spark, "daily_revenue_parquet")
    export_parquet(marts.daily_revenue(staged_orders(spark, sf)), path)
    return spark.read.parquet(path)


def _manifest_sql(table: str, fmt: str, view: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT 'analytics.{table}' AS \"table\", '{fmt}' AS format, count(*) AS rows, '{c}' AS \"column\", "
        f"CAST(min({e}) AS VARCHAR) AS least, CAST(max({e}) AS VARCHAR) AS greatest FROM {view}" for c, e in columns.items())


_REVENUE_VIEW = """(SELECT order_date, count(*) AS order_count, CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) AS total_revenue
                    FROM stg_orders WHERE status = 'completed' GROUP BY order_date) t"""


@query("export_manifest", with_ctes(" UNION ALL ".join((
    _manifest_sql("daily_revenue", "json", _REVENUE_VIEW, {
        "order_date": "order_date", "order_count": "order_count", "total_revenue": "CAST(total_revenue AS DECIMAL(28,6))"}),
    _manifest_sql("stg_orders", "parquet", "stg_orders", {
        "order_id": "order_id", "customer": "customer", "order_date": "order_date", "amount": "CAST(amount AS DECIMAL(28,6))", "status": "status"}),
    _manifest_sql("dim_customers", "parquet", "dim_customers", {c: c for c in ("customer", "segment", "region")}))),
    "stg_orders", "dim_customers"))
def q_export_manifest(spark, sf):
    from vendorlake.session import scratch_path
    from vendorlake.sources.export import export, export_manifest
    orders = staged_orders(spark, sf)
    results = [export(df, f"analytics.{name}", scratch_path(spark, name), fmt) for name, df, fmt in (
        ("daily_revenue", marts.daily_revenue(orders), "json"), ("stg_orders", orders, "parquet"),
        ("dim_customers", marts.dim_customers(staged_customers(spark, sf)), "parquet"))]
    return export_manifest(spark, results).select("table", "format", "rows", "column", "least", "greatest")


@query("validate_outputs", with_ctes("""
    SELECT f.format, t.rows, t.rows > 0 AS holds_rows
    FROM (SELECT unnest(['json', 'parquet']) AS format) f, (SELECT count(DISTINCT order_date) AS rows FROM stg_orders WHERE status = 'completed') t
    UNION ALL SELECT 'parquet', 0, false""", "stg_orders"))
def q_validate_outputs(spark, sf):
    """Two outputs with rows, read back, and one without."""
    from pyspark.sql import functions as F
    from vendorlake.session import scratch_path
    from vendorlake.sources.export import export, validate_outputs
    outs = []
    revenue = marts.daily_revenue(staged_orders(spark, sf))
    for fmt, df in (("json", revenue), ("parquet", revenue), ("parquet", revenue.filter("false"))):
        dest = scratch_path(spark, f"daily_revenue_{fmt}")
        export(df, "analytics.daily_revenue", dest, fmt)
        outs.append({"destination": dest, "format": fmt})
    return validate_outputs(spark, outs, strict=False).select("format", "rows", (F.col("rows") > 0).alias("holds_rows"))


@query("table_format", with_ctes("""
    SELECT 'parquet' AS format, customer, segment, region FROM dim_customers""", "dim_customers"))
def q_table_format(spark, sf):
    """A model kept in the format of the catalog (none: parquet), and its rows read back."""
    from pyspark.sql import functions as F
    from vendorlake.operators.hygiene import land_table
    from vendorlake.plans.catalog import table_format
    name = "analytics.dim_customers"
    kept = land_table(marts.dim_customers(staged_customers(spark, sf)), name, fmt=table_format(None))
    fmt = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Provider'").first().data_type
    return kept.select(F.lit(fmt.lower()).alias("format"), "customer", "segment", "region")


# --------------------------------------------------------------------------
# landed tables that join without a shuffle, keys across batches, diffs in detail
# --------------------------------------------------------------------------
@query("landed_paid_left", ORACLE_SQL["join_paid_left"])
def q_landed_paid_left(spark, sf):
    """``join_paid_left`` over two tables bucketed by order: no exchange."""
    from pyspark.sql import functions as F
    from vendorlake.operators.landed_tables import land_bucketed
    orders, payments = (land_bucketed(df, f"landed.{name}_{_fresh()}", ["order_id"], buckets=8) for name, df in (
        ("orders", build_staging(landed_orders(spark, sf), "stg_orders", keep_lineage=True)),
        ("payments", build_staging(landed_payments(spark, sf), "stg_payments", keep_lineage=True))))
    j = marts.orders_with_payments(orders.drop("_source_file"), marts.fct_payments(payments))
    return j.withColumn("paid_amount", F.col("paid_amount").cast("double"))


@query("landed_dedupe", ORACLE_SQL["dedupe_orders"])
def q_landed_dedupe(spark, sf):
    """``dedupe_orders`` over records bucketed by their lifecycle key: no exchange."""
    from vendorlake.operators.landed_tables import dedupe_landed, land_bucketed
    from vendorlake.operators.settlement import LIFECYCLE_KEY
    records = split_records(spark, sf, once=True)
    landed = land_bucketed(records, f"landed.records_{_fresh()}", list(LIFECYCLE_KEY), _buckets(spark, sf), per=None)
    return dedupe_landed(landed).select(*[c.strip() for c in _SPLIT_COLS.split(",")], "is_duplicate")


def _fresh() -> str:
    import uuid
    return uuid.uuid4().hex[:12]


_BATCH_OF_YEAR = "CASE WHEN {y} < '1995' THEN 'b1' WHEN {y} < '1997' THEN 'b2' ELSE 'b3' END"


_BATCH_KEYS = (f"SELECT payment_id, {_BATCH_OF_YEAR.format(y='substr(paid_date, 1, 4)')} AS batch, count(*) AS n "
               "FROM raw_payment_lines GROUP BY ALL")


@query("unique_across_batches", with_ctes(f"""
    SELECT x.payment_id, x.batch, x.n, min(y.batch) AS first_batch
    FROM ({_BATCH_KEYS}) x LEFT JOIN ({_BATCH_KEYS}) y ON x.payment_id = y.payment_id AND y.batch < x.batch
    GROUP BY ALL HAVING min(y.batch) IS NOT NULL OR x.n > 1""", "raw_payment_lines"))
def q_unique_across_batches(spark, sf):
    """Payment ids that fail to be unique, in their batch or against earlier ones."""
    from functools import reduce
    from pyspark.sql import DataFrame, functions as F
    from vendorlake.operators.seen import SeenKeys
    from vendorlake.session import materialize, scratch_path
    lines = materialize(apply_hygiene(A.raw_payment_lines(spark, sf)).withColumn(
        "batch", F.expr(_BATCH_OF_YEAR.format(y="substr(paid_date, 1, 4)"))), "payment_lines")
    seen, found = SeenKeys(spark, scratch_path(spark, "seen-payments"), expected_keys=1 << 20), []
    for batch in ("b1", "b2", "b3"):
        rows = lines.filter(F.col("batch") == batch)
        found.append(materialize(seen.repeated(rows, "payment_id", batch).select(
            F.col("key").alias("payment_id"), F.lit(batch).alias("batch"), "n", "first_batch"), "repeated"))
        seen.add(rows, "payment_id", batch)
    return reduce(DataFrame.unionByName, found)


@query("diff_detail", with_ctes("""
    SELECT n.order_id, 'changed' AS change, 'status' AS "column", o.status AS old_value, n.status AS new_value
    FROM stg_orders n JOIN legacy_orders o ON o.order_id = n.order_id
    WHERE o.status IS DISTINCT FROM n.status AND n.order_id % 7 <> 0 AND n.order_id % 11 <> 0
    UNION ALL SELECT order_id, 'only_new', NULL, NULL, NULL FROM stg_orders WHERE order_id % 7 = 0 AND order_id % 11 <> 0
    UNION ALL SELECT order_id, 'only_old', NULL, NULL, NULL FROM legacy_orders WHERE order_id % 11 = 0 AND order_id % 7 <> 0""",
                              "stg_orders", "legacy_orders"))
def q_diff_detail(spark, sf):
    """The parallel run of ``table_diff`` by key and column; the legacy side also
    lacks every seventh order and the new one every eleventh."""
    from pyspark.sql import functions as F
    from vendorlake.operators.diff import diff_detail
    new = staged_orders(spark, sf)
    legacy = landed_orders(spark, sf).selectExpr(
        "cast(order_id as int) as order_id", "customer", "cast(order_date as date) as order_date",
        "cast(amount as double) as amount", "lower(status) as status")
    return diff_detail(new.filter(F.col("order_id") % 11 != 0), legacy.filter(F.col("order_id") % 7 != 0), ["order_id"], fan=64)


def settlement_batch(spark, sf):
    from vendorlake.plans.jobs import run_settlement_batch
    return run_settlement_batch(spark, landing(spark, sf), A.contracts(spark, sf),
                                A.decisions(spark, sf).drop("batch_id"), multi_line=False)


@query("write_remittance", with_ctes("""
    SELECT nullif(batch_id, '') AS batch_id, nullif(order_ref, '') AS order_ref,
           nullif(vendor, '') AS vendor, CAST(item_count AS VARCHAR) AS item_count,
           CAST(submitted_amount AS VARCHAR) AS submitted_amount,
           CAST(priced_amount AS VARCHAR) AS priced_amount, CAST(variance_pct AS VARCHAR) AS variance_pct,
           outcome, decision_source, CAST(payable_amount AS VARCHAR) AS payable_amount,
           nullif(note, '') AS note
    FROM outcomes""", "outcomes"))
def q_write_remittance(spark, sf):
    """Remittance CSV read back as text (empty strings return as NULL)."""
    from vendorlake.session import scratch_path
    from vendorlake.sources.export import write_remittance
    from vendorlake.operators.settlement import outcome_rows
    path = write_remittance(outcome_rows(settled_records(spark, sf)), scratch_path(spark, "remit"))
    return spark.read.option("header", True).csv(path)


def relanded_settlements(spark, sf):
    """The remittance of all batches, re-landed, staged, tested and summed up."""
    from vendorlake.operators.settlement import outcome_rows
    from vendorlake.plans.jobs import reland_settlements
    from vendorlake.session import scratch_path
    from vendorlake.sources.export import write_remittance
    path = write_remittance(outcome_rows(settled_records(spark, sf)), scratch_path(spark, "remit"), "gzip")
    return reland_settlements(spark, path, gate=False)


@query("settlements_mart", with_ctes(_PRICING_SQL, "stg_settlements"))
def q_settlements_mart(spark, sf):
    """Remittance CSV re-landed through the settlements contract -> staged -> tested -> mart.

    The remittance holds every batch and vendor, blank and repeated refs too, so the
    model's tests of order_ref fail on it: failures are warned of, and the mart is of all rows."""
    import warnings
    from vendorlake.operators.hygiene import ContractError
    res = relanded_settlements(spark, sf)
    if res["mart"] is None:
        raise ContractError(res["error"])
    if res["error"]:
        warnings.warn(f"settlements_mart: {res['error']}")
    return res["mart"]


@query("settlement_batch", with_ctes(_REPORT_SQL.format(settled="settled_landed"), "settled_landed"))
def q_settlement_batch(spark, sf):
    return settlement_batch(spark, sf)["report"]


# --------------------------------------------------------------------------
# 2.13 job composition
# --------------------------------------------------------------------------
@query("run_job", ORACLE_SQL["daily_revenue"])
def q_run_job(spark, sf):
    from vendorlake.plans.jobs import InputSpec, JobSpec, run_job
    spec = JobSpec("daily-revenue",
                   inputs=[InputSpec(A.raw_orders(spark, sf), "raw.orders",
                                     require_columns=tuple(canonical_columns("stg_orders")))],
                   select=("tag:orders",))
    res = run_job(spark, spec)
    if not res["success"]:
        raise RuntimeError(res["error"])
    return res["tables"]["daily_revenue"]


@query("select_tag", with_ctes("SELECT customer, segment, region FROM dim_customers", "dim_customers"))
def q_select_tag(spark, sf):
    from vendorlake.plans.jobs import InputSpec, JobSpec, run_job
    spec = JobSpec("customers", inputs=[InputSpec(
        A.raw_customers(spark, sf), "raw.customers",
        column_aliases=SPECS["transform-spec-2"].column_aliases,
        require_columns=tuple(canonical_columns("stg_customers")))], select=("tag:customers",))
    res = run_job(spark, spec)
    return res["tables"]["dim_customers"]


@query("vars", with_ctes("""
    SELECT order_date, order_count, total_revenue FROM (
      SELECT order_date, count(*) AS order_count,
             CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) AS total_revenue
      FROM stg_orders WHERE status = 'completed' GROUP BY order_date) t
    WHERE order_date >= DATE '1998-01-01' AND order_count >= 2""", "stg_orders"))
def q_vars(spark, sf):
    from vendorlake.plans.jobs import InputSpec, JobSpec, run_job
    spec = JobSpec("daily-revenue-since",
                   inputs=[InputSpec(A.raw_orders(spark, sf), "raw.orders")], select=("tag:orders",),
                   vars={"since": "1998-01-01", "min_orders": 2},
                   sql_models={"recent_revenue": "SELECT * FROM daily_revenue WHERE order_date >= "
                                                 "CAST(:since AS DATE) AND order_count >= :min_orders"})
    return run_job(spark, spec)["tables"]["recent_revenue"]


@query("user_expressions", with_ctes("""
    SELECT CAST(order_id AS INTEGER) AS order_id, upper(trim(customer)) AS customer,
           CAST(order_date AS DATE) AS order_date, round(CAST(amount AS DOUBLE) / 1000, 1) AS amount_k,
           lower(trim(status)) AS status
    FROM raw_orders""", "raw_orders"))
def q_user_expressions(spark, sf):
    from vendorlake.model import Column, Entity, STG_ORDERS
    ent = Entity("stg_orders_k", "raw.orders", (
        STG_ORDERS.columns[0], Column("customer", expr="upper(trim(customer))"), STG_ORDERS.columns[2],
        Column("amount_k", "double", expr="round(cast(amount as double) / 1000, 1)"),
        STG_ORDERS.columns[4]))
    return build_staging(landed_orders(spark, sf), ent)


# --------------------------------------------------------------------------
# 2.10 lineage (lifecycle events)
# --------------------------------------------------------------------------
@query("review_queue", with_ctes("""
    SELECT order_ref, stage, stage_ts FROM (
      SELECT order_ref, stage, max(ts) OVER (PARTITION BY order_ref) AS stage_ts,
             row_number() OVER (PARTITION BY order_ref ORDER BY ts DESC, event_id DESC) AS rn
      FROM lifecycle_events) t
    WHERE rn = 1 AND stage = 'awaiting_review'""", "lifecycle_events"))
def q_review_queue(spark, sf):
    from vendorlake.operators.lineage import review_queue
    return review_queue(A.lifecycle_events(spark, sf))


@query("trace_order", with_ctes("""
    SELECT e.order_ref, e.run_id, e.batch_id, e.stage, e.ts, e.event_id FROM lifecycle_events e
    JOIN (SELECT order_ref, run_id FROM (
            SELECT order_ref, run_id, row_number() OVER (PARTITION BY order_ref
                   ORDER BY min(ts) DESC, run_id DESC) AS rn
            FROM lifecycle_events GROUP BY order_ref, run_id) r WHERE rn = 1) n
      ON e.order_ref = n.order_ref AND e.run_id = n.run_id
    ORDER BY e.order_ref, e.ts, e.event_id""", "lifecycle_events"))
def q_trace_order(spark, sf):
    from vendorlake.operators.lineage import trace_order
    return trace_order(A.lifecycle_events(spark, sf))


@query("lineage_filter", with_ctes("""
    SELECT * FROM lifecycle_events
    WHERE route = 'vendor-orders' AND stage = 'awaiting_review'
      AND starts_with(source_file, 'vendor_orders_2024-01-1')""", "lifecycle_events"))
def q_lineage_filter(spark, sf):
    """Over the stored lifecycle table, so the predicates reach the scan."""
    from vendorlake.operators.lineage import lineage_filter
    from vendorlake.session import materialize
    stored = materialize(A.lifecycle_events(spark, sf), "lifecycle_events")
    return lineage_filter(stored, route="vendor-orders",
                          source_file_prefix="vendor_orders_2024-01-1", stage="awaiting_review")


# --------------------------------------------------------------------------
# 2.12 streaming
# --------------------------------------------------------------------------
@query("stream_ingest", with_ctes("SELECT * FROM landing_ledger", "landing_ledger"))
def q_stream_ingest(spark, sf):
    """The ledgers of all micro-batches (the batch ledger, built incrementally)."""
    from vendorlake.streaming.ingest import stream_ingest
    q, ledger = stream_ingest(spark, landing(spark, sf))
    q.awaitTermination()
    return spark.read.parquet(ledger).drop("batch_id")


#: Reviews of the events table: the SLA, how late an event may come, and how far
#: apart the events of one order (of a day) may lie.
EVENT_SLA, EVENT_LATENESS, EVENT_RETENTION = 6 * 3600, 3600, 86_400


def _ended(stream, name: str, spark):
    """Run a stream over what its source holds; its rows."""
    from vendorlake.session import scratch_path
    from vendorlake.streaming.order_status import start
    out = scratch_path(spark, name)
    start(stream, out, scratch_path(spark, f"{name}-checkpoint")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_order_status", with_ctes(f"""
    SELECT batch_id, vendor, order_ref,
           CASE WHEN verb IS NULL THEN 'escalated' WHEN verb = 'approve' THEN 'settled' ELSE 'denied' END AS outcome,
           CASE WHEN verb IS NULL THEN 'sla_timeout' ELSE 'reviewer' END AS decision_source,
           CASE WHEN verb IS NULL THEN 'no decision within {EVENT_SLA}s' ELSE note END AS note,
           coalesce(decided, opened + INTERVAL {EVENT_SLA} SECOND) AS resolved_at
    FROM (SELECT o.batch_id, o.vendor, o.order_ref, o.opened, d.decision AS verb, d.ts AS decided, d.note
          FROM (SELECT batch_id, vendor, order_ref, min(ts) AS opened FROM review_signals WHERE opened GROUP BY ALL) o
          LEFT JOIN review_signals d
            ON d.batch_id = o.batch_id AND d.vendor = o.vendor AND d.order_ref = o.order_ref
               AND d.decision IN ('approve', 'deny') AND d.ts <= o.opened + INTERVAL {EVENT_SLA} SECOND
          QUALIFY row_number() OVER (PARTITION BY o.batch_id, o.vendor, o.order_ref ORDER BY d.ts, d.decision_id) = 1) t
    WHERE greatest(opened, coalesce(decided, opened + INTERVAL {EVENT_SLA} SECOND))
          <= (SELECT max(ts) - INTERVAL {EVENT_LATENESS} SECOND FROM review_signals)""", "review_signals"))
def q_stream_order_status(spark, sf):
    """Resolutions that the watermark has made final, from the events table as a stream."""
    from vendorlake.streaming.order_status import order_status
    signals = A.review_signals(A.events_stream(spark, sf))
    return _ended(order_status(signals, EVENT_SLA, lateness=f"{EVENT_LATENESS} seconds", retention_seconds=EVENT_RETENTION),
                  "order-status", spark)


_REVIEWS_SQL = f"""
    SELECT vendor, order_ref, review_id, opened_at,
           CASE WHEN verb IS NULL THEN 'escalated' WHEN verb = 'approve' THEN 'settled' ELSE 'denied' END AS outcome,
           CASE WHEN verb IS NULL THEN 'sla_timeout' ELSE 'reviewer' END AS decision_source, decision_id,
           CASE WHEN verb IS NULL THEN 'no decision within {EVENT_SLA}s' ELSE note END AS note,
           CASE WHEN verb IS NULL THEN opened_at + INTERVAL {EVENT_SLA} SECOND ELSE greatest(decided, opened_at) END AS resolved_at
    FROM (SELECT o.vendor, o.order_ref, o.decision_id AS review_id, o.ts AS opened_at, d.decision AS verb, d.ts AS decided, d.note, d.decision_id
          FROM review_signals o LEFT JOIN review_signals d
            ON d.vendor = o.vendor AND d.order_ref = o.order_ref AND d.decision IN ('approve', 'deny')
               AND d.ts BETWEEN o.ts - INTERVAL {EVENT_LATENESS} SECOND AND o.ts + INTERVAL {EVENT_SLA} SECOND
          WHERE o.opened QUALIFY row_number() OVER (PARTITION BY o.decision_id ORDER BY d.ts, d.decision_id) = 1) t"""


@query("review_decisions", with_ctes(_REVIEWS_SQL, "review_signals"))
def q_review_decisions(spark, sf):
    """The first decision of every review, by an interval join of the events table."""
    from vendorlake.streaming.decisions import first_decisions
    events = A.read_events(spark, sf)
    return first_decisions(A.review_openings(events), A.review_decisions(events), EVENT_SLA, EVENT_LATENESS)


@query("stream_review_decisions", with_ctes(_REVIEWS_SQL + f"""
    WHERE opened_at + INTERVAL {EVENT_SLA} SECOND <= (
      SELECT least(max(ts) FILTER (WHERE opened), max(ts) FILTER (WHERE decision IN ('approve', 'deny'))) - INTERVAL {EVENT_LATENESS} SECOND
      FROM review_signals)""", "review_signals"))
def q_stream_review_decisions(spark, sf):
    """The same as two streams: the reviews that both watermarks have closed."""
    from vendorlake.streaming.decisions import first_decisions
    opened, decided = A.review_openings(A.events_stream(spark, sf)), A.review_decisions(A.events_stream(spark, sf))
    return _ended(first_decisions(opened, decided, EVENT_SLA, EVENT_LATENESS, lateness=f"{EVENT_LATENESS} seconds"),
                  "review-decisions", spark)


@query("settlement_lifecycle", with_ctes("""
    SELECT batch_id, order_ref, vendor, _source_file,
           generate_subscripts(stages, 1) - 1 AS seq, unnest(stages) AS stage
    FROM (SELECT batch_id, order_ref, vendor, _source_file,
                 CASE WHEN outcome = 'duplicate' THEN ['received']
                      WHEN decision_source = 'validation' THEN ['received', 'denied']
                      WHEN outcome = 'errored' THEN ['received', 'validated']
                      WHEN decision_source = 'auto' THEN ['received', 'validated', 'enriched', 'priced', 'settled']
                      ELSE ['received', 'validated', 'enriched', 'priced', 'awaiting_review', outcome] END AS stages
          FROM settled) t""", "settled"))
def q_settlement_lifecycle(spark, sf):
    """Stage transitions of every settled record (the lineage table's source)."""
    from vendorlake.operators.lineage import settlement_lifecycle
    return settlement_lifecycle(settled_records(spark, sf))
