"""DuckDB oracle SQL for every registered query.

Each query's SQL is ``WITH <the CTEs it needs> <body>``.  The adapter CTEs
come from ``sources.adapters.ADAPTER_SQL``; the model CTEs below restate the
staging projections and marts by hand.  Routing, too, is written in DuckDB's own
globs, next to the registry's patterns it has to agree with.
"""
from __future__ import annotations

from vendorlake.sources.adapters import ADAPTER_SQL

# name -> (dependencies, SELECT)
CTES: dict[str, tuple[tuple[str, ...], str]] = dict(ADAPTER_SQL)

CTES.update({
    "stg_orders": (("raw_orders",), """
        SELECT CAST(order_id AS INTEGER) AS order_id, customer,
               CAST(order_date AS DATE) AS order_date, CAST(amount AS DOUBLE) AS amount,
               lower(trim(status)) AS status, _source_file
        FROM raw_orders"""),
    "stg_customers": (("raw_customers",), """
        SELECT customer, lower(trim(segment)) AS segment, lower(trim(region)) AS region, _source_file
        FROM raw_customers"""),
    "stg_payments": (("raw_payments",), """
        SELECT CAST(payment_id AS INTEGER) AS payment_id, CAST(order_id AS INTEGER) AS order_id,
               CAST(paid_amount AS DOUBLE) AS paid_amount, CAST(paid_date AS DATE) AS paid_date,
               _source_file
        FROM raw_payments"""),
    "stg_payment_lines": (("raw_payment_lines",), """
        SELECT CAST(payment_id AS INTEGER) AS payment_id, CAST(order_id AS INTEGER) AS order_id,
               CAST(paid_amount AS DOUBLE) AS paid_amount, CAST(paid_date AS DATE) AS paid_date,
               _source_file
        FROM raw_payment_lines"""),
    "legacy_orders": (("raw_orders",), """
        SELECT CAST(order_id AS INTEGER) AS order_id, customer, CAST(order_date AS DATE) AS order_date,
               CAST(amount AS DOUBLE) AS amount, lower(status) AS status
        FROM raw_orders"""),
    "dim_customers": (("stg_customers",), "SELECT customer, segment, region FROM stg_customers"),
    "fct_payments": (("stg_payments",),
                     "SELECT payment_id, order_id, paid_amount, paid_date FROM stg_payments"),
    "paid": (("fct_payments",), """
        SELECT order_id, CAST(sum(CAST(paid_amount AS DECIMAL(28,6))) AS DOUBLE) AS paid_amount
        FROM fct_payments GROUP BY order_id"""),
})


def _collect(names, out: list[str]) -> None:
    for n in names:
        if n in out:
            continue
        deps, _ = CTES[n]
        _collect(deps, out)
        if n not in out:
            out.append(n)


def with_ctes(body: str, *names: str) -> str:
    order: list[str] = []
    _collect(names, order)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({CTES[n][1].strip()})" for n in order)
    return f"WITH {ctes}\n{body.strip()}"


def register(name: str, deps: tuple[str, ...], select: str) -> None:
    CTES[name] = (deps, select)


# ---------------------------------------------------------------------------
# settlement CTEs
# ---------------------------------------------------------------------------
_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_FLOAT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _repr(x: str) -> str:
    return f"""CASE WHEN strpos({x}, '''') > 0 THEN '"' || {x} || '"' ELSE '''' || {x} || '''' END"""


CTES.update({
    "split0": (("raw_vendor_orders",), f"""
        SELECT *, {_STRIP.format(x="coalesce(item_count, '')")} AS _ir,
                  {_STRIP.format(x="coalesce(submitted_amount, '')")} AS _sr
        FROM raw_vendor_orders"""),
    "split1": (("split0",), f"""
        SELECT batch_id, _source_file, CAST(_line AS BIGINT) AS _line,
               {_STRIP.format(x="coalesce(CASE WHEN order_ref <> '' THEN order_ref END, 'line-' || CAST(_line AS VARCHAR))")} AS order_ref,
               lower({_STRIP.format(x="coalesce(CASE WHEN vendor <> '' THEN vendor END, 'unknown')")}) AS vendor,
               CASE WHEN regexp_matches(_ir, '^[+-]?[0-9]+$') THEN TRY_CAST(_ir AS INTEGER) END AS item_count,
               CASE WHEN regexp_matches(_sr, '{_FLOAT}') THEN TRY_CAST(_sr AS DECIMAL(20,6)) END AS _submitted,
               _ir, _sr
        FROM split0"""),
    "split": (("split1",), f"""
        SELECT batch_id, _source_file, _line, order_ref, vendor, item_count, _submitted,
               coalesce(CASE WHEN _submitted IS NULL THEN 'bad submitted_amount: ' || {_repr('_sr')} END,
                        CASE WHEN item_count IS NULL THEN 'bad item_count: ' || {_repr('_ir')} END) AS parse_error
        FROM split1"""),
    "deduped": (("split",), """
        SELECT *, row_number() OVER (PARTITION BY batch_id, vendor, order_ref
                                     ORDER BY _source_file, _line) > 1 AS is_duplicate
        FROM split"""),
    "validated": (("deduped",), """
        SELECT *, CASE WHEN parse_error IS NOT NULL OR item_count IS NULL OR item_count <= 0
                            OR _submitted IS NULL OR _submitted <= 0
                       THEN coalesce(parse_error, 'missing or non-positive fields') END AS validation_note
        FROM deduped"""),
    "contracted": (("validated", "contracts"), """
        SELECT v.*, CAST(c.unit_rate AS DECIMAL(10,4)) AS unit_rate,
               CAST(c.discount_pct AS DECIMAL(8,4)) AS discount_pct,
               c.vendor IS NOT NULL AS _has_contract
        FROM validated v LEFT JOIN contracts c ON v.vendor = c.vendor"""),
    "priced0": (("contracted",), """
        SELECT *, round(CAST(item_count AS DECIMAL(10,0)) * unit_rate * (100 - discount_pct)
                        * CAST(0.01 AS DECIMAL(3,2)), 2) AS _priced
        FROM contracted"""),
    "priced": (("priced0",), """
        SELECT *, round((_submitted - _priced) * 100 / nullif(_priced, 0), 2) AS _variance
        FROM priced0"""),
    "first_decision": (("decisions",), """
        SELECT batch_id, vendor, order_ref, decision, note AS decision_note, delay_s AS decision_delay_s, decision_id
        FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, vendor, order_ref
                                           ORDER BY delay_s, decision_id) AS rn
              FROM decisions WHERE decision IN ('approve', 'deny') AND delay_s <= 300) t
        WHERE rn = 1"""),
    "settled0": (("priced", "first_decision"), """
        SELECT p.*, NOT is_duplicate AND validation_note IS NULL AND _has_contract AND _variance IS NOT NULL
                    AND abs(_variance) > 10 AS _review,
               d.decision, d.decision_note, d.decision_delay_s, d.decision_id
        FROM priced p LEFT JOIN first_decision d
          ON p.batch_id = d.batch_id AND p.vendor = d.vendor AND p.order_ref = d.order_ref"""),
    "settled1": (("settled0",), """
        SELECT *, CASE WHEN is_duplicate THEN 'duplicate'
                       WHEN validation_note IS NOT NULL THEN 'denied'
                       WHEN NOT _has_contract OR _variance IS NULL THEN 'errored'
                       WHEN NOT _review THEN 'settled'
                       WHEN decision IS NOT NULL THEN CASE WHEN decision = 'approve' THEN 'settled' ELSE 'denied' END
                       ELSE 'escalated' END AS outcome
        FROM settled0"""),
    "settled2": (("settled1",), """
        SELECT *, CASE WHEN outcome IN ('duplicate', 'errored') THEN NULL
                       WHEN validation_note IS NOT NULL THEN 'validation'
                       WHEN NOT _review THEN 'auto'
                       WHEN decision IS NOT NULL THEN 'reviewer'
                       ELSE 'sla_timeout' END AS decision_source
        FROM settled1"""),
    "settled": (("settled2",), """
        SELECT *, CAST(CASE WHEN outcome = 'settled' THEN _priced ELSE 0 END AS DOUBLE) AS payable_amount,
               CASE WHEN decision_source = 'validation' THEN validation_note
                    WHEN decision_source = 'reviewer' THEN coalesce(decision_note, '')
                    WHEN decision_source = 'sla_timeout' THEN 'no decision within 300s'
                    ELSE '' END AS note,
               coalesce(CAST(_submitted AS DOUBLE), 0.0) AS submitted_amount,
               CASE WHEN validation_note IS NULL AND _has_contract THEN CAST(_priced AS DOUBLE) END AS priced_amount,
               CASE WHEN validation_note IS NULL AND _has_contract THEN CAST(_variance AS DOUBLE) END AS variance_pct
        FROM settled2"""),
    "outcomes": (("settled",), """
        SELECT batch_id, order_ref, vendor, coalesce(item_count, 0) AS item_count, submitted_amount,
               coalesce(priced_amount, 0.0) AS priced_amount, coalesce(variance_pct, 0.0) AS variance_pct,
               outcome, decision_source, payable_amount, note
        FROM settled WHERE outcome IN ('settled', 'denied', 'escalated')"""),
    "stg_settlements": (("outcomes",), """
        SELECT batch_id, order_ref, vendor, CAST(item_count AS INTEGER) AS item_count,
               CAST(submitted_amount AS DOUBLE) AS submitted_amount,
               CAST(priced_amount AS DOUBLE) AS priced_amount, CAST(variance_pct AS DOUBLE) AS variance_pct,
               lower(trim(outcome)) AS outcome, decision_source,
               CAST(payable_amount AS DOUBLE) AS payable_amount, note
        FROM outcomes"""),
})


# ---------------------------------------------------------------------------
# file routing CTEs (over the derived file inventory)
# ---------------------------------------------------------------------------
def _route_sql(col: str) -> str:
    return f"""CASE WHEN {col} GLOB 'orders_*.csv' THEN 'orders' WHEN {col} GLOB 'customers_*.csv' THEN 'customers'
                    WHEN {col} GLOB 'payments_*.csv' THEN 'payments'
                    WHEN {col} GLOB 'vendor_orders_*.csv' THEN 'vendor-orders' END"""


CTES.update({
    "routed": (("file_inventory",), f"""
        SELECT file_name, modified_at, regexp_replace(file_name, '\\.gz$', '') AS decompressed_name,
               {_route_sql("regexp_replace(file_name, '\\.gz$', '')")} AS route
        FROM file_inventory"""),
    "routed_dups": (("routed",), """
        SELECT *, CASE WHEN route IS NULL THEN false ELSE
                  row_number() OVER (PARTITION BY route, decompressed_name ORDER BY file_name) > 1 END
                  AS is_duplicate
        FROM routed"""),
    "ledger": (("routed_dups",), """
        SELECT decompressed_name AS file,
               CASE WHEN route IS NULL THEN 'quarantined' WHEN is_duplicate THEN 'duplicate'
                    WHEN route = 'vendor-orders' THEN 'landed' ELSE 'transformed' END AS status,
               route,
               CASE WHEN route IS NOT NULL AND NOT is_duplicate THEN 'landing/' || decompressed_name END
                   AS landed_key,
               CASE WHEN route IS NULL THEN 'quarantine/' || decompressed_name END AS quarantine_key,
               CASE WHEN route IS NULL THEN 'no route pattern matched'
                    WHEN is_duplicate THEN 'a transform for this route+filename is already running' END AS error,
               CASE WHEN route IS NULL THEN 'no route pattern matched' END AS quarantine_reason,
               file_name
        FROM routed_dups"""),
})


# ---------------------------------------------------------------------------
# the landing zone written by sources.landing (drop names follow its rules)
# ---------------------------------------------------------------------------
_CONTRACT_1998 = ("orders_1998.csv lacks required columns ['amount']; "
                  "its columns are ['order_id', 'customer', 'order_date', 'status']")
_GZIP_ERR = "not valid gzip (Error -3 while decompressing data: incorrect header check)"


def sql_str(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


CTES.update({
    "landed_orders_csv": (("raw_orders",), """
        SELECT order_id, customer, order_date,
               CASE WHEN substr(order_date, 1, 4) = '1998' THEN NULL ELSE amount END AS amount,
               status, 'orders_' || substr(order_date, 1, 4) || '.csv' AS _source_file
        FROM raw_orders"""),
    "landing_drops": (("raw_orders", "raw_payments", "raw_vendor_orders"), """
        SELECT DISTINCT 'orders_' || substr(order_date, 1, 4) || '.csv' AS drop_name FROM raw_orders
        UNION ALL
        SELECT DISTINCT 'customers_' || lower(regexp_replace(r.r_name, '[^A-Za-z]', '', 'g')) || '.csv'
        FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN region r ON n.n_regionkey = r.r_regionkey
        UNION ALL
        SELECT DISTINCT 'payments_' || substr(paid_date, 1, 4) || '.csv.gz' FROM raw_payments
        UNION ALL
        SELECT DISTINCT 'vendor_orders_' || substr(batch_id, 7, 4) || '.csv' FROM raw_vendor_orders
        UNION ALL
        SELECT DISTINCT 'zz_pages.csv' FROM pages
        UNION ALL
        SELECT DISTINCT 'documents_' || lang || '.csv.gz' FROM documents"""),
    "raw_headers": (("landing_drops",), """
        SELECT drop_name, unnest(CASE
            WHEN drop_name = 'orders_1997.csv' THEN ['Customer', 'Order ID', 'Status', 'Amount', 'Order Date']
            WHEN drop_name = 'orders_1998.csv' THEN ['Order ID', 'Customer', 'Order Date', 'Status']
            WHEN starts_with(drop_name, 'orders_') THEN ['Order ID', 'Customer', 'Order Date', 'Amount', 'Status']
            WHEN starts_with(drop_name, 'customers_') THEN ['Cust', 'Seg', 'RGN']
            WHEN starts_with(drop_name, 'payments_') THEN ['Payment ID', 'Order ID', 'Paid Amount', 'Paid Date']
            WHEN starts_with(drop_name, 'vendor_orders_') THEN
                 ['order_ref', 'vendor', 'item_count', 'submitted_amount', 'batch_id']
            WHEN drop_name = 'zz_pages.csv' THEN ['page_id', 'url', 'html']
            WHEN starts_with(drop_name, 'documents_') THEN ['doc_id', 'lang', 'n_chars', 'text']
            ELSE [] END) AS raw
        FROM landing_drops"""),
    "landing_ledger": (("landing_drops",), f"""
        SELECT file, status, route,
               CASE WHEN status IN ('landed', 'transformed') THEN 'landing/' || file END AS landed_key,
               CASE WHEN status = 'quarantined' THEN 'quarantine/' || drop_name END AS quarantine_key,
               error, CASE WHEN status = 'quarantined' THEN error END AS quarantine_reason, drop_name AS file_name
        FROM (
          SELECT drop_name,
                 CASE WHEN starts_with(drop_name, 'documents_') THEN drop_name
                      ELSE regexp_replace(drop_name, '\\.gz$', '') END AS file,
                 CASE WHEN starts_with(drop_name, 'documents_') OR drop_name = 'zz_pages.csv'
                           OR drop_name = 'orders_1998.csv' THEN 'quarantined'
                      WHEN starts_with(drop_name, 'vendor_orders_') THEN 'landed'
                      ELSE 'transformed' END AS status,
                 CASE WHEN starts_with(drop_name, 'orders_') THEN 'orders'
                      WHEN starts_with(drop_name, 'customers_') THEN 'customers'
                      WHEN starts_with(drop_name, 'payments_') THEN 'payments'
                      WHEN starts_with(drop_name, 'vendor_orders_') THEN 'vendor-orders' END AS route,
                 CASE WHEN starts_with(drop_name, 'documents_') THEN drop_name || ': {_GZIP_ERR}'
                      WHEN drop_name = 'zz_pages.csv' THEN 'no route pattern matched'
                      WHEN drop_name = 'orders_1998.csv' THEN {sql_str(_CONTRACT_1998)} END AS error
          FROM landing_drops) t"""),
})


# ---------------------------------------------------------------------------
# settlement over the landed vendor files: the same chain, another input
# ---------------------------------------------------------------------------
SETTLEMENT_CHAIN = ("first_decision", "split0", "split1", "split", "deduped", "validated", "contracted",
                    "priced0", "priced", "settled0", "settled1", "settled2", "settled")


def clone_chain(suffix: str, bases: dict[str, str]) -> None:
    """Copy the settlement CTEs with table references (after FROM / JOIN)
    renamed, so the same statements run over another input."""
    import re
    names = {n: n + suffix for n in SETTLEMENT_CHAIN}
    names.update(bases)
    pattern = re.compile(r"\b(FROM|JOIN)(\s+)(" + "|".join(map(re.escape, names)) + r")\b")
    for n in SETTLEMENT_CHAIN:
        deps, sql = CTES[n]
        CTES[n + suffix] = (tuple(names.get(d, d) for d in deps),
                            pattern.sub(lambda m: m.group(1) + m.group(2) + names[m.group(3)], sql))


CTES["raw_vendor_landing"] = (("raw_vendor_orders",), """
    SELECT order_ref, vendor, item_count, submitted_amount, 'batch' AS batch_id, _source_file,
           row_number() OVER (PARTITION BY _source_file ORDER BY order_ref NULLS FIRST, vendor NULLS FIRST,
                              item_count NULLS FIRST, submitted_amount NULLS FIRST, batch_id NULLS FIRST) + 1
               AS _line
    FROM (SELECT order_ref, vendor, item_count, submitted_amount, batch_id,
                 'vendor_orders_' || substr(batch_id, 7, 4) || '.csv' AS _source_file
          FROM raw_vendor_orders) t""")
CTES["decisions_landed"] = (("decisions",), "SELECT * REPLACE ('batch' AS batch_id) FROM decisions")
clone_chain("_landed", {"raw_vendor_orders": "raw_vendor_landing", "decisions": "decisions_landed"})
