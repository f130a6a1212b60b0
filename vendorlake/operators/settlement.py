"""Order pricing and settlement as set-based Spark jobs.

The reference runs one lifecycle per order (validate -> contract lookup ->
price -> variance gate -> review or SLA -> outcome).  Here every step is a
column expression or an equi-join over *all* records of all batches at once:

* ``split_orders``      parse vendor rows, never drop one, keep parse errors
* ``dedupe_orders``     first (file, line) per (batch, vendor, order_ref) wins
* ``validate_orders``   deny bad / non-positive records
* ``lookup_contracts``  left join to contracts; a miss is ``errored``
* ``price_orders``      exact decimal pricing and variance
* ``first_decisions``   first valid reviewer decision within the SLA
* ``settle``            all of the above -> one status row per record
* ``outcome_rows``      the 11 remittance columns
* ``settlement_report`` counts per batch

Skew: duplicates and first decisions are found with ``groupBy().agg(min)``
(map-side partial aggregation) and a many-to-one equi-join, never with a
window over a possibly hot key.  Only the count of a key's hash has no partial
aggregate: nearly all keys differ, and a hot one is a run of equal numbers.
"""
from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendorlake.functions.money import AMOUNT_IN, RATE
from vendorlake.model import (
    REMIT_COLUMNS,
    REVIEW_SLA_SECONDS,
    SLA_ACTION,
    VALID_DECISIONS,
    VARIANCE_THRESHOLD_PCT,
)

INT_TEXT = r"^[+-]?[0-9]+$"
FLOAT_TEXT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
FIELDS = ("order_ref", "vendor", "item_count", "submitted_amount")
#: What identifies an order's lifecycle: twins and decisions go by all three.
LIFECYCLE_KEY = ("batch_id", "vendor", "order_ref")


WHITESPACE = " \t\n\r\x0b\x0c"


def _strip(c: Column) -> Column:
    """Python's str.strip() for ASCII whitespace, as plain string code."""
    return F.btrim(c, F.lit(WHITESPACE))


def _repr(c: Column) -> Column:
    """Python-style repr of a short string (single quotes unless it has one)."""
    return (F.when(F.instr(c, "'") > 0, F.concat(F.lit('"'), c, F.lit('"')))
            .otherwise(F.concat(F.lit("'"), c, F.lit("'"))))


def record_numbers(df: DataFrame, group: str = "_source_file") -> DataFrame:
    """Add ``_line`` (CSV record number, header = 1) to a file-source frame.

    Needs ``group`` (the file), ``_block_start`` (file split offset) and
    ``_mid`` (``monotonically_increasing_id`` taken at the scan), as produced
    by ``sources.files.read_csv_raw``.  Rows of one split are contiguous in one
    partition, so a record's number is the count of rows in earlier splits of
    its file plus its position in its split.  Only the per-split counts (a
    small table: one row per file split, written, so that its real size lets it be
    broadcast and the rows stay where they are) are windowed, so a huge file is
    numbered by many tasks.  Any frame range-sorted by (group, order) with
    ``_block_start = spark_partition_id()`` and ``_mid`` taken after the sort
    is numbered the same way.
    """
    blocks = (df.groupBy(group, "_block_start")
              .agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first")))
    w = (Window.partitionBy(group).orderBy("_block_start")
         .rowsBetween(Window.unboundedPreceding, -1))
    from vendorlake.session import materialize
    offs = materialize(blocks.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))), "file_splits")
    return (df.join(offs, [group, "_block_start"])
            .withColumn("_line", F.col("_before") + F.col("_mid") - F.col("_first") + 2)
            .drop("_n", "_first", "_before"))


def split_orders(raw: DataFrame, batch_id: str | None = None) -> DataFrame:
    """Vendor rows -> order records (never dropped; bad numbers -> parse_error).

    ``raw``: string columns order_ref, vendor, item_count, submitted_amount
    (any may be missing), ``_source_file`` and ``_line`` (or the scan columns
    ``record_numbers`` needs).  ``batch_id`` is the caller's, for every record,
    whatever a vendor file says in a column of that name; only without it (rows
    of several batches already told apart) is the column ``batch_id`` used.
    """
    for f in FIELDS:
        if f not in raw.columns:
            raw = raw.withColumn(f, F.lit(None).cast("string"))
    if "_line" not in raw.columns:
        raw = record_numbers(raw)
    if batch_id is not None:
        raw = raw.withColumn("batch_id", F.lit(batch_id))
    items_raw = _strip(F.coalesce(F.col("item_count"), F.lit("")))
    sub_raw = _strip(F.coalesce(F.col("submitted_amount"), F.lit("")))
    items = F.when(items_raw.rlike(INT_TEXT), items_raw.try_cast("int"))
    sub = F.when(sub_raw.rlike(FLOAT_TEXT), sub_raw.try_cast(AMOUNT_IN))
    item_err = F.when(items.isNull(), F.concat(F.lit("bad item_count: "), _repr(items_raw)))
    sub_err = F.when(sub.isNull(), F.concat(F.lit("bad submitted_amount: "), _repr(sub_raw)))
    line = F.col("_line").cast("bigint")
    return raw.select(
        "batch_id", "_source_file", line.alias("_line"),
        _strip(F.coalesce(F.when(F.col("order_ref") != "", F.col("order_ref")),
                          F.concat(F.lit("line-"), line.cast("string")))).alias("order_ref"),
        F.lower(_strip(F.coalesce(F.when(F.col("vendor") != "", F.col("vendor")),
                                  F.lit("unknown")))).alias("vendor"),
        items.alias("item_count"),
        sub.alias("_submitted"),
        F.coalesce(sub_err, item_err).alias("parse_error"),
    )


def dedupe_orders(records: DataFrame) -> DataFrame:
    """Mark twins: the lifecycle id is vendor + order_ref + batch; the first
    record (by file, then line) runs, the others are ``duplicate``.

    Keys are counted by their 64-bit hash, so that only numbers are shuffled.  Equal
    keys have equal hashes: what is counted once has no twin, and only the records of
    the other hashes are grouped by their keys, exactly, for their first (file, line).
    Both lists are written, so that their real sizes decide on the joins: normally
    few, they are broadcast and the records stay where they are; when many, the
    same plan runs as a sort-merge join with AQE's skew splitting.
    """
    from vendorlake.session import materialize, tasks_for
    spark, key = records.sparkSession, F.xxhash64(*LIFECYCLE_KEY)
    again = materialize(
        records.select(key.alias("_key")).repartition(tasks_for(spark, records.count()), "_key")
        .groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("_key"), "keys_seen_again")
    twins = records.join(again, key == F.col("_key"), "left_semi").groupBy(*LIFECYCLE_KEY).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("_source_file", "_line")).alias("_first"))
    first = materialize(twins.filter(F.col("_n") > 1).select(*[F.col(c).alias(f"_{c}") for c in LIFECYCLE_KEY], "_first"), "twins")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in LIFECYCLE_KEY))
    return (records.join(first, same, "left").drop(*[f"_{c}" for c in LIFECYCLE_KEY])
            .withColumn("is_duplicate", F.coalesce(
                (F.col("_first._source_file") != F.col("_source_file"))
                | (F.col("_first._line") != F.col("_line")), F.lit(False)))
            .drop("_first"))


def validation_note(records: DataFrame) -> Column:
    bad = (F.col("parse_error").isNotNull()
           | F.col("item_count").isNull() | (F.col("item_count") <= 0)
           | F.col("_submitted").isNull() | (F.col("_submitted") <= 0))
    return F.when(bad, F.coalesce(F.col("parse_error"), F.lit("missing or non-positive fields")))


def validate_orders(records: DataFrame) -> DataFrame:
    return records.withColumn("validation_note", validation_note(records))


def lookup_contracts(records: DataFrame, contracts: DataFrame) -> DataFrame:
    """Left equi-join on vendor; contracts is one row per vendor.  A rate or
    discount out of range leaves its orders without a price: errored, not lost."""
    c = contracts.select("vendor", F.col("unit_rate").try_cast(RATE).alias("unit_rate"),
                         F.col("discount_pct").try_cast("decimal(8,4)").alias("discount_pct"),
                         F.lit(True).alias("_has_contract"))
    return records.join(c, "vendor", "left")


def price_columns() -> tuple[Column, Column]:
    """priced = round(count * rate * (1 - disc/100), 2);
    variance_pct = round((submitted - priced) / priced * 100, 2); exact decimals."""
    priced = F.round(F.col("item_count").cast("decimal(10,0)") * F.col("unit_rate")
                     * (F.lit(100) - F.col("discount_pct")) * F.lit(0.01).cast("decimal(3,2)"), 2)
    # Narrow operand types keep ~18 decimals in the quotient (a wide numerator
    # would make Spark cut the scale to 6 and round twice).
    gap = (F.col("_submitted").try_cast("decimal(22,6)") - F.col("_priced").try_cast("decimal(18,2)")) * F.lit(100)
    exact = F.try_divide(gap.try_cast("decimal(24,6)"), F.col("_priced").try_cast("decimal(18,2)"))
    plain = F.try_divide((F.col("_submitted").cast("double") - F.col("_priced").cast("double")) * 100,
                         F.col("_priced").cast("double"))
    variance = F.round(F.coalesce(exact.cast("double"), plain).try_cast("decimal(38,8)"), 2)
    return priced, variance


def price_orders(records: DataFrame) -> DataFrame:
    priced, variance = price_columns()
    return records.withColumn("_priced", priced).withColumn("_variance", variance)


def first_decisions(decisions: DataFrame, sla_seconds: float = REVIEW_SLA_SECONDS) -> DataFrame:
    """First valid decision per lifecycle (batch, vendor, order_ref) that arrived
    within the SLA (a tie with the timer goes to the decision).  Invalid verbs
    are ignored."""
    valid = decisions.filter(F.col("decision").isin(*VALID_DECISIONS)
                             & (F.col("delay_s") <= F.lit(sla_seconds)))
    return (valid.groupBy(*LIFECYCLE_KEY)
            .agg(F.min(F.struct("delay_s", "decision_id", "decision", "note")).alias("_d"))
            .select(*LIFECYCLE_KEY, F.col("_d.decision").alias("decision"),
                    F.col("_d.note").alias("decision_note"),
                    F.col("_d.delay_s").alias("decision_delay_s"),
                    F.col("_d.decision_id").alias("decision_id")))


def settle(raw_records: DataFrame, contracts: DataFrame, decisions: DataFrame,
           variance_threshold_pct: float = VARIANCE_THRESHOLD_PCT,
           review_sla_seconds: int = REVIEW_SLA_SECONDS,
           sla_action: str = SLA_ACTION, materialize: bool = False, landed: bool = False) -> DataFrame:
    """One status row per split record (outcome is settled / denied /
    escalated / duplicate / errored) with the outcome-row values.

    ``materialize`` writes the split records to the shared folder first:
    duplicate detection reads them twice (aggregate + join back), and the
    checkpoint also bounds recomputation if an executor is lost.
    ``landed``: the records are a table bucketed by their lifecycle key
    (``landed_tables``), so that twins and decisions are found without shuffling it.
    """
    if materialize:
        from vendorlake.session import materialize as _checkpoint
        raw_records = _checkpoint(raw_records, "split_records")
    if landed:
        from vendorlake.operators.landed_tables import dedupe_landed
        r = dedupe_landed(raw_records)
    else:
        r = dedupe_orders(raw_records)
    # joined while the rows are narrow, for they may be shuffled by it
    r = r.join(first_decisions(decisions, review_sla_seconds), list(LIFECYCLE_KEY), "left")
    r = r.withColumn("validation_note", validation_note(r))
    r = lookup_contracts(r, contracts)
    r = price_orders(r)
    needs_review = F.abs(F.col("_variance")) > F.lit(variance_threshold_pct)
    r = r.withColumn("_review", ~F.col("is_duplicate") & F.col("validation_note").isNull()
                     & F.col("_has_contract").isNotNull()
                     & F.col("_variance").isNotNull() & needs_review)
    errored = F.col("_has_contract").isNull() | F.col("_variance").isNull()
    approved = F.col("decision") == "approve"
    terminal = "denied" if sla_action == "deny" else "escalated"
    valid = F.col("validation_note").isNull()
    outcome = (F.when(F.col("is_duplicate"), "duplicate")
               .when(~valid, "denied")
               .when(errored, "errored")
               .when(~F.col("_review"), "settled")
               .when(F.col("decision").isNotNull(), F.when(approved, "settled").otherwise("denied"))
               .otherwise(terminal))
    source = (F.when(F.col("outcome").isin("duplicate", "errored"), F.lit(None))
              .when(~valid, "validation")
              .when(~F.col("_review"), "auto")
              .when(F.col("decision").isNotNull(), "reviewer")
              .otherwise("sla_timeout"))
    payable = (F.when(F.col("outcome") == "settled", F.col("_priced")).otherwise(F.lit(0)))
    note = (F.when(F.col("decision_source") == "validation", F.col("validation_note"))
            .when(F.col("decision_source") == "reviewer", F.coalesce(F.col("decision_note"), F.lit("")))
            .when(F.col("decision_source") == "sla_timeout",
                  F.lit(f"no decision within {review_sla_seconds}s"))
            .otherwise(F.lit("")))
    priced_known = valid & F.col("_has_contract").isNotNull()
    return (r.withColumn("outcome", outcome)
            .withColumn("decision_source", source)
            .withColumn("payable_amount", payable.cast("double"))
            .withColumn("note", note)
            .withColumn("submitted_amount", F.coalesce(F.col("_submitted").cast("double"), F.lit(0.0)))
            .withColumn("priced_amount", F.when(priced_known, F.col("_priced").cast("double")))
            .withColumn("variance_pct", F.when(priced_known, F.col("_variance").cast("double"))))


def outcome_rows(settled: DataFrame) -> DataFrame:
    """The 11 remittance columns, with the reference's neutral defaults."""
    rows = settled.filter(F.col("outcome").isin("settled", "denied", "escalated"))
    return rows.select(
        "batch_id", "order_ref", "vendor",
        F.coalesce(F.col("item_count"), F.lit(0)).alias("item_count"),
        "submitted_amount",
        F.coalesce(F.col("priced_amount"), F.lit(0.0)).alias("priced_amount"),
        F.coalesce(F.col("variance_pct"), F.lit(0.0)).alias("variance_pct"),
        "outcome", "decision_source", "payable_amount", "note",
    ).select(*REMIT_COLUMNS)


def settlement_report(settled: DataFrame, rejected_files: DataFrame | None = None) -> DataFrame:
    """Per batch: orders = rows + duplicates + errored; outcome and source counts.
    A rejected file (batch_id, file_name) counts as one errored order."""
    def n(col, value):
        return F.count_if(F.col(col) == value).alias(value)
    rows = settled.select("batch_id", "outcome", "decision_source")
    if rejected_files is not None:
        rows = rows.unionByName(rejected_files.select(
            "batch_id", F.lit("errored").alias("outcome"), F.lit(None).cast("string").alias("decision_source")))
    return rows.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("orders"),
        n("outcome", "settled"), n("outcome", "denied"), n("outcome", "escalated"),
        n("outcome", "duplicate"), n("outcome", "errored"),
        n("decision_source", "auto"), n("decision_source", "reviewer"),
        n("decision_source", "validation"), n("decision_source", "sla_timeout"),
    )
