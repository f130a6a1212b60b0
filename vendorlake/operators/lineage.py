"""Lineage over a lifecycle-events table (order_ref, run_id, batch_id, route,
source_file, stage, ts, event_id): the reviewer queue, order traces and
attribute filters, as aggregations and filters rather than per-key scans.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_stage(events: DataFrame) -> DataFrame:
    """Current stage per order: the stage of its latest event (ties by event id)."""
    return events.groupBy("order_ref").agg(
        F.max_by("stage", F.struct("ts", "event_id")).alias("stage"),
        F.max("ts").alias("stage_ts"))


def review_queue(events: DataFrame) -> DataFrame:
    """Orders whose latest stage is ``awaiting_review`` (the reviewers' queue)."""
    return latest_stage(events).filter(F.col("stage") == "awaiting_review")


def trace_order(events: DataFrame, order_ref: str | None = None) -> DataFrame:
    """Events of the newest run of each order; of one order, in time order.

    Run start times and the newest run per order are partial aggregates; the
    events are then selected with an equi-join, so no order's events are ever
    gathered into one group.
    """
    if order_ref is not None:
        events = events.filter(F.col("order_ref") == order_ref)
    runs = events.groupBy("order_ref", "run_id").agg(F.min("ts").alias("_start"))
    newest = runs.groupBy("order_ref").agg(
        F.max_by("run_id", F.struct("_start", "run_id")).alias("run_id"))
    traced = (events.join(newest, ["order_ref", "run_id"])
              .select("order_ref", "run_id", "batch_id", "stage", "ts", "event_id"))
    return traced if order_ref is None else traced.orderBy("ts", "event_id")


def lineage_filter(events: DataFrame, batch_id: str | None = None, route: str | None = None,
                   source_file_prefix: str | None = None, order_ref: str | None = None,
                   stage: str | None = None) -> DataFrame:
    """Filter by BatchId / Route / SourceFile (prefix) / OrderId / Stage;
    plain predicates that reach the scan when the table is stored."""
    c = F.lit(True)
    if batch_id is not None:
        c = c & (F.col("batch_id") == batch_id)
    if route is not None:
        c = c & (F.col("route") == route)
    if source_file_prefix is not None:
        c = c & F.col("source_file").startswith(source_file_prefix)
    if order_ref is not None:
        c = c & (F.col("order_ref") == order_ref)
    if stage is not None:
        c = c & (F.col("stage") == stage)
    return events.filter(c)


def settlement_lifecycle(settled: DataFrame) -> DataFrame:
    """Stage transitions implied by settled records (received ... terminal),
    one row per (record, stage) with the stage's ordinal as ``seq``."""
    stages = F.when(F.col("outcome") == "duplicate", F.array(F.lit("received"))) \
        .when(F.col("decision_source") == "validation", F.array(F.lit("received"), F.lit("denied"))) \
        .when(F.col("outcome") == "errored", F.array(F.lit("received"), F.lit("validated"))) \
        .when(F.col("decision_source") == "auto", F.array(*[F.lit(s) for s in (
            "received", "validated", "enriched", "priced", "settled")])) \
        .otherwise(F.array(*[F.lit(s) for s in (
            "received", "validated", "enriched", "priced", "awaiting_review")], F.col("outcome")))
    return settled.select("batch_id", "order_ref", "vendor", "_source_file",
                          F.posexplode(stages).alias("seq", "stage"))
