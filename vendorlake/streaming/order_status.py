"""Live review status per order, with the SLA as an event-time timer.

Input events (batch_id, vendor, order_ref, kind, ts, decision, note, decision_id):
``kind = 'opened'`` when an order enters review, ``kind = 'decision'`` for a
reviewer signal; other kinds are ignored.  Orders are told apart by batch, vendor
and order_ref.  An order's review opens with its first ``opened`` event; its first
valid decision settles it if it comes by the opening + SLA (before the opening,
too; a tie with the timer goes to the decision), else the SLA does.

``transformWithStateInPandas`` keeps the orders of a batch in ``PARTS`` parts, by
their hash: one state value (in RocksDB) and one timer a part, so that reading and
writing the state costs a few calls for all of a part's orders that an interval of
the stream touches, not a dozen for each.  A part holds what its batch has open or
not yet forgotten.  A resolution is given out when the watermark has passed the
moment that makes it final, so events that come late or out of order, within the
lateness, never change it, and a replayed or differently cut stream gives the same
rows.  An order is forgotten ``retention`` after its opening (or its last valid
signal, if it never opens).  Events without a time are left out.
"""
from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vendorlake.model import REVIEW_SLA_SECONDS, SLA_ACTION, VALID_DECISIONS

KEY = ("batch_id", "vendor", "order_ref")
#: Parts of a batch; fixed for the life of a checkpoint.
PARTS = 64
OUTPUT_SCHEMA = ("batch_id string, vendor string, order_ref string, outcome string, decision_source string, "
                 "note string, resolved_us long")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

#: An order in the state: when it opened (microseconds) and whether it is resolved,
#: its first valid decision (us, id, verb, note), and its last event's time.
OPENED, RESOLVED, DECISION, LAST = range(4)


class Review(StatefulProcessor):
    """The orders of one part: {(vendor, order_ref): [opened, resolved, decision, last]}."""

    def __init__(self, sla_us: int, retention_us: int, valid: tuple[str, ...], timeout_outcome: str, timeout_note: str):
        self.sla, self.retention, self.valid = sla_us, retention_us, frozenset(valid)
        self.timeout_outcome, self.timeout_note = timeout_outcome, timeout_note

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("orders", "orders binary")

    def _load(self) -> tuple[int | None, dict]:
        kept = self.kept.get()
        return pickle.loads(kept[0]) if kept else (None, {})

    def _store(self, timer: int | None, orders: dict) -> None:
        """Keep the orders, and one timer: for the first of them that has something due."""
        if not orders:
            self.kept.clear()
            return
        due = min(self._next(o) for o in orders.values())
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.kept.update((pickle.dumps((due, orders), pickle.HIGHEST_PROTOCOL),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, orders = self._load()
        for df in rows:
            columns = [df[c].tolist() for c in ("vendor", "order_ref", "kind", "decision", "note", "decision_id", "us")]
            for vendor, ref, kind, verb, note, did, us in zip(*columns):
                if kind != "opened" and verb not in self.valid:
                    continue
                order = orders.setdefault((vendor, ref), [None, False, None, us])
                order[LAST] = max(order[LAST], us)
                if order[RESOLVED]:
                    continue
                if kind == "opened":
                    order[OPENED] = us if order[OPENED] is None else min(order[OPENED], us)
                elif order[DECISION] is None or (us, did) < order[DECISION][:2]:
                    order[DECISION] = (us, did, verb, note)
        if orders:
            self._store(timer, orders)
        return iter(())

    def _due(self, order: list) -> int:
        """When the watermark shows how the review ended."""
        opened, decision = order[OPENED], order[DECISION]
        if decision is not None and decision[0] <= opened + self.sla:
            return max(opened, decision[0])
        return opened + self.sla

    def _forget(self, order: list) -> int:
        return _ms((order[LAST] if order[OPENED] is None else order[OPENED]) + self.retention)

    def _next(self, order: list) -> int:
        if order[OPENED] is None or order[RESOLVED]:
            return self._forget(order)
        return min(_ms(self._due(order)), self._forget(order))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        timer, orders = self._load()
        ended = []
        for name, order in list(orders.items()):
            if self._next(order) > now:
                continue
            if order[OPENED] is not None and not order[RESOLVED] and _ms(self._due(order)) <= now:
                order[RESOLVED] = True
                ended.append((key[0], *name, *self._end(order)))
            if self._forget(order) <= now:
                del orders[name]
        self._store(None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer, orders)
        if ended:
            yield pd.DataFrame(ended, columns=[*KEY, "outcome", "decision_source", "note", "resolved_us"])

    def _end(self, order: list) -> tuple:
        opened, decision = order[OPENED], order[DECISION]
        if decision is not None and decision[0] <= opened + self.sla:
            return "settled" if decision[2] == "approve" else "denied", "reviewer", decision[3], decision[0]
        return self.timeout_outcome, "sla_timeout", self.timeout_note, opened + self.sla


def _ms(us: int) -> int:
    """The first watermark (milliseconds) that is not before ``us``."""
    return -(-us // 1000)


def order_status(events: DataFrame, sla_seconds: int = REVIEW_SLA_SECONDS, sla_action: str = SLA_ACTION,
                 lateness: str = "0 seconds", retention_seconds: int | None = None) -> DataFrame:
    """A stream of events -> one resolution row per reviewed order.

    ``retention_seconds`` (two SLAs by default) must cover what an order's events
    can lie apart: later ones open a review of their own."""
    retention = 2 * sla_seconds if retention_seconds is None else max(retention_seconds, sla_seconds)
    review = Review(int(sla_seconds * 1e6), int(retention * 1e6), VALID_DECISIONS,
                    "denied" if sla_action == "deny" else "escalated", f"no decision within {sla_seconds}s")
    rows = (events.withWatermark("ts", lateness).where(F.col("kind").isin("opened", "decision") & F.col("ts").isNotNull())
            .select(*KEY, F.pmod(F.xxhash64("vendor", "order_ref"), F.lit(PARTS)).alias("part"), "kind", "decision", "note",
                    F.coalesce("decision_id", F.lit(-1)).alias("decision_id"), "ts", F.unix_micros("ts").alias("us")))
    # by value: the worker that the driver starts for the state's schema has no shipped package
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    out = rows.groupBy("batch_id", "part").transformWithStateInPandas(review, OUTPUT_SCHEMA, "Append", "EventTime")
    return out.select(*KEY, "outcome", "decision_source", "note", F.timestamp_micros("resolved_us").alias("resolved_at"))


def start(resolutions: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Run the stream into parquet at ``path``, its state in RocksDB."""
    spark = resolutions.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        return (resolutions.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).start())
    finally:
        spark.conf.set(_PROVIDER, before)
