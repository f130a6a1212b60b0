"""Reviews and their decisions as two streams: an interval join.

Both sides carry a watermark.  A review matches the valid decisions of its order
from ``early`` before its opening to the SLA after it; the join keeps a row only
as long as a partner can still come, so its state is bounded by the SLA and the
lateness, not by the stream.  The first match (by time, then id) is the review's
decision: a second operator, over the joined rows, that closes a review once the
join's own watermark has passed it.  On tables the same function gives the whole
result at once.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlake.model import REVIEW_SLA_SECONDS, SLA_ACTION, VALID_DECISIONS

ORDER_KEY = ("vendor", "order_ref")


def first_decisions(reviews: DataFrame, decisions: DataFrame, sla_seconds: int = REVIEW_SLA_SECONDS, early_seconds: int = 0,
                    sla_action: str = SLA_ACTION, lateness: str = "0 seconds", key: Sequence[str] = ORDER_KEY) -> DataFrame:
    """reviews (key, review_id, opened_at) and decisions (key, decision_id,
    decided_at, decision, note) -> key, review_id, opened_at, outcome,
    decision_source, decision_id, note, resolved_at; one row per review.

    Invalid verbs are left out before the join.  A tie with the timer goes to the
    decision, one between decisions to the lesser id.  Null keys match nothing.
    """
    r = reviews.select(*key, "review_id", "opened_at").withWatermark("opened_at", lateness)
    d = (decisions.where(F.col("decision").isin(*VALID_DECISIONS))
         .select(*[F.col(k).alias(f"d_{k}") for k in key], "decision_id", "decided_at", "decision", "note")
         .withWatermark("decided_at", lateness))
    interval = ((F.col("decided_at") >= F.col("opened_at") - F.expr(f"INTERVAL {int(early_seconds)} SECONDS"))
                & (F.col("decided_at") <= F.col("opened_at") + F.expr(f"INTERVAL {int(sla_seconds)} SECONDS")))
    for k in key:
        interval = (F.col(k) == F.col(f"d_{k}")) & interval
    both = r.join(d, interval, "leftOuter")
    first = F.min(F.when(F.col("decision_id").isNotNull(), F.struct("decided_at", "decision_id", "decision", "note")))
    found = both.groupBy(*key, "review_id", "opened_at").agg(first.alias("d"))
    late = F.col("opened_at") + F.expr(f"INTERVAL {int(sla_seconds)} SECONDS")
    return found.select(
        *key, "review_id", "opened_at",
        F.when(F.col("d").isNull(), "denied" if sla_action == "deny" else "escalated")
         .when(F.col("d.decision") == "approve", "settled").otherwise("denied").alias("outcome"),
        F.when(F.col("d").isNull(), "sla_timeout").otherwise("reviewer").alias("decision_source"),
        F.col("d.decision_id").alias("decision_id"),
        F.when(F.col("d").isNull(), f"no decision within {sla_seconds}s").otherwise(F.col("d.note")).alias("note"),
        F.when(F.col("d").isNull(), late).otherwise(F.greatest("d.decided_at", "opened_at")).alias("resolved_at"))
