"""Incremental ingest: new drops are processed once, as they land.

The ``landed_files`` stream over the landing prefix sees every file that the
batch sees, empty ones and ``_`` names included.  It feeds ``foreachBatch``: each
micro-batch runs the batch ingest on exactly its new files and writes its ledger
under ``batch_id=<n>`` with overwrite, and its models' rows under
``<ledger>_tables/<model>/batch_id=<n>``, so a replayed micro-batch (after an
executor or driver failure) rewrites the same rows instead of duplicating them.
The log of what was seen lies beside the checkpoint.  ``trigger``
``availableNow`` drains what is there and stops (a scheduled run);
``processingTime='1 hour'`` runs hourly and never overlaps itself.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlake.session import scratch_path
from vendorlake.sources.landed import landed_stream


def stream_ingest(spark: SparkSession, root: str, ledger_path: str | None = None,
                  checkpoint: str | None = None, trigger: dict | None = None,
                  dispatch_transforms: bool = True):
    """Start the ingest stream; returns (query, ledger_path)."""
    from vendorlake.plans.jobs import run_batch

    ledger_path = ledger_path or scratch_path(spark, "ingest_ledger")
    checkpoint = checkpoint or scratch_path(spark, "ingest_checkpoint")
    listing = landed_stream(spark, root, f"{checkpoint}/landed")

    def process(parts: DataFrame, batch_id: int) -> None:
        if not parts.take(1):
            return
        done = run_batch(spark, root, consolidate=False, dispatch_transforms=dispatch_transforms, parts=parts)
        for name, df in done["tables"].items():
            df.write.mode("overwrite").parquet(f"{ledger_path}_tables/{name}/batch_id={batch_id}")
        ledger = done["ledger"]
        (ledger.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .parquet(f"{ledger_path}/batch_id={batch_id}"))

    writer = listing.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start(), ledger_path
