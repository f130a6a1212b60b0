"""File-level rules of a batch: routing, duplicates, quarantine, the ledger.

A batch is a DataFrame of file names (``file_name``, optionally
``modified_at``, ``length`` and a gzip audit ``gzip_error``) - metadata
only; no file content is touched here.  Routing is a first-match ``CASE``
over anchored regexes compiled from the registry globs: the registry is
configuration (a handful of patterns), so it becomes an expression, not a
join.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendorlake.functions.names import decompressed_name_col, glob_to_regex
from vendorlake.model import (
    REGISTRY,
    SPECS,
    Route,
    canonical_columns,
)

NO_ROUTE = "no route pattern matched"
ALREADY_RUNNING = "a transform for this route+filename is already running"


def route_col(name: Column, registry: tuple[Route, ...] = REGISTRY) -> Column:
    """First matching glob in registry order; anchored, case-sensitive; else NULL."""
    expr = None
    for r in registry:
        cond = name.rlike(glob_to_regex(r.pattern))
        expr = F.when(cond, F.lit(r.route)) if expr is None else expr.when(cond, F.lit(r.route))
    return expr.otherwise(F.lit(None).cast("string"))


def spec_col(route: Column, registry: tuple[Route, ...] = REGISTRY) -> Column:
    expr = F.lit(None).cast("string")
    for r in reversed(registry):
        expr = F.when(route == r.route, F.lit(r.spec)).otherwise(expr)
    return expr


def classify_route(files: DataFrame, registry: tuple[Route, ...] = REGISTRY) -> DataFrame:
    """Add ``decompressed_name`` and ``route`` (routing uses the decompressed name)."""
    d = decompressed_name_col(F.col("file_name"))
    return files.withColumn("decompressed_name", d).withColumn("route", route_col(d, registry))


def batch_window(files: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Re-run a past range: files modified in [since, until)."""
    c = F.lit(True)
    if since:
        c = c & (F.col("modified_at") >= F.lit(since).cast("timestamp"))
    if until:
        c = c & (F.col("modified_at") < F.lit(until).cast("timestamp"))
    return files.filter(c)


def mark_duplicates(routed: DataFrame) -> DataFrame:
    """Same route + decompressed name in one batch: the first name (sorted)
    runs, the others are duplicates.

    A listing holds each name once, so a (route, decompressed name) key holds
    at most two files (``x`` and ``x.gz``): the window's groups are bounded
    by construction and one shuffle replaces an aggregate joined back to its
    own input.
    """
    w = Window.partitionBy("route", "decompressed_name").orderBy("file_name")
    dup = F.when(F.col("route").isNull(), F.lit(False)).otherwise(F.row_number().over(w) > 1)
    return routed.withColumn("is_duplicate", dup)


def resolve_spec(routed: DataFrame) -> DataFrame:
    """route -> spec, landed table, staging model and its required columns."""
    spec = spec_col(F.col("route"))
    table, model, required = (F.lit(None).cast("string"),) * 3
    for name, s in SPECS.items():
        if not s.source_table:
            continue
        hit = spec == name
        table = F.when(hit, F.lit(s.source_table)).otherwise(table)
        model = F.when(hit, F.lit(s.staging_model)).otherwise(model)
        required = F.when(hit, F.lit(",".join(canonical_columns(s.staging_model)))).otherwise(required)
    return routed.select("file_name", "route", spec.alias("spec"), table.alias("source_table"),
                         model.alias("staging_model"), required.alias("require_columns"))


def batch_ledger(files: DataFrame, dispatch_transforms: bool = True,
                 rejected: DataFrame | None = None, landing_prefix: str = "landing",
                 quarantine_prefix: str = "quarantine", registry: tuple[Route, ...] = REGISTRY) -> DataFrame:
    """One result row per discovered file (the batch's ``results``): ``file`` is its
    name as landed, ``file_name`` as it was found (``x.csv`` and ``x.csv.gz`` land
    under one name).

    ``files`` may carry ``gzip_error`` (from ``sources.gzip_audit``);
    ``rejected`` (file_name, reason) holds files the transform refused
    (contract, cast or data tests) - they are quarantined, the batch goes on.
    Routes without a spec land without a transform.
    """
    if "gzip_error" not in files.columns:
        files = files.withColumn("gzip_error", F.lit(None).cast("string"))
    r = mark_duplicates(classify_route(files, registry))
    is_gz = F.col("file_name") != F.col("decompressed_name")
    file_out = F.when(F.col("gzip_error").isNotNull(), F.col("file_name")).otherwise(F.col("decompressed_name"))
    landed_key = F.concat(F.lit(landing_prefix + "/"), F.when(is_gz & F.col("gzip_error").isNull(),
                                                             F.col("decompressed_name"))
                          .otherwise(F.col("file_name")))
    if rejected is not None:
        first_reason = rejected.groupBy("file_name").agg(F.min("reason").alias("_rejected"))
        r = r.join(first_reason, "file_name", "left")
    else:
        r = r.withColumn("_rejected", F.lit(None).cast("string"))
    has_spec = spec_col(F.col("route"), registry).isNotNull()
    status = (F.when(F.col("gzip_error").isNotNull(), "quarantined")
              .when(F.col("route").isNull(), "quarantined")
              .when(F.lit(not dispatch_transforms), "landed")
              .when(F.col("is_duplicate"), "duplicate")
              .when(~has_spec, "landed")
              .when(F.col("_rejected").isNotNull(), "quarantined")
              .otherwise("transformed"))
    reason = (F.when(F.col("gzip_error").isNotNull(), F.col("gzip_error"))
              .when(F.col("route").isNull(), F.lit(NO_ROUTE))
              .when(F.lit(not dispatch_transforms), F.lit(None))
              .when(F.col("is_duplicate"), F.lit(ALREADY_RUNNING))
              .when(~has_spec, F.lit(None))
              .otherwise(F.col("_rejected")))
    out = r.select(
        "file_name", file_out.alias("file"), status.alias("status"),
        F.when(F.col("gzip_error").isNull(), F.col("route")).alias("route"),
        landed_key.alias("landed_key"), reason.alias("_reason"))
    qkey = F.concat(F.lit(quarantine_prefix + "/"), F.regexp_extract("landed_key", r"([^/]*)$", 1))
    return out.select(
        "file", "status",
        "route",
        F.when(F.col("status").isin("landed", "transformed"), F.col("landed_key")).alias("landed_key"),
        F.when(F.col("status") == "quarantined", qkey).alias("quarantine_key"),
        F.col("_reason").alias("error"),
        F.when(F.col("status") == "quarantined", F.col("_reason")).alias("quarantine_reason"),
        "file_name",
    )


def ingest_only(files: DataFrame) -> DataFrame:
    """Land + route, no transform: landed files with their route and key."""
    return batch_ledger(files, dispatch_transforms=False).filter(F.col("status") == "landed") \
        .select("file", "status", "landed_key", "route")


def quarantine(ledger: DataFrame) -> DataFrame:
    """The quarantine manifest: what was moved where, and why."""
    return ledger.filter(F.col("status") == "quarantined").select(
        "file", "quarantine_key", "quarantine_reason")


def batch_report(ledger: DataFrame) -> DataFrame:
    """files_processed, transformed, landed, quarantined (duplicates count only
    in files_processed)."""
    return ledger.agg(
        F.count(F.lit(1)).alias("files_processed"),
        F.count_if(F.col("status") == "transformed").alias("transformed"),
        F.count_if(F.col("status") == "landed").alias("landed"),
        F.count_if(F.col("status") == "quarantined").alias("quarantined"),
    )
