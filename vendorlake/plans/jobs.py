"""Jobs: inputs -> landed tables -> selected models (tested) -> exports, and
the file batch that drives them.

A job spec is plain data.  Models form a small DAG of DataFrame functions
with tags; ``select("tag:x")`` builds the tagged models in dependency order,
runs the canonical model's tests on every staging model, and skips the
dependants of a failed model (the job then fails, as a failed build does).
Jobs leave tables: what they land and what they build, for later jobs to read.
Nothing here collects data: builds and exports are distributed writes, and only
test counts and small outputs reach the driver.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlake.functions.names import glob_to_regex
from vendorlake.model import DEFAULT_PATTERN, ENTITIES, MAX_INLINE_ROWS, REGISTRY, SPECS, Entity, Route, Spec, canonical_columns
from vendorlake.operators import marts
from vendorlake.operators.hygiene import ContractError, apply_hygiene, land_table
from vendorlake.operators.quality import quality_gate, run_tests
from vendorlake.operators.routing import batch_ledger, batch_report
from vendorlake.operators.staging import build_staging
from vendorlake.session import discard, materialize, scratch_path, shuffles_freed
from vendorlake.sources.export import export, quarantine_files, validate_outputs

#: Where built models are kept as tables; landed inputs carry their own database.
MODEL_DATABASE = "analytics"


@dataclass
class InputSpec:
    source: str | DataFrame            # path of a landing prefix, or a DataFrame
    table: str                         # e.g. raw.orders
    format: str = "csv"
    sanitize_headers: bool = True
    column_aliases: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    require_columns: tuple[str, ...] = ()


@dataclass
class OutputSpec:
    table: str
    destination: str | None = None
    format: str = "parquet"            # or "json": one document, of at most max_rows rows
    max_rows: int = MAX_INLINE_ROWS


@dataclass
class JobSpec:
    name: str
    inputs: list[InputSpec] = field(default_factory=list)
    select: tuple[str, ...] = ()
    outputs: list[OutputSpec] = field(default_factory=list)
    vars: Mapping[str, object] = field(default_factory=dict)
    sql_models: Mapping[str, str] = field(default_factory=dict)   # name -> SQL with :vars


@dataclass(frozen=True)
class Model:
    name: str
    deps: tuple[str, ...]
    tags: tuple[str, ...]
    build: Callable[..., DataFrame]
    entity: str | None = None          # staging models carry the data tests


def _stg(entity):
    return lambda raw: build_staging(raw, entity)


MODELS: dict[str, Model] = {m.name: m for m in (
    Model("stg_orders", ("raw.orders",), ("orders",), _stg("stg_orders"), "stg_orders"),
    Model("daily_revenue", ("stg_orders",), ("orders",), marts.daily_revenue),
    Model("stg_customers", ("raw.customers",), ("customers",), _stg("stg_customers"), "stg_customers"),
    Model("dim_customers", ("stg_customers",), ("customers",), marts.dim_customers),
    Model("stg_payments", ("raw.payments",), ("payments",), _stg("stg_payments"), "stg_payments"),
    Model("fct_payments", ("stg_payments",), ("payments",), marts.fct_payments),
    Model("stg_settlements", ("raw.settlements",), ("settlements",), _stg("stg_settlements"),
          "stg_settlements"),
    Model("pricing_summary", ("stg_settlements",), ("settlements",), marts.pricing_summary),
    Model("executive_summary", ("stg_orders", "dim_customers", "fct_payments"), ("consolidated",),
          marts.executive_summary),
)}


@dataclass(frozen=True)
class Config:
    """What a batch or job goes by; ``plans.config`` loads one from JSON."""

    registry: tuple[Route, ...] = REGISTRY
    specs: Mapping[str, Spec] = field(default_factory=lambda: SPECS)
    entities: Mapping[str, Entity] = field(default_factory=lambda: ENTITIES)
    models: Mapping[str, Model] = field(default_factory=lambda: MODELS)


DEFAULT = Config()


def selected_models(select: tuple[str, ...], models: Mapping[str, Model] = MODELS) -> list[Model]:
    """Models matching any selector (``tag:x`` or a model name), in
    dependency order."""
    chosen = [m for m in models.values()
              if any((s.startswith("tag:") and s[4:] in m.tags) or s == m.name for s in select)]
    names = {m.name for m in chosen}
    ordered, done = [], set()

    def visit(m: Model):
        if m.name in done:
            return
        for d in m.deps:
            if d in names:
                visit(models[d])
        done.add(m.name)
        ordered.append(m)
    for m in chosen:
        visit(m)
    return ordered


def _short(table: str) -> str:
    return table.split(".")[-1]


def load_input(spark: SparkSession, inp: InputSpec) -> DataFrame:
    if isinstance(inp.source, DataFrame):
        df = inp.source
    elif inp.format == "csv":
        from vendorlake.sources.files import list_parts, read_csv_raw
        parts = list_parts(spark, inp.source)
        df, rejected = read_csv_raw(spark, parts, inp.sanitize_headers, inp.column_aliases,
                                    inp.require_columns, root=inp.source)
        bad = rejected.select("reason").limit(1).collect()
        if bad:
            raise ContractError(bad[0]["reason"])
        if df is None:
            raise ContractError(f"input {inp.source} has no readable files")
        return df
    else:
        df = spark.read.format(inp.format).load(inp.source)
    return apply_hygiene(df, inp.sanitize_headers, inp.column_aliases, inp.require_columns,
                         source=str(inp.table))


def _saved(spark: SparkSession, name: str) -> DataFrame:
    """A table that an earlier job left."""
    return spark.table(name if "." in name else f"{MODEL_DATABASE}.{name}")


def run_sql(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], args: Mapping[str, object]) -> DataFrame:
    """A statement over the job's tables by their short names; the names are gone
    afterwards, so no later job can pick them up."""
    views = {_short(t): df for t, df in tables.items()}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(sql, args=dict(args) or None)
    finally:
        for name in views:
            spark.catalog.dropTempView(name)


def run_job(spark: SparkSession, spec: JobSpec, tables: dict[str, DataFrame] | None = None,
            save: bool = True, table_format: str = "parquet", config: Config = DEFAULT) -> dict:
    """Run one job; returns {success, error, tables, outputs, tests}.

    Inputs are landed as their tables and models saved in MODEL_DATABASE (as
    ``table_format``; in the warehouse, not among intermediate tables), so a later job - a consolidation without inputs, say -
    finds them; with ``save`` off they are plans only.  A rejected input, a
    missing table, a failed test and data that cannot be computed all end in
    ``success: False`` with the reason.
    """
    tables, tests, outputs = dict(tables or {}), [], []

    def keep(name: str, df: DataFrame) -> DataFrame:
        if not save:
            return df
        table = name if "." in name else f"{MODEL_DATABASE}.{name}"
        return land_table(df, table, fmt=table_format)

    def result(error: str | None = None) -> dict:
        return {"success": error is None, "error": error, "tables": tables, "outputs": outputs, "tests": tests}

    failed: set[str] = set()
    try:
        for inp in spec.inputs:
            tables[inp.table] = keep(inp.table, load_input(spark, inp).drop("_block_start", "_mid"))
        for m in selected_models(spec.select, config.models):
            if any(d in failed for d in m.deps):
                failed.add(m.name)
                continue
            df = m.build(*[tables[d] if d in tables else _saved(spark, d) for d in m.deps])
            if m.entity:
                bad = run_tests(df, config.entities[m.entity]).filter(F.col("failures") > 0).collect()
                tests += [r.asDict() for r in bad]
                if bad:
                    failed.add(m.name)
                    continue
            tables[m.name] = keep(m.name, df)
        if failed:
            return result(f"data tests failed in {sorted(failed)}")
        for name, sql in spec.sql_models.items():
            tables[name] = run_sql(spark, sql, tables, spec.vars)
        for out in spec.outputs:
            short = _short(out.table)
            df = tables[short] if short in tables else _saved(spark, out.table)
            outputs.append(export(df, out.table, out.destination or scratch_path(spark, short), out.format, out.max_rows))
    except (ContractError, PySparkException, ValueError) as exc:
        return result(str(exc))
    return result()


def run_batch(spark: SparkSession, root: str, consolidate: bool = True,
              dispatch_transforms: bool = True, pattern: str = DEFAULT_PATTERN,
              max_decompressed: int | None = None, publish: str | None = None,
              parts: DataFrame | None = None, config: Config = DEFAULT) -> dict:
    """The file batch as one set of Spark jobs.

    discover (names matching ``pattern``) -> gzip audit -> route -> duplicates ->
    per route: one read of all its files per column layout -> per-file cast +
    data-test gate (bad files quarantined, the rest go on) -> the route's models
    -> consolidation, once a file has transformed, over this batch's tables and
    those that earlier jobs left.

    ``config``: other routes, specs, entities and models (``plans.config``).
    ``parts``: only these files of ``root`` (what a stream's micro-batch brought).
    ``publish``: a folder for what the batch gives out: the models, the outputs
    its specs declare (parquet, validated: an empty one quarantines the files of its
    route), and copies of the quarantined files.
    Returns {ledger, report, tables, rejected, outputs, quarantined}.
    """
    from vendorlake.operators.routing import classify_route, mark_duplicates
    from vendorlake.sources.files import list_parts, read_csv_raw
    from vendorlake.sources.gzip_audit import gzip_audit

    parts = list_parts(spark, root, pattern=pattern) if parts is None else parts.filter(F.col("file_name").rlike(glob_to_regex(pattern)))
    parts = materialize(parts, "listing")
    # the audit inflates every archive once; all later steps read its result
    files = materialize(
        parts.groupBy("file_name").agg(F.max("modified_at").alias("modified_at"))
        .join(gzip_audit(parts, max_decompressed).select("file_name", "gzip_error"), "file_name", "left"), "audit")
    routed = mark_duplicates(classify_route(files, config.registry))
    usable = materialize(routed.filter(F.col("gzip_error").isNull() & F.col("route").isNotNull()
                                       & ~F.col("is_duplicate")).select("file_name", "route"), "usable")
    tables: dict[str, DataFrame] = {}
    rejected_frames = []
    if dispatch_transforms:
        for entry in config.registry:
            if entry.spec is None:
                continue
            spec = config.specs[entry.spec]
            model = spec.staging_model
            entity = config.entities[model]
            route_parts = parts.join(usable.filter(F.col("route") == entry.route)
                                     .select("file_name"), "file_name")
            raw, rej = read_csv_raw(spark, route_parts, True, spec.column_aliases,
                                    entity.column_names, root=root)
            rejected_frames.append(rej)
            if raw is None:
                continue
            raw = raw.drop("_block_start", "_mid")
            good, bad = quality_gate(raw, entity, materialize=True)   # parse the CSV once
            rejected_frames.append(bad.select(F.col("_source_file").alias("file_name"), "reason"))
            tables[model] = good.drop("_source_file")
            for m in selected_models(tuple(f"tag:{t}" for t in spec.select_tags), config.models):
                if m.entity is None and all(d in tables for d in m.deps):
                    tables[m.name] = m.build(*[tables[d] for d in m.deps])
    outputs: list[dict] = []
    if publish:
        for spec in config.specs.values():
            outputs += _publish(spark, spec, tables, publish)
            empty = [o["error"] for o in outputs if o["error"] and o["spec"] == spec.name]
            if empty:                                  # the transform failed: its files are quarantined
                routes = [r.route for r in config.registry if r.spec == spec.name]
                rejected_frames.append(usable.filter(F.col("route").isin(routes)).select("file_name", F.lit(empty[0]).alias("reason")))
    rejected = None
    if rejected_frames:
        rejected = rejected_frames[0]
        for r in rejected_frames[1:]:
            rejected = rejected.unionByName(r)
        rejected = materialize(rejected, "rejected")
    ledger = batch_ledger(files, dispatch_transforms, rejected, registry=config.registry)
    if consolidate and dispatch_transforms and "consolidation" in config.specs:
        transformed = not ledger.filter(F.col("status") == "transformed").isEmpty()
        for m in selected_models(tuple(f"tag:{t}" for t in config.specs["consolidation"].select_tags), config.models):
            known = [d for d in m.deps if d in tables or spark.catalog.tableExists(f"{MODEL_DATABASE}.{d}")]
            if transformed and len(known) == len(m.deps):
                tables[m.name] = m.build(*[tables[d] if d in tables else _saved(spark, d) for d in m.deps])
    quarantined = None
    if publish:
        outputs += _publish(spark, config.specs["consolidation"], tables, publish, outputs) if "consolidation" in config.specs else []
        for name, df in tables.items():
            tables[name] = land_table(df, f"{MODEL_DATABASE}.{name}", f"{publish}/tables/{name}")
        quarantined = materialize(quarantine_files(parts, ledger, f"{publish}/quarantine"), "quarantined")
    return {"ledger": ledger, "report": batch_report(ledger), "tables": tables,
            "rejected": rejected, "outputs": outputs, "quarantined": quarantined}


def _publish(spark: SparkSession, spec, tables: dict[str, DataFrame], root: str, done: list[dict] | tuple = ()) -> list[dict]:
    """Write and check the outputs a spec declares, as far as their models were built."""
    names = [o for o in spec.outputs if _short(o) in tables and o not in {d["table"] for d in done}]
    outputs = [export(tables[_short(o)], o, f"{root}/outputs/{_short(o)}") | {"spec": spec.name} for o in names]
    checked = {r.destination: r.error for r in validate_outputs(spark, outputs, strict=False).collect()} if outputs else {}
    return [o | {"error": checked[o["destination"]]} for o in outputs]


def reland_settlements(spark: SparkSession, remit: str, gate: bool = True) -> dict:
    """A remittance CSV -> re-landed through the settlements contract (sanitized
    headers, no aliases) -> stg_settlements -> its data tests -> pricing_summary.

    ``gate``: failing tests stop the mart, as in one batch.  Off, they are told in
    ``error`` all the same: for a remittance of many batches and vendors, whose order
    refs the model's tests do not hold unique.
    Returns {stg_settlements, tests, mart, error}.
    """
    from vendorlake.sources.files import list_parts, read_csv_raw
    raw, rejected = read_csv_raw(spark, list_parts(spark, remit).withColumn("file_name", F.lit("remittance.csv")),
                                 True, None, canonical_columns("stg_settlements"))
    if raw is None:
        refused = [r.reason for r in rejected.select("reason").collect()]       # of the one drop
        return {"stg_settlements": None, "tests": None, "mart": None, "error": "remittance has no rows" if not refused else refused[0]}
    stg = materialize(build_staging(raw.drop("_block_start", "_mid", "_source_file"), "stg_settlements"), "stg", "zstd")
    tests = materialize(run_tests(stg, "stg_settlements"), "tests")
    failed = tests.filter(F.col("failures") > 0).collect()
    return {"stg_settlements": stg, "tests": tests, "mart": None if failed and gate else marts.pricing_summary(stg),
            "error": f"data tests failed: {[r.asDict() for r in failed]}" if failed else None}


def run_settlement_batch(spark: SparkSession, root: str, contracts: DataFrame,
                         decisions: DataFrame, remit_path: str | None = None,
                         batch_id: str = "batch", multi_line: bool = True, **policy) -> dict:
    """The order batch: ingest-only landing -> split -> settle -> remittance
    CSV -> re-landed through the settlements contract -> stg_settlements
    (tested) -> pricing_summary.

    All records belong to ``batch_id``, and so do ``decisions`` without a batch
    of their own.  A vendor file that is unreadable, empty, corrupt or without
    records is rejected and counted as one errored order.  Failing tests stop
    the mart.  ``multi_line``: quoted values may hold line breaks; off, large
    files are split between tasks.  Returns {settled, outcomes, report, mart,
    error, rejected, remittance, stg_settlements, tests}.

    Copies that only one step reads go with it, and shuffles with their statement; a
    remittance without a ``remit_path`` of its own is kept as gzip.
    """
    with shuffles_freed(spark):
        return _settlement_batch(spark, root, contracts, decisions, remit_path, batch_id, multi_line, **policy)


def _settlement_batch(spark: SparkSession, root: str, contracts: DataFrame, decisions: DataFrame,
                      remit_path: str | None, batch_id: str, multi_line: bool, **policy) -> dict:
    from vendorlake.operators.routing import classify_route
    from vendorlake.operators.settlement import outcome_rows, settle, settlement_report, split_orders
    from vendorlake.sources.export import write_remittance
    from vendorlake.sources.files import list_parts, read_csv_raw
    from vendorlake.sources.gzip_audit import gzip_audit

    parts = list_parts(spark, root)
    vendor_files = (classify_route(parts.select("file_name").distinct())
                    .filter(F.col("route") == "vendor-orders").select("file_name"))
    parts = materialize(parts.join(vendor_files, "file_name"), "vendor_files")
    corrupt = materialize(gzip_audit(parts).filter(F.col("gzip_error").isNotNull())
                          .select("file_name", F.col("gzip_error").alias("reason")), "corrupt")
    raw, rejected = read_csv_raw(spark, parts.join(corrupt, "file_name", "left_anti"), multi_line=multi_line, root=root)
    rejected = rejected.unionByName(corrupt)
    if raw is None and rejected.isEmpty():
        raise ContractError("no vendor-orders files landed in this batch")
    if raw is None:
        raw = spark.createDataFrame([], "_source_file string, _block_start long, _mid long")
    # parsed once: the rows are counted by file split first, and numbered by the counts
    rows = materialize(raw, "vendor_rows", "zstd")
    records = materialize(split_orders(rows, batch_id), "split_records", "zstd")
    discard(rows)
    silent = (parts.select("file_name").distinct().join(rejected.select("file_name"), "file_name", "left_anti")
              .join(records.select(F.col("_source_file").alias("file_name")).distinct(), "file_name", "left_anti")
              .select("file_name", F.concat("file_name", F.lit(": no records")).alias("reason")))
    rejected = materialize(rejected.unionByName(silent).withColumn("batch_id", F.lit(batch_id)), "rejected_files")
    if "batch_id" not in decisions.columns:
        decisions = decisions.withColumn("batch_id", F.lit(batch_id))
    settled = materialize(settle(records, contracts, decisions, **policy), "settled", "zstd")
    discard(records)
    outcomes = outcome_rows(settled)
    remit = write_remittance(outcomes, remit_path) if remit_path else write_remittance(outcomes, scratch_path(spark, "remittance"), "gzip")
    relanded = reland_settlements(spark, remit)
    return {"settled": settled, "outcomes": outcomes, "report": settlement_report(settled, rejected),
            "rejected": rejected, "remittance": remit, **relanded}
