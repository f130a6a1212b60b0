"""Sinks: JSON (small, capped), parquet (distributed), manifests, checks,
and the remittance CSV.

Nothing large passes through the driver: parquet and CSV are written by the
executors; the JSON document is built by one task only after the row cap
has been checked with ``limit(cap + 1)``.
"""
from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorlake.model import MAX_INLINE_ROWS, REMIT_COLUMNS
from vendorlake.operators.diff import capped_result
from vendorlake.session import materialize
from vendorlake.sources.landed import landed_files


def json_document(df: DataFrame) -> DataFrame:
    """One row, one column ``json``: the result as a JSON array (nulls kept,
    dates as text), in the order of ``df``.  For bounded results only."""
    cols = [F.col(c).cast("string").alias(c) if t in ("date", "timestamp") else F.col(c)
            for c, t in df.dtypes]
    numbered = df.select(F.struct(F.monotonically_increasing_id().alias("i"), F.struct(*cols).alias("r")).alias("x"))
    rows = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"])
    return numbered.agg(F.to_json(rows, {"ignoreNullFields": "false"}).alias("json"))


def observed(df: DataFrame) -> tuple[DataFrame, Observation, list[str]]:
    """``df`` with its row count and each column's least and greatest value (as
    text, of 200 characters at most) measured by whatever action reads it."""
    columns = [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.BinaryType)]
    watch = Observation()

    def text(c, kind):
        return F.left(c.cast("decimal(28,6)").cast("string") if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType)
                      else c.cast("string"), F.lit(200))

    kinds = {f.name: f.dataType for f in df.schema}
    ends = [text(agg(F.col(f"`{c}`")), kinds[c]).alias(f"{name}_{i}") for i, c in enumerate(columns)
            for name, agg in (("least", F.min), ("greatest", F.max))]
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), *ends), watch, columns


def _measured(watch: Observation, columns: list[str]) -> dict:
    got = watch.get
    return {"rows": got["rows"], "stats": {c: (got[f"least_{i}"], got[f"greatest_{i}"]) for i, c in enumerate(columns)}}


def export_json(df: DataFrame, path: str, cap: int = MAX_INLINE_ROWS, name: str = "output") -> int:
    """A small result as one JSON document; more than ``cap`` rows are refused.
    Returns its rows."""
    return _write_json(df, path, cap, name)["rows"]


def export_parquet(df: DataFrame, path: str) -> int:
    """Returns the rows written."""
    return _write_parquet(df, path)["rows"]


def _write_json(df: DataFrame, path: str, cap: int, name: str) -> dict:
    """The result is computed once, into the shared folder, and checked and written
    from there; that write measures it."""
    watched, watch, columns = observed(df)
    kept = materialize(watched, "json_result")
    capped_result(kept, cap, name)
    json_document(kept).coalesce(1).write.mode("overwrite").text(path)
    return _measured(watch, columns)


def _write_parquet(df: DataFrame, path: str) -> dict:
    watched, watch, columns = observed(df)
    watched.write.mode("overwrite").parquet(path)
    return _measured(watch, columns)


def export(df: DataFrame, table: str, destination: str, fmt: str = "parquet",
           max_rows: int = MAX_INLINE_ROWS) -> dict:
    """Write a result: ``parquet``, of any size, or on request one ``json``
    document of at most ``max_rows`` rows.  Returns table, destination, format,
    rows and stats (column -> least and greatest value)."""
    if fmt == "json":
        measured = _write_json(df, destination, max_rows, table)
    elif fmt == "parquet":
        measured = _write_parquet(df, destination)
    else:
        raise ValueError(f"unsupported output format: {fmt}")
    return {"table": table, "destination": destination, "format": fmt} | measured


def export_manifest(spark: SparkSession, results: list[dict]) -> DataFrame:
    """table, destination, format, rows, files, bytes, column, least, greatest: a row
    for each column of each output, from what its write measured and its listing."""
    rows = []
    for r in results:
        held = landed_files(spark, r["destination"]).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes")).first()
        for column, (least, greatest) in (r.get("stats") or {None: (None, None)}).items():
            rows.append((r["table"], r["destination"], r["format"], r["rows"], held.n, held.bytes, column, least, greatest))
    return spark.createDataFrame(rows, "table string, destination string, format string, rows long, files long, bytes long, "
                                       "column string, least string, greatest string")


def validate_outputs(spark: SparkSession, outputs: list[dict], strict: bool = True) -> DataFrame:
    """destination, format, objects, bytes, rows, error of every declared output,
    from its listing and its rows (counted by the write itself where the output
    says so).  An output without files or rows is a failure, whatever its size:
    ``strict`` raises it, otherwise it stands in ``error``."""
    rows = []
    for out in outputs:
        kind, dest, count = out.get("format", "parquet"), out["destination"], out.get("rows")
        files = (landed_files(spark, dest, minLength="1")
                 .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first())
        if count is None and files.n:
            held = (spark.read.parquet(dest).select(F.lit(1).alias("n")) if kind == "parquet" else
                    spark.read.text(dest).select(F.size(F.from_json("value", "array<string>")).alias("n")))
            count = held.agg(F.sum("n")).first()[0]
        error = f"output {dest} holds no files" if not files.n else None if count else f"output {dest} holds no rows"
        if error and strict:
            raise RuntimeError(error)
        rows.append((dest, kind, files.n, files.bytes, count or 0, error))
    return spark.createDataFrame(rows, "destination string, format string, objects long, bytes long, rows long, error string")


#: Records of one file of a compressed remittance, which one task reads whole.
RECORDS_PER_FILE = 1_000_000


def write_remittance(outcomes: DataFrame, path: str, compression: str = "none") -> str:
    """Canonical CSV with header, columns in remittance order; with ``compression``
    (gzip, for copies that only Spark reads again) as files of a bounded size."""
    writer = (outcomes.select(*REMIT_COLUMNS).write.mode("overwrite")
              .option("header", True).option("ignoreLeadingWhiteSpace", False)
              .option("ignoreTrailingWhiteSpace", False).option("compression", compression))
    if compression != "none":
        writer = writer.option("maxRecordsPerFile", RECORDS_PER_FILE)
    writer.csv(path)
    return path


def _copy_files(dest_root: str):
    import pandas as pd

    def run(batches):
        from pyarrow import fs
        from vendorlake.sources.files import _local, _open
        for pdf in batches:
            out = []
            for path, name, reason in zip(pdf["path"], pdf["file_name"], pdf["reason"]):
                target = f"{dest_root.rstrip('/')}/{name}/{path.rsplit('/', 1)[-1]}"
                local = _local(target)
                filesystem, p = (fs.LocalFileSystem(), local) if local else fs.FileSystem.from_uri(quote(target, safe="/:@"))
                filesystem.create_dir(p.rsplit("/", 1)[0], recursive=True)
                copied = 0
                with _open(path) as src, filesystem.open_output_stream(p, compression=None) as dst:
                    while chunk := src.read(8 * 1024 ** 2):
                        dst.write(chunk)
                        copied += len(chunk)
                with filesystem.open_output_stream(p + ".reason.txt", compression=None) as r:
                    r.write((reason or "").encode())
                out.append((path, target, copied))
            yield pd.DataFrame(out, columns=["path", "quarantine_path", "bytes"])
    return run


def quarantine_files(parts: DataFrame, ledger: DataFrame, dest_root: str) -> DataFrame:
    """Copy every part file of each quarantined drop to ``dest_root/<drop>/``
    with a ``.reason.txt`` sidecar.

    Executors stream the bytes (8 MiB chunks) straight from source to
    destination; nothing passes through the driver.  Lazy: returns one row
    per copied file once an action runs.
    """
    q = ledger.filter(F.col("status") == "quarantined").select("file_name", F.col("quarantine_reason").alias("reason"))
    todo = parts.select("path", "file_name").join(q, "file_name")
    return todo.repartition(F.col("path")).mapInPandas(
        _copy_files(dest_root), "path string, quarantine_path string, bytes long")
