"""File sources: discovery, headers, the header-signature CSV read, any format.

Discovery reads the ``landed_files`` source (``sources.landed``): every file, at
any depth, listed by tasks.  Headers are read by a small Python
task per file (``mapInPandas`` + ``pyarrow.fs``) that opens the file, reads its
header only and settles its columns: a file whose columns collide or miss is
rejected there, with a reason of its own.  The others are read once per
distinct column layout (a handful), so columns are matched by name, never by
position, even when vendors reorder or rename them.
"""
from __future__ import annotations

import codecs
import csv
import gzip
import io
import itertools
import json
import re
import sys
from collections.abc import Iterable, Mapping
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorlake.functions.names import glob_to_regex
from vendorlake.model import DEFAULT_PATTERN
from vendorlake.operators.hygiene import Resolver, lacking
from vendorlake.sources.landed import landed_files

def _source_of(file_path, root: str):
    """The drop of a row of a file under ``root``, from Spark's own file metadata
    (a URI): what ``sources.landed.drop_name`` gives for the listing."""
    plain = F.url_decode(F.regexp_replace(file_path, r"\+", "%2B"))
    top = re.escape(root.removeprefix("file:").strip("/"))
    below = F.regexp_extract(plain, f"^.*?{top}/(.*)$", 1)
    first = F.regexp_extract(below, "^([^/]*)", 1)
    return (F.when(below == "", F.regexp_extract(plain, "([^/]*)$", 1))
            .when(F.instr(below, "/") > 0, F.regexp_replace(first, "^[^=]+=", "")).otherwise(first))


def list_parts(spark: SparkSession, root: str, modified_after: str | None = None,
               modified_before: str | None = None, pattern: str | None = None) -> DataFrame:
    """Every data file under ``root`` (no content read): path, length, mtime, drop.

    ``modified_after`` / ``modified_before`` (``YYYY-MM-DDTHH:mm:ss``, UTC) re-run a
    past window (backfill); they and ``pattern`` (a glob for the drop's name) prune
    the listing itself.
    """
    return landed_files(spark, root, modifiedAfter=modified_after, modifiedBefore=modified_before,
                        pattern=glob_to_regex(pattern) if pattern else None)


def discover_files(spark: SparkSession, root: str, pattern: str = DEFAULT_PATTERN,
                   modified_after: str | None = None, modified_before: str | None = None) -> DataFrame:
    """Drops under ``root`` whose name matches ``pattern``, one row per drop:
    file_name, parts, length, modified_at (sorted by name)."""
    parts = list_parts(spark, root, modified_after, modified_before, pattern)
    return (parts.groupBy("file_name")
            .agg(F.count(F.lit(1)).alias("parts"), F.sum("length").alias("length"),
                 F.max("modified_at").alias("modified_at"))
            .orderBy("file_name"))


# --------------------------------------------------------------------------
# headers
# --------------------------------------------------------------------------
def _local(path: str) -> str | None:
    """The plain path of a local file; None for another file system."""
    if path.startswith("file:"):
        return "/" + path[len("file:"):].lstrip("/")
    return path if path.startswith("/") else None


def _open(path: str):
    """An input stream; names may hold any character (blanks, ``#``, ``%``)."""
    from pyarrow import fs
    local = _local(path)
    if local:
        return fs.LocalFileSystem().open_input_stream(local, compression=None)
    filesystem, p = fs.FileSystem.from_uri(quote(path, safe="/:@"))
    return filesystem.open_input_stream(p, compression=None)


def _header_record(path: str) -> list[str] | None:
    """The first CSV record of a (possibly gzip) file, reading only as far as
    needed; a quoted name may hold commas and line breaks, of any length."""
    decode = codecs.getincrementaldecoder("utf-8")(errors="replace").decode
    text, quotes, end = "", 0, -1
    with _open(path) as raw:
        stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
        while end < 0:
            chunk = stream.read(65536)
            new = decode(chunk, final=not chunk)
            for i, c in enumerate(new):
                quotes += c == '"'
                if c == "\n" and quotes % 2 == 0:
                    end = len(text) + i
                    break
            text += new
            if not chunk:
                break
    line = (text if end < 0 else text[:end]).lstrip("\ufeff").rstrip("\r")
    if not line.strip():
        return None
    csv.field_size_limit(sys.maxsize)
    return next(csv.reader([line + "\n"] if "\n" not in line else line.splitlines(keepends=True)))


def _headers(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    for pdf in batches:
        out = []
        for p in pdf["path"]:
            try:
                names = _header_record(p)
                out.append((p, None if names is None else json.dumps(names), None))
            except Exception as exc:  # noqa: BLE001 - an unreadable file is data
                out.append((p, None, f"{type(exc).__name__}: {exc}"))
        yield pd.DataFrame(out, columns=["path", "header", "header_error"])


def header_lines(parts: DataFrame) -> DataFrame:
    """path -> header (a JSON array of its names) of every part file; null for a
    file without one, with the error if it could not be read."""
    return parts.select("path").mapInPandas(
        _headers, "path string, header string, header_error string")


def header_profile(spark: SparkSession, root: str) -> DataFrame:
    """Historical headers through the sanitizer: (sanitized, raw, files); a drop
    of many parts counts once."""
    from vendorlake.functions.names import sanitize_col
    parts = list_parts(spark, root)
    h = header_lines(parts).filter(F.col("header").isNotNull())
    named = h.join(parts.select("path", "file_name"), "path").select(
        "file_name", F.explode(F.from_json("header", "array<string>")).alias("raw"))
    return (named.select(sanitize_col(F.col("raw")).alias("sanitized"), "raw", "file_name").distinct()
            .groupBy("sanitized", "raw").agg(F.count(F.lit(1)).alias("files"))
            .orderBy("sanitized", "raw"))


# --------------------------------------------------------------------------
# the CSV read
# --------------------------------------------------------------------------
NO_HEADER = "empty file: no header"
#: Columns the reader adds; a landed column of such a name is a collision.
READER_COLUMNS = ("_path", "_block_start", "_mid", "_source_file")


def _layouts(resolver: Resolver, required: list[str]):
    """Per file: its canonical columns (JSON), or why it is rejected."""
    def judge(name: str, header: str | None, error: str | None) -> tuple[str | None, str | None]:
        if header is None:
            return None, f"input {name} could not be read: {error}" if error else NO_HEADER
        names = [n if n.strip() else f"_c{i}" for i, n in enumerate(json.loads(header))]
        found = resolver.header(names, fold_case=True)
        missing = found.lacks(required)
        if missing:
            return None, lacking(name, missing, found.columns)
        unclear = sorted({c for c in found.columns if c.lower() in found.shared or c in READER_COLUMNS})
        if unclear:
            return None, f"input {name} has ambiguous columns {unclear} (header {names})"
        return json.dumps(found.columns), None

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            text = pdf[["file_name", "header", "header_error"]].astype(object).where(pdf.notna(), None)
            told = [judge(*row) for row in text.itertuples(index=False)]
            yield pd.DataFrame({"path": pdf["path"], "uri": [_as_uri(p) for p in pdf["path"]], "file_name": pdf["file_name"],
                                "layout": [t[0] for t in told], "reason": [t[1] for t in told]})
    return run


def _as_uri(path: str) -> str:
    """The path as Spark's file metadata spells it: escaped but for non-ASCII."""
    return "".join(c if ord(c) > 127 else quote(c, safe="/:@!$&'()*+,;=~") for c in path)


def _scan_csv(spark: SparkSession, columns: list[str], paths: list[str], multi_line: bool) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    escaped = [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in paths]       # names are no globs
    df = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
          .option("multiLine", multi_line).option("escape", '"').csv(escaped))
    return df.select(
        *[df[f"`{c.replace('`', '``')}`"] for c in columns],
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block_start"),
        F.monotonically_increasing_id().alias("_mid"),
    )


#: File names that Spark's sources pass over even when they are asked for by path.
PASSED_OVER = r"(^|/)(_[^=/]*|\.[^/]*|[^/]*\._COPYING_)$"


def _records(multi_line: bool):
    """The records of each file after its header, as text.  As for Spark's reader,
    empty lines are none, and lines of blanks are some only with ``multi_line``."""
    blank = "\n" if multi_line else None

    def of(path: str) -> Iterable[str]:
        with _open(path) as raw:
            stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
            held, header = "", True
            for line in io.TextIOWrapper(stream, "utf-8-sig", "replace"):
                held += line
                if not (multi_line and held.count('"') % 2) and held.strip(blank):
                    if not header:
                        yield held.rstrip("\n")
                    held, header = "", False
                elif not held.strip(blank):
                    held = ""
            if held.strip(blank) and not header:
                yield held.rstrip("\n")

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            for path, name in zip(pdf["path"], pdf["file_name"]):
                records = of(path)
                while some := list(itertools.islice(records, 10_000)):
                    yield pd.DataFrame({"_source_file": name, "record": some})
    return run


def _scan_passed_over(columns: list[str], files: DataFrame, multi_line: bool) -> DataFrame:
    """What ``_scan_csv`` gives, for files that Spark's reader does not see: tasks
    hand over their records, and Spark parses them as it parses a file's."""
    ddl = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    lines = files.select("path", "file_name").repartition(F.col("path")).mapInPandas(
        _records(multi_line), "_source_file string, record string")
    row = F.from_csv("record", ddl, {"mode": "PERMISSIVE", "escape": '"'})
    return lines.select(row.alias("r"), F.lit(0).cast("long").alias("_block_start"),
                        F.monotonically_increasing_id().alias("_mid"), "_source_file").select("r.*", "_block_start", "_mid", "_source_file")


def read_csv_raw(spark: SparkSession, parts: DataFrame, sanitize: bool = True,
                 aliases: Mapping[str, Iterable[str]] | None = None,
                 required: Iterable[str] | None = None,
                 multi_line: bool = False, root: str | None = None) -> tuple[DataFrame | None, DataFrame]:
    """All-string read of the part files in ``parts`` (path, file_name).

    Returns (rows, rejected).  ``rows`` carries every landed column plus
    ``_source_file`` (the drop name), ``_block_start`` and ``_mid`` (for
    record numbers); extra columns are kept, missing ones are NULL across
    layouts.  ``rejected`` (file_name, reason) lists the drops that are not
    read: unreadable or empty ones, those whose header misses a required
    column, and those where two columns come to one name.  An empty part of a
    drop that has others holds no rows and is no reason.

    ``root``: where ``list_parts`` found the parts; the drop of a row then
    comes from the row's own file path.  Without it, it is joined.
    ``multi_line`` lets quoted values hold line breaks; such files are read
    whole by one task each, so it is off unless asked for.
    """
    from vendorlake.session import materialize
    heads = materialize(
        header_lines(parts).join(parts.select("path", "file_name"), "path")
        .mapInPandas(_layouts(Resolver(sanitize, aliases), list(required or [])),
                     "path string, uri string, file_name string, layout string, reason string"), "headers")
    full = heads.filter(F.col("layout").isNotNull()).select(F.col("file_name").alias("full"), F.lit(NO_HEADER).alias("why")).distinct()
    rejected = (heads.filter(F.col("reason").isNotNull())
                .join(full, (F.col("file_name") == F.col("full")) & (F.col("reason") == F.col("why")), "left_anti")
                .groupBy("file_name").agg(F.min("reason").alias("reason")))
    usable = heads.filter(F.col("layout").isNotNull()).join(rejected.select("file_name"), "file_name", "left_anti")
    out = None
    # The distinct layouts (a handful) reach the driver, and the paths of each, as
    # arguments of the reader: the listing that Spark's own file index keeps there.
    for row in usable.select("layout").distinct().collect():
        files, columns = usable.filter(F.col("layout") == row.layout), json.loads(row.layout)
        passed_over = F.col("path").rlike(PASSED_OVER)
        paths = sorted(f.path for f in files.filter(~passed_over).select("path").collect())
        found = []
        if paths:
            df = _scan_csv(spark, columns, paths, multi_line)
            if root is None:
                df = df.join(files.select(F.col("uri").alias("_path"), F.col("file_name").alias("_source_file")), "_path").drop("_path")
            else:
                df = df.withColumn("_source_file", _source_of(F.col("_path"), root)).drop("_path")
            found.append(df)
        if not files.filter(passed_over).isEmpty():
            found.append(_scan_passed_over(columns, files.filter(passed_over), multi_line))
        for df in found:
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, rejected


def read_any(spark: SparkSession, fmt: str, path: str, **options) -> DataFrame:
    """Any other format by name (parquet, json, orc, text, csv, ...)."""
    return spark.read.format(fmt).options(**options).load(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A table another job left behind (e.g. for a consolidation job)."""
    return spark.table(name)
