"""Landing hygiene: header sanitizing, semantic aliases, column contracts.

All three act on the schema only (``toDF`` renames are free in Catalyst), so
they add nothing to the physical plan.  ``land_table`` is the one write.
"""
from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from vendorlake.functions.names import sanitize_header

# Columns that carry lineage and are never renamed by hygiene.
LINEAGE_COLUMNS = ("_source_file", "_line", "_block_start", "_row_in_block")


class ContractError(ValueError):
    """A deterministic, non-retryable rejection of an input."""


@dataclass(frozen=True)
class Header:
    """A header as the library reads it: the column each name stands for, and the
    columns that several names stand for (column -> those names)."""

    columns: tuple[str, ...]
    shared: Mapping[str, tuple[str, ...]]

    def lacks(self, required: Iterable[str]) -> list[str]:
        return [c for c in required if c not in self.columns]


class Resolver:
    """Finds the canonical column of each name of a header.

    A name that several canonical columns claim goes to the one declared last;
    one that none claims stays.  Lineage columns are never touched."""

    def __init__(self, sanitize: bool = True, aliases: Mapping[str, Iterable[str]] | None = None):
        self.sanitize = sanitize
        claims = [(canonical, frozenset(sanitize_header(v) for v in variants)) for canonical, variants in (aliases or {}).items()]
        self.claims = claims[::-1]                      # the last claim is asked first

    def column(self, name: str) -> str:
        if name in LINEAGE_COLUMNS:
            return name
        clean = sanitize_header(name) if self.sanitize else name
        return next((canonical for canonical, variants in self.claims if clean in variants), clean)

    def header(self, names: Iterable[str], fold_case: bool = False) -> Header:
        """``fold_case``: columns that differ by case only are one, as Spark's are."""
        names = list(names)
        columns = tuple(map(self.column, names))
        sources: dict[str, list[str]] = {}
        for name, column in zip(names, columns):
            sources.setdefault(column.lower() if fold_case else column, []).append(name)
        return Header(columns, {c: tuple(n) for c, n in sources.items() if len(n) > 1})


def sanitize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*Resolver().header(df.columns).columns)


def alias_columns(df: DataFrame, aliases: Mapping[str, Iterable[str]]) -> DataFrame:
    """Variants take their canonical names; two columns that come to one name are
    a deterministic rejection."""
    header = Resolver(False, aliases).header(df.columns)
    if header.shared:
        raise ContractError(f"ambiguous columns {sorted(header.shared)} (from {df.columns})")
    return df.toDF(*header.columns)


def lacking(source: str, missing: Iterable[str], columns: Iterable[str]) -> str:
    """Why an input breaks its contract."""
    return f"{source} lacks required columns {list(missing)}; its columns are {list(columns)}"


def column_contract(df: DataFrame, required: Iterable[str], source: str = "input") -> DataFrame:
    """Return ``df`` unchanged if every required column exists, else raise."""
    landed = tuple(c for c in df.columns if c not in LINEAGE_COLUMNS)
    missing = Header(tuple(df.columns), {}).lacks(required)
    if missing:
        raise ContractError(lacking(source, missing, landed))
    return df


def apply_hygiene(df: DataFrame, sanitize: bool = True,
                  aliases: Mapping[str, Iterable[str]] | None = None,
                  required: Iterable[str] | None = None, source: str = "input") -> DataFrame:
    if sanitize:
        df = sanitize_headers(df)
    if aliases:
        df = alias_columns(df, aliases)
    if required:
        df = column_contract(df, required, source)
    return df


def land_table(df: DataFrame, table: str, path: str | None = None,
               fmt: str = "parquet") -> DataFrame:
    """Overwrite a table (database created if needed) and return it re-read.

    Without a catalog of its own (``fmt`` parquet) the table is external, at
    ``path`` or else at a version of its own in the warehouse folder: frames that
    still read the version before keep working, older versions are deleted.
    """
    spark = df.sparkSession
    if "." in table:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {table.split('.')[0]}")
    writer = df.write.mode("overwrite").format(fmt)
    home = None
    if path is None and fmt == "parquet":
        home = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{table.replace('.', '.db/')}"
        path = f"{home}/v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    if home:
        _drop_versions(spark, home, keep=2)
    return spark.table(table)


def _drop_versions(spark: SparkSession, home: str, keep: int) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(home)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("v")), key=lambda p: p.getName())
    for old in found[:-keep]:
        files.delete(old, True)
