"""Landed tables that later joins and aggregations read without a shuffle.

A table is bucketed and sorted by its key when it is written - the one shuffle -
and partitioned by source file, so that a file that comes again replaces its own
rows and nothing else (dynamic partition overwrite).  What groups or joins by the
key afterwards reads whole buckets: two tables with the same key and number of
buckets join without an exchange.

A bucket is written and read by one task; take enough buckets for the table's
size.  Rows of one hot key share a bucket: they stream through its sort.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlake.operators.settlement import LIFECYCLE_KEY

BUCKETS = 64
_OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def _quoted(names: Sequence[str]) -> str:
    return ", ".join(f"`{n}`" for n in names)


def land_bucketed(df: DataFrame, table: str, key: Sequence[str], buckets: int = BUCKETS,
                  per: str | None = "_source_file", location: str | None = None) -> DataFrame:
    """Write ``df`` into ``table`` (made when it is missing), replacing the rows of
    the ``per`` values that ``df`` has, or the whole table without ``per``; returns
    the table.

    Rows need a ``per`` value.  An existing table keeps its key and buckets; a
    column it does not have is an error, one that ``df`` lacks is null."""
    spark = df.sparkSession
    if "." in table:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {table.split('.')[0]}")
    if per is None:
        writer = (df.repartition(buckets, *[F.col(f"`{k}`") for k in key]).write.mode("overwrite").format("parquet")
                  .bucketBy(buckets, *key).sortBy(*key))
        (writer.option("path", location) if location else writer).saveAsTable(table)
        return spark.table(table)
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != per)
        where = f" LOCATION '{location}'" if location else ""
        spark.sql(f"CREATE TABLE {table} ({columns}, `{per}` string) USING parquet PARTITIONED BY (`{per}`) "
                  f"CLUSTERED BY ({_quoted(key)}) SORTED BY ({_quoted(key)}) INTO {buckets} BUCKETS{where}")
    kept = spark.table(table)
    unknown = sorted(set(df.columns) - set(kept.columns))
    if unknown:
        raise ValueError(f"{table} has no columns {unknown}")
    key, buckets = _layout(spark, table)
    rows = df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in kept.columns])
    before = spark.conf.get(_OVERWRITE)
    spark.conf.set(_OVERWRITE, "dynamic")                  # insertInto takes no options
    try:
        # the hash that bucketing uses: every bucket comes from one task
        rows.repartition(buckets, *[F.col(f"`{k}`") for k in key]).write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(_OVERWRITE, before)
    spark.catalog.refreshTable(table)
    return spark.table(table)


def _layout(spark: SparkSession, table: str) -> tuple[list[str], int]:
    """Key and number of buckets of a table."""
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    return [c.strip("` ") for c in told["Bucket Columns"].strip("[]").split(",")], int(told["Num Buckets"])


def dedupe_landed(records: DataFrame) -> DataFrame:
    """``settlement.dedupe_orders`` for a table bucketed by the lifecycle key: the
    first record by (file, line) runs, later twins are ``is_duplicate``.  Landed
    records have whole keys; rows with a null in theirs are no twins."""
    twins = (records.groupBy(*LIFECYCLE_KEY)
             .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_source_file", "_line")).alias("_first")).where("_n > 1"))
    first = twins.select(*[F.col(c).alias(f"_{c}") for c in LIFECYCLE_KEY], "_first")
    same = reduce(and_, (F.col(c) == F.col(f"_{c}") for c in LIFECYCLE_KEY))
    return (records.join(first, same, "left").drop(*[f"_{c}" for c in LIFECYCLE_KEY])
            .withColumn("is_duplicate", F.coalesce(F.col("_first") != F.struct("_source_file", "_line"), F.lit(False)))
            .drop("_first"))
