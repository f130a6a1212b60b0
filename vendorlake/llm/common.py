"""Helpers shared by the training-data operators."""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vendorlake.session import shared_dir

#: A word: a run of anything but ASCII white space (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage (a lost executor costs only the running stage), fixes values
    that a recomputation could change (row ids), and gives the planner measured
    sizes.  zstd keeps the copy small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stash_path = path
    return back


def few(df: DataFrame, rows: int, per_task: int = 100_000) -> DataFrame:
    """``df`` in fewer tasks, where its number of rows (known beforehand, at most
    ``rows``) does not need as many as a shuffle has by default."""
    return df.coalesce(max(8, -(-rows // per_task)))


def discard(*frames: DataFrame) -> None:
    """Delete the written copies behind ``stash`` results no longer needed."""
    for df in frames:
        path = getattr(df, "_stash_path", None)
        if path:
            jvm = df.sparkSession._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (any case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


def utf8(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def number_within(df: DataFrame, group: str, order: Sequence[str], out: str,
                  per_bucket: int = 10_000) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... without gaps within each ``group`` (not null).

    A window over a group would put a hot group in one task.  Rows are numbered
    in hash buckets of the order columns instead (more buckets for more rows),
    and a bucket starts where the counts of the earlier buckets of its group
    end.  The buckets depend on the rows' values alone, so a recomputation
    gives the same numbers; equal rows may swap theirs.  A bucket much larger
    than the others holds a repeated key: its rows are dealt out further, by
    numbers that a written copy of the rows fixes.
    """
    b, sub, base, n, g, b2, s2, row = (fresh(df, x) for x in (
        "_bucket", "_sub", "_base", "_n", "_group", "_bucket2", "_sub2", "_row"))
    buckets = max(1024, df.count() // per_bucket)
    rows = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = rows.groupBy(F.col(group).alias(g), F.col(b).alias(b2)).agg(F.count(F.lit(1)).alias(n))
    hot = sizes.where(F.col(n) > 10 * per_bucket)
    if hot.isEmpty():
        rows = rows.withColumn(sub, F.lit(0).cast("long"))
    else:
        fixed = stash(rows.withColumn(row, F.monotonically_increasing_id()), "numbered-rows")
        rows = (fixed.join(stash(hot, "hot-buckets"), (F.col(group) == F.col(g)) & (F.col(b) == F.col(b2)), "left")
                .withColumn(sub, F.coalesce(F.pmod(F.xxhash64(row), F.ceil(F.col(n) / per_bucket)), F.lit(0)))
                .select(*df.columns, b, sub))
    counts = rows.groupBy(F.col(group).alias(g), F.col(b).alias(b2), F.col(sub).alias(s2)).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(g).orderBy(b2, s2).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(g, b2, s2, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    in_bucket = Window.partitionBy(group, b, sub).orderBy(*order)
    numbered = rows.withColumn(n, F.row_number().over(in_bucket))
    return (numbered.join(bases, (F.col(group) == F.col(g)) & (F.col(b) == F.col(b2)) & (F.col(sub) == F.col(s2)))
            .withColumn(out, F.col(base) + F.col(n) - 1)
            .select(*df.columns, out))
