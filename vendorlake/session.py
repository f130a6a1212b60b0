"""Session helpers.

Library functions never create a session; they take DataFrames or the caller's
``SparkSession``. ``local_session`` exists for tests and ``bench.py`` only.
"""
from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8,
                  app: str = "vendorlake") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="vendorlake-warehouse-"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for written intermediate tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir).  When
    neither is set, a local master gets a fresh temporary folder, registered so
    that ``DataFrame.checkpoint()`` works too; any other master raises, since a
    machine-local folder is not shared by its executors.
    """
    ship_package(spark)
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="vendorlake-ckpt-")
        sc.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows that one task sorts without spilling, for rows of short columns.
ROWS_PER_TASK = 250_000


def tasks_for(spark: SparkSession, rows: int, each: int = ROWS_PER_TASK) -> int:
    """Partitions for ``rows`` rows: ``each`` in one, as many as a shuffle has at least.
    A task's share then stays the same, however large the table is."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, for functions that run in them; a
    local master's workers do not have the driver's ``sys.path`` either."""
    sc = spark.sparkContext
    if getattr(sc, "_vendorlake_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="vendorlake-zip-"), "vendorlake.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("vendorlake", os.path.relpath(path, root)))
    sc.addPyFile(archive)
    sc._vendorlake_shipped = True


def materialize(df, name: str = "materialized", compression: str = "snappy"):
    """Cut lineage by writing ``df`` as a parquet table in the shared folder
    (``spark.checkpoint.dir``) and reading it back.

    Used where a plan would otherwise be computed twice (an aggregate joined
    back to its own input) and to bound recomputation after a lost executor:
    tasks downstream re-read the written files instead of replaying the
    lineage.  One columnar write - unlike ``Dataset.checkpoint``, which
    computes the plan twice - and the read-back carries real size statistics
    for AQE.  Never a local checkpoint: those die with the executor.
    ``compression``: zstd for copies whose room counts more than their time.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    back = spark.read.parquet(path)
    back._written = path
    return back


def discard(*frames) -> None:
    """Delete the written copies behind ``materialize`` results (or any frame with
    such a ``_written`` path) that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_written", None)
        if path:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a statement go when it ends, not when the driver's
    garbage is next collected.  (A frame that is run again shuffles again.)"""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
