"""A landing zone of vendor drops, written by Spark from the driver's tables.

Used to exercise the file operators (discovery, gzip audit, header-signature
read, contracts, quarantine, streaming) on data that grows with the tables.
Each drop is a directory in partitioned layout (``_drop=<drop name>/part-*``) with
one file, as a vendor sends it, joined from runs that Spark's CSV writer wrote.

Drops (all derived from the tables):

* ``orders_<year>.csv``       raw orders; 1997 drops use a reordered header,
                              1998 drops lack the Amount column (contract)
* ``customers_<region>.csv``  raw customers with vendor header spellings
* ``payments_<year>.csv.gz``  gzip-compressed payments
* ``vendor_orders_<yyyy>.csv``vendor order files for the settlement batch
* ``zz_pages.csv``            unroutable pages (quarantined: no route)
* ``documents_<lang>.csv.gz`` named .gz but not gzip (quarantined: bad gzip)
"""
from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlake.session import ROWS_PER_TASK, discard, scratch_path, shuffles_freed, tasks_for
from vendorlake.sources import adapters as A
from vendorlake.sources.files import _local, _open, list_parts

DROP = "_drop"

ORDERS_HEADER = ("Order ID", "Customer", "Order Date", "Amount", "Status")
ORDERS_HEADER_REORDERED = ("Customer", "Order ID", "Status", "Amount", "Order Date")
ORDERS_HEADER_NO_AMOUNT = ("Order ID", "Customer", "Order Date", "Status")


def _join_runs(root: str):
    """One file per drop from its runs, in the order of their names.  Bytes are
    streamed, so that no task sorts or holds a whole drop; where the drop is an
    archive (``packed``), the runs become its members."""
    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        from pyarrow import fs
        for pdf in batches:
            for name, paths, header, packed in zip(pdf["file_name"], pdf["paths"], pdf["header"].str.encode("utf-8"), pdf["packed"]):
                folder = f"{root}/{DROP}={name}"
                local = _local(folder)
                filesystem, p = (fs.LocalFileSystem(), local) if local else fs.FileSystem.from_uri(quote(folder, safe="/:@"))
                filesystem.create_dir(p, recursive=True)
                unfinished = f"{p}/.{uuid.uuid4().hex}"
                with filesystem.open_output_stream(unfinished, compression=None) as out:
                    out.write(gzip.compress(header) if packed else header)
                    for path in paths:
                        with _open(path) as raw:
                            src = raw if packed else gzip.GzipFile(fileobj=raw)
                            while chunk := src.read(8 * 1024 ** 2):
                                out.write(chunk)
                filesystem.move(unfinished, f"{p}/part-00000.csv{'.gz' if packed else ''}")
            yield pdf[["file_name"]]
    return run


#: Rows of pages and documents, whole texts, that one task sorts.
TEXTS_PER_TASK = 20_000


@dataclass(frozen=True)
class Drops:
    """Where the rows of a table go: the drop of a row, archives or not, and the tasks
    that sort them."""

    name: Column
    packed: bool
    tasks: int


def _write(df: DataFrame, drops: Drops) -> DataFrame:
    """The rows of each drop, sorted so that record numbers are reproducible, as runs
    (ranges of the rows, gzip) that ``drops.tasks`` tasks sort and write: (file_name, paths,
    header) of every drop."""
    cols = df.columns
    runs = scratch_path(df.sparkSession, "landing-runs")
    (df.withColumn(DROP, drops.name)
     .repartitionByRange(drops.tasks, DROP, *cols[:5])
     .sortWithinPartitions(DROP, *cols[:5])
     .write.partitionBy(DROP)
     .option("header", False).option("compression", "gzip").option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(runs))
    listed = (list_parts(df.sparkSession, runs).groupBy("file_name")
              .agg(F.array_sort(F.collect_list("path")).alias("paths"))
              .withColumn("header", F.lit(",".join(cols) + "\n")))
    listed._written = runs
    return listed


def write_landing(spark: SparkSession, sf_dir: str, root: str | None = None) -> str:
    """Table by table: the runs of one go before those of the next are written."""
    root = root or scratch_path(spark, "landing")
    with shuffles_freed(spark):
        _write_landing(spark, sf_dir, root)
    return root


def _write_landing(spark: SparkSession, sf_dir: str, root: str) -> None:
    def land(df: DataFrame, drop: Column, table: str, packed: bool = False, each: int = ROWS_PER_TASK) -> None:
        tasks = tasks_for(spark, A.read_table(spark, sf_dir, table).count(), each)
        runs = _write(df, Drops(drop, packed, tasks))
        joined = runs.withColumn("packed", F.lit(packed)).repartition(64, "file_name").mapInPandas(_join_runs(root), "file_name string")
        joined.write.format("noop").mode("overwrite").save()
        discard(runs)

    orders = A.raw_orders(spark, sf_dir)
    year = F.substring(F.col("Order Date"), 1, 4)
    for chosen, header in ((~year.isin("1997", "1998"), ORDERS_HEADER), (year == "1997", ORDERS_HEADER_REORDERED),
                           (year == "1998", ORDERS_HEADER_NO_AMOUNT)):
        land(orders.filter(chosen).select(*header), F.concat(F.lit("orders_"), year, F.lit(".csv")), "orders")
    customers = A.raw_customers(spark, sf_dir)
    land(customers.select("Cust", "Seg", "RGN"),
         F.concat(F.lit("customers_"), F.lower(F.regexp_replace("RGN", "[^A-Za-z]", "")), F.lit(".csv")), "customer")
    payments = A.raw_payments(spark, sf_dir)
    land(payments.select("Payment ID", "Order ID", "Paid Amount", "Paid Date"),
         F.concat(F.lit("payments_"), F.substring(F.col("Paid Date"), 1, 4), F.lit(".csv.gz")), "lineitem", packed=True)
    vendor = A.raw_vendor_orders(spark, sf_dir, numbered=False)
    land(vendor.select("order_ref", "vendor", "item_count", "submitted_amount", "batch_id"),
         F.concat(F.lit("vendor_orders_"), F.substring(F.col("batch_id"), 7, 4), F.lit(".csv")), "lineitem")
    land(A.read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), F.lit("zz_pages.csv"),
         "pages", each=TEXTS_PER_TASK)
    docs = A.read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text")
    # plain text under a .gz name: the audit must catch it
    land(docs, F.concat(F.lit("documents_"), F.col("lang"), F.lit(".csv.gz")), "documents", each=TEXTS_PER_TASK)
