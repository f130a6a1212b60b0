"""Uniqueness across batches: a sketch of the keys seen so far, beside the table.

Each batch leaves its keys and a bit map of them (rows of 4 KB, built and merged
by Spark's bitmap functions).  A new batch asks the merged bit map first: a key
with an unset bit is new, and only the few others are looked up among the stored
keys.  Those are read where they may be, but never shuffled as long as the hits
are few enough to broadcast, which is counted.

The bit map has a fixed size, 16 bits for each expected key: with as many keys
1.4 % of the new ones are looked up for nothing, with more keys more are.  The
answer is exact either way.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlake.session import materialize

_MAP = 1 << 15                           # bits of a row of the bit map
_PARTS = 64                              # folders of a batch's keys
_PROBES = 2
#: Hits that are broadcast against the stored keys; more are joined by a shuffle.
MAX_HITS = 1_000_000


class SeenKeys:
    """The keys of the batches so far, in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, expected_keys: int = 1 << 24):
        self.spark, self.path = spark, path.rstrip("/")
        self.bits = _MAP
        while self.bits < 16 * expected_keys:
            self.bits *= 2

    def _cells(self, keys: DataFrame) -> DataFrame:
        """(key, map, bit) for every probe of every key."""
        cell = F.explode(F.array(*[F.pmod(F.xxhash64("key", F.lit(i)), F.lit(self.bits)) for i in range(_PROBES)]))
        return keys.select("key", cell.alias("cell")).select(
            "key", F.floor(F.col("cell") / _MAP).alias("map"), (F.col("cell") % _MAP).alias("bit"))

    def _read(self, what: str, schema: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema(schema).parquet(f"{self.path}/{what}")

    def _keys(self, df: DataFrame, key: str) -> DataFrame:
        """(key, n) of the batch; nulls are no keys."""
        return df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))

    def add(self, df: DataFrame, key: str, batch: str) -> None:
        """Remember the keys of ``batch``; a batch that comes again replaces its own."""
        keys = materialize(self._keys(df, key).select("key", F.pmod(F.xxhash64("key"), F.lit(_PARTS)).alias("part")), "batch_keys")
        keys.repartition("part").sortWithinPartitions("part", "key").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/keys/batch={batch}")
        (self._cells(keys).groupBy("map").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
         .write.mode("overwrite").parquet(f"{self.path}/maps/batch={batch}"))

    def repeated(self, df: DataFrame, key: str, batch: str) -> DataFrame:
        """key, n, first_batch of the keys of ``df`` that fail to be unique: seen n
        times in this batch, or (first_batch) in another one before."""
        keys = materialize(self._keys(df, key), "new_keys")
        maps, old = self._read("maps", "map long, bits binary, batch string"), self._read("keys", "key string, part long, batch string")
        other = F.col("batch") != batch
        if maps is None:
            return keys.where("n > 1").withColumn("first_batch", F.lit(None).cast("string"))
        merged = maps.where(other).groupBy("map").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
        hits = (self._cells(keys).join(merged, "map").where(_bit(F.col("bits"), F.col("bit")))
                .groupBy("key").agg(F.count(F.lit(1)).alias("probes")).where(F.col("probes") == _PROBES))
        hits = materialize(hits.select("key", F.pmod(F.xxhash64("key"), F.lit(_PARTS)).alias("part")), "hits")
        wanted = F.broadcast(hits) if hits.limit(MAX_HITS + 1).count() <= MAX_HITS else hits
        before = old.where(other).join(wanted, ["part", "key"]).groupBy("key").agg(F.min("batch").alias("first_batch"))
        return keys.join(before, "key", "left").where(F.col("first_batch").isNotNull() | (F.col("n") > 1))


def _bit(bits: Column, at: Column) -> Column:
    """Whether bit ``at`` (from the lowest of the first byte on) is set."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2.0), at % 8)).cast("int") % 2 == 1
