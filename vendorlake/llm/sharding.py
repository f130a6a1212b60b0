"""Operator 10: rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair has a pseudo-random score that depends on nothing else;
a record goes to its best shard.  A new shard can only win records, so a change
of the shard count moves the fewest records.  Built-in functions only.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendorlake.llm.common import fresh, number_within, stash, utf8


def _bid(key: Column, shard: int, weight: float, salt: int) -> Column:
    """(score, shard): -ln(u) / weight with u uniform in (0, 1); the least wins."""
    h = F.shiftrightunsigned(F.xxhash64(key, F.lit(salt), F.lit(shard)), 11)
    u = (h.cast("double") + 0.5) / float(2 ** 53)
    return F.struct((-F.log(u) / float(weight)).alias("score"), F.lit(shard).alias("shard"))


def best_bid(key: Column, weights: Mapping[int, float], salt: int = 0) -> Column:
    if not weights or min(weights.values()) <= 0:
        raise ValueError("shards need positive weights")
    stable = F.coalesce(key.cast("string"), F.lit("\x00null"))
    return F.array_min(F.array(*[_bid(stable, s, w, salt) for s, w in sorted(weights.items())]))


def shard_of(key: Column, weights: Mapping[int, float], salt: int = 0) -> Column:
    """The shard of ``key``: in proportion to the weights, one hash per shard.

    A null key is a key of its own; equal keys share a shard.
    """
    return best_bid(key, weights, salt)["shard"]


def shard_table(df: DataFrame, key: str, weights: Mapping[int, float], salt: int = 0,
                text: str = "text", grown: Mapping[int, float] | None = None) -> DataFrame:
    """One row per record: key, size (UTF-8 bytes of the text + 8), text_crc32,
    shard, slot (place in the shard, gapless from 0) and grown_shard (the shard
    once the shards in ``grown`` have joined).

    Null text has size 8; null keys form one key; repeated rows get a slot each;
    an empty table gives no rows; other columns of the table play no part.
    Only the narrow columns are shuffled, never the texts.
    """
    k = F.col(key)
    mine = best_bid(k, weights, salt)
    rows = df.select(
        k.alias("doc_id"),
        (F.octet_length(utf8(F.col(text))) + 8).cast("long").alias("size"),
        F.crc32(utf8(F.col(text))).alias("text_crc32"),
        mine.alias("best"),
        (F.least(mine, best_bid(k, grown, salt)) if grown else F.lit(None)).alias("more"),
    ).select("doc_id", "size", "text_crc32", F.col("best.shard").alias("shard"),
             (F.col("more.shard") if grown else F.lit(None).cast("int")).alias("grown_shard"))
    rows = stash(rows, "shards")
    return number_within(rows, "shard", ["doc_id", "text_crc32", "size"], "slot")
