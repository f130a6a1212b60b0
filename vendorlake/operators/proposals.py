"""Pre-filled aliases: which canonical column a vendor's header stands for.

Headers and canonical names are compared by the trigrams they share (Jaccard, in
thousandths); a header that abbreviates a name - the same first letter, its letters
in the name's order, like ``rgn`` for ``region`` - scores ABBREVIATION at least.
The assignment is one to one within a group (a drop and its entity): the best pair
of all first, then the best of what is left, found as mutual best pairs in rounds
over all groups at once.  A group has as many rows as its headers times its
columns; nothing else is compared.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendorlake.session import materialize

LEAST, ABBREVIATION = 200, 600


def trigrams(name: Column) -> Column:
    """The distinct trigrams of a name with two blanks before and one after."""
    padded = F.concat(F.lit("  "), name, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def similarity(header: Column, canonical: Column) -> Column:
    """0 to 1000, for sanitized names."""
    a, b = trigrams(header), trigrams(canonical)
    shared = F.floor(F.size(F.array_intersect(a, b)) * 1000 / F.size(F.array_union(a, b))).cast("int")
    pattern = F.concat(F.lit("^"), F.regexp_replace(header, "([0-9a-z])", "$1[0-9a-z_]*"))
    short = (F.length(header) >= 2) & F.regexp_like(canonical, pattern)
    return F.when(header == canonical, 1000).when(short, F.greatest(shared, F.lit(ABBREVIATION))).otherwise(shared)


def propose(headers: DataFrame, columns: Mapping[str, Sequence[str]], least: int = LEAST) -> DataFrame:
    """headers (group, entity, header - sanitized) -> group, entity, header,
    canonical, score; headers below ``least`` with every column get no row.

    Ties go to the lesser canonical name, then header.  Repeated headers count
    once, null and empty ones not at all."""
    spark = headers.sparkSession
    names = spark.createDataFrame([(e, c) for e, cs in columns.items() for c in cs], "entity string, canonical string")
    pairs = (headers.where(F.length("header") > 0).select("group", "entity", "header").distinct()
             .join(F.broadcast(names), "entity")                 # the declared columns
             .withColumn("score", similarity(F.col("header"), F.col("canonical"))).where(F.col("score") >= least))
    pairs = materialize(pairs, "name_pairs")
    rounds, chosen = max(map(len, columns.values()), default=0), None
    order = [F.desc("score"), F.asc("canonical"), F.asc("header")]
    for _ in range(rounds):                                      # each takes the best pair of every group, at least
        of_header, of_column = (F.row_number().over(Window.partitionBy("group", "entity", c).orderBy(*order)) for c in ("header", "canonical"))
        best = materialize(pairs.withColumn("_h", of_header).withColumn("_c", of_column).where("_h = 1 and _c = 1").drop("_h", "_c"), "proposals")
        if best.isEmpty():
            break
        chosen = best if chosen is None else chosen.unionByName(best)
        for c in ("header", "canonical"):
            pairs = pairs.join(best.select("group", "entity", c), ["group", "entity", c], "left_anti")
        pairs = materialize(pairs, "name_pairs")
    return (chosen if chosen is not None else pairs).select("group", "entity", "header", "canonical", "score")


def alias_table(proposals: DataFrame) -> DataFrame:
    """entity, canonical, header, groups, score: the aliases worth declaring (headers
    that are not canonical already) and how many groups propose each."""
    return (proposals.where(F.col("header") != F.col("canonical")).groupBy("entity", "canonical", "header")
            .agg(F.count(F.lit(1)).alias("groups"), F.max("score").alias("score")))
