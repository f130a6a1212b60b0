"""Operator 11: the prefix trie of conversations.

Every conversation becomes rows of BLOCK positional turn-id columns.  Spark SQL
``ROLLUP`` over these columns aggregates all prefixes of a block together;
``grouping_id`` tells their depth.  A conversation that still shares its prefix
with another at the end of a block goes on in the next one, keyed by the least
member of its node; one that is alone has a chain of nodes of its own from there
on, which needs no grouping.  A second ``ROLLUP``, over the shared nodes of a
block and from the last block to the first, adds up subtrees.

A turn id is 128 bits of SHA-256 of role and text, and the text's code points.
Turns are numbered after a range sort, and a conversation that spans several
sorted parts is continued from part to part, so a long one is no single task's.
The ids that end at a node are joined in ranges of 10,000 ids; a node with
several ranges is hashed by streaming them in order, in constant memory (SHA-256
has no other way).
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendorlake.llm.common import stash

BLOCK = 8                                # turn columns of a ROLLUP
SHARED, HEADS = 100, 6                   # conversations of one root; at most HEADS - 1 turns come from it
_RANGE = 10_000
_NARROW = "conv_id bigint, turn bigint, tid binary"
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes of hash, then the text's code points in 4."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    hashed = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.unhex(F.concat(F.substring(hashed, 1, 32), F.lpad(F.hex(F.length(text)), 8, "0")))


def _chars(tid: Column) -> Column:
    return F.conv(F.substring(F.hex(tid), 33, 8), 16, 10).cast("long")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place of each row among those of its conversation in this sorted part."""
    last, seen = None, 0
    for batch in batches:
        conv = batch.column("conv_id").to_numpy()
        if not len(conv):
            continue
        first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        place = np.arange(len(conv)) - np.repeat(first, np.diff(np.r_[first, len(conv)]))
        if conv[0] == last:
            place[:first[1] if len(first) > 1 else len(conv)] += seen
        last, seen = conv[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("conv_id"), pa.array(place + 1), batch.column("tid")],
                                         names=["part", "conv_id", "place", "tid"])


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, p, tid): p = 1, 2, ... in the order of turn (null first), then tid.

    After a range sort a conversation lies in consecutive parts; what it has in
    the earlier ones is a count of at most one row for each part but the last."""
    rows = turns.withColumn("_at", F.monotonically_increasing_id())       # parts repeated rows
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("tid"), F.col("_at")]
    parts = (rows.repartitionByRange(*order).sortWithinPartitions(*order)
             .select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "tid"))
    placed = stash(parts.mapInArrow(_number, "part bigint, conv_id bigint, place bigint, tid binary"), "numbered")
    edges = placed.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "place")).alias("last"))
    held = edges.select("part", F.col("last.conv_id").alias("conv_id"), F.col("last.place").alias("n")).unionByName(
        edges.where("first < last.conv_id").select("part", F.col("first").alias("conv_id"), F.lit(0).cast("long").alias("n")))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.withColumn("before", F.sum("n").over(earlier)).where("before > 0").select("part", "conv_id", "before")
    return placed.join(F.broadcast(before), ["part", "conv_id"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("p"), "tid")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, p, tid), (conv_id, n)): every conversation begins with the first h
    turns of the conversation conv_id - conv_id % SHARED and goes on with its own
    turns after its first h."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h")
    convs = placed.groupBy("conv_id").agg(F.max("p").alias("own")).select(
        "conv_id", "own", h, (F.col("conv_id") - F.col("conv_id") % SHARED).alias("root"))
    roots = convs.where("conv_id = root").select("root", F.col("own").alias("has"))
    convs = convs.join(roots, "root", "left").withColumn("head", F.least("h", F.coalesce("has", F.lit(0))))
    convs = stash(convs.select("conv_id", "root", "h", "head", (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")),
                  "conversations")
    starts = placed.where((F.col("p") < HEADS) & (F.col("conv_id") % SHARED == 0)).select(F.col("conv_id").alias("root"), "p", "tid")
    heads = convs.where("head > 0").select("conv_id", "root", "head").join(starts, "root").where("p <= head").select("conv_id", "p", "tid")
    tails = (placed.where(F.col("p") > h).join(convs.select("conv_id", "h", "head"), "conv_id")
             .select("conv_id", (F.col("p") - F.col("h") + F.col("head")).alias("p"), "tid"))
    return heads.unionByName(tails), convs.select("conv_id", "n")


def _path(at: Column, turns: list[Column]) -> Column:
    """A key of the prefix ``turns`` (null: no more) below the node ``at``."""
    tids = [F.coalesce(F.hex(t), F.lit("")) for t in turns]
    return F.unhex(F.substring(F.sha2(F.concat_ws(":", at.cast("string"), F.concat(*tids) if tids else F.lit("")), 256), 1, 32))


def _rollup(rows: DataFrame, width: int, sums: str) -> DataFrame:
    """``sums`` of the rows (at, t1, ..., t``width``) for every prefix below every
    node ``at``: columns at, t1, ..., level (the columns that the prefix has)."""
    cols = ", ".join(f"t{i}" for i in range(1, width + 1))
    level = f"{width} - bit_count(grouping_id())"
    got = rows.sparkSession.sql(f"SELECT at, {cols}, {level} AS level, {sums} FROM {{rows}} "
                                f"GROUP BY at, ROLLUP({cols})", rows=rows)
    last = F.coalesce(*[F.when(F.col("level") == i, F.col(f"t{i}").isNotNull()) for i in range(1, width + 1)], F.lit(True))
    return got.where(last)                           # a shorter prefix stands in its own level only


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined ids of each path, from ranges in order."""
    now, digest = None, None
    for batch in batches:
        for path, ids in zip(batch.column("path").to_pylist(), batch.column("ids").to_pylist()):
            if path != now:
                if now is not None:
                    yield _digest(now, digest)
                now, digest = path, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if now is not None:
        yield _digest(now, digest)


def _digest(path: bytes, digest) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([digest.hexdigest()])], names=["path", "ends"])


def ends_hash(members: DataFrame) -> DataFrame:
    """(path, ends): the hash of the ids (path, conv_id), ascending and comma-joined."""
    ranges = stash(members.groupBy("path", F.floor(F.col("conv_id") / _RANGE).alias("range")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")), "ends")
    sizes = ranges.groupBy("path").agg(F.count(F.lit(1)).alias("ranges"), F.min("ids").alias("ids"))
    one = sizes.where("ranges = 1").select("path", F.sha2("ids", 256).alias("ends"))
    many = ranges.join(sizes.where("ranges > 1").select("path"), "path", "left_semi")
    return one.unionByName(many.repartition("path").sortWithinPartitions("path", "range")
                           .mapInArrow(_stream, "path binary, ends string"))


def _t(width: int) -> list[Column]:
    return [F.col(f"t{i}") for i in range(1, width + 1)]


def _nodes(rows: DataFrame, block: int, width: int) -> DataFrame:
    """The nodes below the block's roots, from its members (at, conv_id, n, t1, ...)."""
    t = _t(width)
    got = _rollup(rows, width, "count(*) AS n_convs, min(conv_id) AS conv_id, max(n) AS longest")
    at = [F.when(F.col("level") >= i, t[i - 1]) for i in range(1, width + 1)]
    up = [F.when(F.col("level") > i, t[i - 1]) for i in range(1, width + 1)]
    last = F.coalesce(*[F.when(F.col("level") == i, t[i - 1]) for i in range(1, width + 1)])
    return got.select("at", *t, "level", "n_convs", "conv_id", "longest", (F.col("level") + block * width).alias("depth"),
                      _path(F.col("at"), at).alias("path"), _path(F.col("at"), up).alias("up"), _chars(last).alias("chars"))


def trie(turns: DataFrame, width: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 per node, from rows (conv_id, turn, role, text).

    Rows without conv_id belong to no conversation.  Null roles and texts are
    empty.  Equal turn numbers go by the hash of role and text; repeated rows are
    turns of their own.  % keeps the sign of conv_id.  An empty table has no nodes,
    not even a root.
    """
    narrow = stash(turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        turn_id(F.col("role"), F.col("text")).alias("tid")), "turns")
    every, convs = rebuilt(numbered(narrow))
    t = _t(width)
    block_of = F.floor((F.col("p") - 1) / width).cast("int").alias("block")
    wide = stash(every.groupBy("conv_id", block_of).agg(
        *[F.max(F.when((F.col("p") - 1) % width == i, F.col("tid"))).alias(f"t{i + 1}") for i in range(width)])
        .repartitionByRange("block", "conv_id").sortWithinPartitions("block"), "blocks")
    least, many = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    if not many:
        return turns.sparkSession.createDataFrame([], _SCHEMA)
    members = convs.join(wide.where("block = 0").drop("block"), "conv_id", "left").withColumn("at", F.lit(least))
    levels, alone = [], None
    while True:
        block = len(levels)
        members = stash(members.select("at", "conv_id", "n", *t), "members")
        nodes = stash(_nodes(members, block, width), "nodes")
        levels.append((members, nodes))
        full = members.where(F.col("n") > (block + 1) * width).select("conv_id", "n", _path(F.col("at"), t).alias("path"))
        ends = nodes.where((F.col("level") == width) & (F.col("longest") > F.col("depth"))).select("path", "n_convs", F.col("conv_id").alias("at"))
        going = stash(full.join(ends, "path").select("conv_id", "n", "at", "n_convs"), "going")
        lone = going.where("n_convs = 1").select("conv_id", "n", F.lit(block + 1).alias("since"))
        alone = lone if alone is None else alone.unionByName(lone)
        shared = going.where("n_convs > 1").drop("n_convs")
        if not shared.take(1):
            break
        members = shared.join(wide.where(F.col("block") == block + 1).drop("block"), "conv_id")
    out = _chains(wide, alone, width)
    below = None                                     # of the next block, by root: children, leaves, saved tokens
    for block in reversed(range(len(levels))):
        members, nodes = levels[block]
        done, below = _finish(members, nodes, below, block, width)
        out = out.unionByName(done)
    return out


_SCHEMA = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
           "saved_tokens bigint, ends_sha256 string")


def _ends_of_one() -> Column:
    return F.sha2(F.col("conv_id").cast("string"), 256)


def _chains(wide: DataFrame, alone: DataFrame, width: int) -> DataFrame:
    """The nodes of conversations that are alone since a block, from there on."""
    rows = wide.join(alone, "conv_id").where(F.col("block") >= F.col("since"))
    each = rows.select("conv_id", "n", F.explode(F.expr(
        f"sequence(block * {width} + 1L, least(n, (block + 1L) * {width}))")).alias("depth"))
    return each.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
                       (F.col("depth") < F.col("n")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
                       F.lit(0).cast("long").alias("saved_tokens"),
                       F.when(F.col("depth") < F.col("n"), F.lit(_EMPTY)).otherwise(_ends_of_one()).alias("ends_sha256"))


def _finish(members: DataFrame, nodes: DataFrame, below: DataFrame | None, block: int, width: int) -> tuple[DataFrame, DataFrame]:
    """The rows of a block's nodes, and its sums by root for the block before.

    A node of one conversation has one leaf below it and saves nothing, so only
    shared nodes are summed; the others count as leaves of the node they hang on."""
    t, many = _t(width), F.col("n_convs") > 1
    parents = nodes.where(many & (F.col("level") > 0)).select(F.col("path").alias("up"), F.col("conv_id").alias("above"))
    under = nodes.where("level > 0").join(parents, "up", "left").withColumn(
        "parent_conv_id", F.when(F.col("level") == 1, F.col("at")).otherwise(F.coalesce("above", "conv_id")))
    kids = (nodes.where("level > 0").groupBy("up").agg(F.count(F.lit(1)).alias("kids"), F.count_if(~many).alias("lone"))
            .withColumnRenamed("up", "path"))
    shared = nodes.where(many | (F.col("level") == 0)).join(kids, "path", "left")
    if below is not None:
        end = shared.where(F.col("level") == width).drop("kids", "lone").join(below, "conv_id", "left")
        shared = shared.where(F.col("level") < width).withColumn("leaves", F.lit(0).cast("long")).withColumn(
            "saved", F.lit(0).cast("long")).unionByName(end)
    else:
        shared = shared.withColumn("leaves", F.lit(0).cast("long")).withColumn("saved", F.lit(0).cast("long"))
    none = F.lit(0).cast("long")
    own = shared.withColumn("kids", F.coalesce("kids", none)).withColumn("lone", F.coalesce("lone", none)).select(
        "at", *[F.when(F.col("level") >= i, t[i - 1]).alias(f"t{i}") for i in range(1, width + 1)], "path", "kids", "lone",
        (F.coalesce("leaves", none) + F.col("lone") + (F.col("kids") == 0).cast("long")).alias("leaves"),
        (F.coalesce("saved", none) + F.coalesce((F.col("n_convs") - 1) * F.col("chars"), none)).alias("saved"))
    own = stash(own, "own")
    subtree = _rollup(own.select("at", *t, "leaves", "saved"), width, "sum(leaves) AS n_leaves, sum(saved) AS saved_tokens")
    subtree = stash(subtree.select("level", "at", _path(F.col("at"), t).alias("path"), "n_leaves", "saved_tokens"), "subtree")
    in_block = (F.col("n") > block * width) & (F.col("n") <= (block + 1) * width) | (F.col("n") == 0)
    ended = ends_hash(members.where(in_block).select("conv_id", _path(F.col("at"), t).alias("path")))
    sums = own.select("path", "kids").join(subtree.select("path", "n_leaves", "saved_tokens"), "path").join(ended, "path", "left")
    root = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    several = (under.where(many).select("path", "conv_id", "depth", "parent_conv_id", "n_convs")
               .unionByName(root.select("path", "conv_id", "depth", "parent_conv_id", "n_convs"))
               .join(sums, "path").select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("kids").alias("n_children"),
                                          "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256")))
    more = F.col("longest") > F.col("depth")
    single = under.where(~many).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", more.cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        none.alias("saved_tokens"), F.when(more, F.lit(_EMPTY)).otherwise(_ends_of_one()).alias("ends_sha256"))
    every = several.unionByName(single).withColumn("depth", F.col("depth").cast("long"))
    # a later block's root is the last node of the block before, which takes these as its own
    roots = own.join(subtree.where("level = 0").select("path", "n_leaves", "saved_tokens"), "path").select(
        F.col("at").alias("conv_id"), "kids", none.alias("lone"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    return every, roots
