"""Operator 7: near-duplicate documents by MinHash.

Documents with equal shingle sets collapse into one class.  Classes get 128
universal hash minima, cut into 32 bands of 4; classes that share a band are
candidates, checked by signature and then on the full sets; the links are
joined into components by alternating large-star and small-star.

A bucket of n classes never becomes n^2 pairs: all are compared with its least
member.  Buckets that then still hold several components are joined into
clusters, and a cluster is checked block against block: the exact sizes of all
common sets come from products of 0/1 matrices inside a task, which sends on
only the links that join components.  So no component is lost, and no pairs are
written that link nothing.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlake.llm import textops
from vendorlake.llm.common import discard, fresh, stash, utf8
from vendorlake.llm.components import components

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(0, 2 ** 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2 ** 63, HASHES, np.uint64)
#: Texts of a cluster that are checked against as many others in one task.
BLOCK = 1000
_COLUMNS = 4096


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text, A-Z in
    lower case; a text of fewer words is one shingle, one without words has none."""
    words = textops.Words(texts, lower=True)
    at, h = words.windows(k)
    cuts = np.searchsorted(at, words.first)
    out = [np.unique(h[cuts[i]:cuts[i + 1]]) for i in range(len(texts))]
    for i in np.flatnonzero((words.counts < k) & (words.counts > 0)):
        own = words.hashes[words.first[i]:words.first[i + 1]]
        out[i] = textops.rolling(own, len(own))
    return out


def signature(shingles: np.ndarray) -> bytes:
    low = np.full(HASHES, 2 ** 32 - 1, np.uint64)
    for i in range(0, len(shingles), 1024):
        block = (shingles[i:i + 1024, None] * _A + _B) >> np.uint64(32)
        np.minimum(low, block.min(axis=0), out=low)
    return low.astype("<u4").tobytes()


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in textops.pieces(batch.column("text")):
                sets = shingle_sets(texts, k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(at, len(texts)) for i in range(3)] +
                    [pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                     pa.array([signature(s) if len(s) else None for s in sets], pa.binary())],
                    names=["rid", "doc_id", "tkey", "n", "set_key", "sig"])
    return run


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([squeeze((t.as_py() or "").encode()) for t in batch.column(1)], pa.binary())],
            names=["node", "body"])


def _verify(k: int, percent: int):
    """Rows (a, b, body_a, body_b): those whose full sets reach the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress

        def shingles(body: bytes) -> np.ndarray:
            return shingle_sets(pa.array([expand(body).decode()], pa.large_string()), k)[0]

        last, last_set = None, None
        for batch in batches:
            ok = []
            for a, body_a, body_b in zip(batch.column("a").to_pylist(), batch.column("body_a"), batch.column("body_b")):
                if a != last:
                    last, last_set = a, shingles(body_a.as_py())
                other = shingles(body_b.as_py())
                both = len(last_set) + len(other) - len(np.union1d(last_set, other))
                ok.append(100 * both >= percent * (len(last_set) + len(other) - both))
            keep = batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
            yield keep
    return run


def _similar_signatures(least: int):
    @F.pandas_udf("boolean")
    def similar(a, b):
        import pandas as pd
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s), "<u4").reshape(len(s), HASHES) for s in (a, b))
        return pd.Series((x == y).sum(axis=1) >= least)
    return similar


def _classes(signed: DataFrame) -> DataFrame:
    """One row per distinct shingle set; node: the least row id."""
    return stash(signed.where("n > 0").groupBy("set_key").agg(
        F.min("rid").alias("node"), F.min("doc_id").alias("doc_id"),
        F.min_by(F.struct("tkey", "n", "sig"), F.col("rid")).alias("x"))
        .select("set_key", "node", "doc_id", "x.*"), "classes")


def _bucket_members(classes: DataFrame) -> DataFrame:
    """(bucket, node, n) of the buckets with two classes or more."""
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * 4 * ROWS + 1, 4 * ROWS)) for i in range(BANDS)])
    rows = classes.select("node", "n", F.explode(bands).alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket")
    return stash(rows.join(shared, "bucket").select("bucket", "node", "n"), "members")


def _bodies(docs: DataFrame, text: str, classes: DataFrame, members: DataFrame) -> DataFrame:
    """(node, compressed text) of the classes in ``members``; any row with the text will do."""
    wanted = classes.select("node", "tkey").join(members.select("node").distinct(), "node")
    texts = docs.select(F.unhex(F.md5(utf8(F.col(text)))).alias("tkey"), F.col(text).alias("text"))
    one = texts.dropDuplicates(["tkey"])
    return stash(one.join(wanted, "tkey").select("node", "text")
                 .mapInArrow(_compress, "node bigint, body binary"), "bodies")


def _links(pairs: DataFrame, classes: DataFrame, bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """The distinct pairs (a, b) that are similar, by signature and then by set."""
    p = percent / 100
    least = max(1, int(HASHES * p - 5 * (HASHES * p * (1 - p)) ** 0.5))   # five deviations below
    sig = classes.select("node", "sig")
    checked = (pairs.join(sig.toDF("b", "sig_b"), "b").join(sig.toDF("a", "sig_a"), "a")
               .where(_similar_signatures(least)("sig_a", "sig_b")).select("a", "b"))
    full = checked.join(bodies.toDF("b", "body_b"), "b").join(bodies.toDF("a", "body_a"), "a")
    return stash(full.select("a", "b", "body_a", "body_b").mapInArrow(_verify(k, percent), "a bigint, b bigint"), "links")


def _near_lengths(percent: int, x: str, y: str):
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _star_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Each class of a bucket with the bucket's least class."""
    leads = stash(members.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("lead")), "leads")
    return stash(members.join(leads, "bucket")
                 .where((F.col("node") != F.col("lead.node")) & _near_lengths(percent, "n", "lead.n"))
                 .select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct(), "pairs")


def _clusters(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, component, cluster, block, blocks) of the classes in buckets with
    several components; components that share such a bucket share a cluster."""
    now = stash(members.join(labels, "node", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("component")), "now")
    several = stash(now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
                    .where("lo <> hi"), "open")
    left = stash(now.join(several.select("bucket", "lo"), "bucket").select("node", "component", "lo").distinct(), "left")
    clusters = stash(components(left, "lo", "component").toDF("component", "cluster"), "clusters")
    nodes = stash(left.select("node", "component").distinct().join(clusters, "component"), "nodes")
    sizes = stash(nodes.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "sizes")
    discard(now, several)
    return nodes.join(sizes, "cluster").select(
        "node", "component", "cluster", F.pmod(F.xxhash64("node"), "blocks").alias("block"), "blocks")


def common_sizes(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The number of common values of each set in x with each in y, exactly."""
    flat_x, flat_y = (np.concatenate(s) if s else np.zeros(0, np.uint64) for s in (x, y))
    row_x, row_y = (np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (x, y))
    shared = np.intersect1d(flat_x, flat_y)
    out = np.zeros((len(x), len(y)), np.float32)         # counts below 2**24 are exact; longer sets use float64
    if max(map(len, x + y), default=0) >= 1 << 24:
        out = out.astype(np.float64)
    for lo in range(0, len(shared), _COLUMNS):
        part = shared[lo:lo + _COLUMNS]

        def dense(flat: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[at] == flat
            m = np.zeros((n, len(part)), out.dtype)
            m[row[hit], at[hit]] = 1
            return m

        out += dense(flat_x, row_x, len(x)) @ dense(flat_y, row_y, len(y)).T
    return out


def _joining_links(nodes: list[int], components_: list[int], blocks: list[int], sets: list[np.ndarray],
                   percent: int) -> list[tuple[int, int]]:
    """Links between different components of a pair of blocks (or one), as few as join them."""
    first = [i for i in range(len(nodes)) if blocks[i] == blocks[0]]
    second = [i for i in range(len(nodes)) if blocks[i] != blocks[0]] or first
    both = common_sizes([sets[i] for i in first], [sets[i] for i in second])
    size_x, size_y = (np.array([len(sets[i]) for i in s], np.float64) for s in (first, second))
    label = np.array(components_)
    similar = (100 * both >= percent * (size_x[:, None] + size_y[None, :] - both)) & \
        (label[first][:, None] != label[second][None, :])
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(similar)):
        a, b = find(components_[first[i]]), find(components_[second[j]])
        if a != b:
            root[a] = b
            out.append((nodes[first[i]], nodes[second[j]]))
    return out


def _check_blocks(k: int, percent: int):
    """Rows (cluster, i, j, node, component, block, body), the rows of a pair of
    blocks one after another: the links that join components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        now, held = None, []

        def flush() -> pa.RecordBatch:
            nodes, labels, blocks, sets = (list(x) for x in zip(*held))
            links = _joining_links(nodes, labels, blocks, sets, percent) if len(set(labels)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in range(2)], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            values = zip(*(batch.column(i).to_pylist() for i in range(3, 6)))
            for key, value, body in zip(keys, values, batch.column("body")):
                if key != now:
                    if held:
                        yield flush()
                    now, held = key, []
                text = pa.array([expand(body.as_py()).decode()], pa.large_string())
                held.append((*value, shingle_sets(text, k)[0]))
        if held:
            yield flush()
    return run


def _cluster_links(clusters: DataFrame, bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links between the components of a cluster, from all pairs of its blocks."""
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    rows = clusters.select("cluster", F.explode(pairs).alias("p"), "node", "component", "block").join(bodies, "node")
    key = ["cluster", "i", "j"]
    return (rows.select("cluster", "p.i", "p.j", "node", "component", "block", "body")
            .repartition(*key).sortWithinPartitions(*key, "block")
            .mapInArrow(_check_blocks(k, percent), "a bigint, b bigint"))


def _labels(members: DataFrame, classes: DataFrame, bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of the linked nodes."""
    links = _links(_star_pairs(members, percent), classes, bodies, k, percent)
    labels = stash(components(links), "labels")
    more = _cluster_links(_clusters(members, labels), bodies, k, percent)
    # components that the clusters join: links between links
    return stash(components(links.union(stash(more, "more"))), "labels")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5,
                    percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row; also component, an internal
    label (null without words), and tkey, the MD5 of the text.

    Rows whose shingle sets have a Jaccard similarity of ``percent`` or more are
    linked; component_id is the least key reachable.  Null or wordless texts are
    linked with nothing.  Null keys: a component without any key has a null id.
    Rows that repeat a key and its text share a component.  An empty table
    gives no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("doc_id"),
                       F.unhex(F.md5(utf8(F.col(text)))).alias("tkey"), F.col(text).alias("text"))
    signed = stash(rows.mapInArrow(
        _sign(k), "rid bigint, doc_id bigint, tkey binary, n bigint, set_key binary, sig binary"), "signed")
    classes = _classes(signed)
    members = _bucket_members(classes)
    bodies = _bodies(docs, text, classes, members)
    labels = _labels(members, classes, bodies, k, percent)
    discard(bodies, members)
    labelled = stash(classes.select("set_key", "node", "doc_id").join(labels, "node", "left")
                     .withColumn("component", F.coalesce("component", "node")), "labelled")
    ids = stash(labelled.groupBy("component").agg(F.min("doc_id").alias("component_id")), "ids")
    by_class = stash(labelled.join(ids, "component").select("set_key", "component", "component_id"), "by-class")
    narrow = signed.select("doc_id", "tkey", "n", "set_key")
    linked = narrow.where("n > 0").join(by_class, "set_key").select("doc_id", "tkey", "n", "component", "component_id")
    out = linked.union(narrow.where("n = 0").select(
        "doc_id", "tkey", "n", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
                      "component", "tkey")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5,
                         percent: int = 80) -> DataFrame:
    """One document of each component (of those with the least key, the least
    text hash), with its columns as they were.  Documents without words stay."""
    found = near_duplicates(docs, key, text, k, percent)
    kt, tt, k2, t2 = (fresh(docs, x) for x in ("_key", "_tkey", "_key2", "_tkey2"))
    marked = (docs.withColumn(kt, F.coalesce(F.col(key).cast("long"), F.lit(2 ** 63 - 1)))
              .withColumn(tt, F.unhex(F.md5(utf8(F.col(text))))))
    wordless = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    stay = stash(found.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(
        F.coalesce("doc_id", F.lit(2 ** 63 - 1)).alias(k2), F.col("tkey").alias(t2))).alias("x")).select("x.*"), "stay")
    one = (marked.where(~wordless).join(stay, (F.col(kt) == F.col(k2)) & (F.col(tt) == F.col(t2)), "left_semi")
           .dropDuplicates([kt, tt]))
    return one.select(*docs.columns).unionByName(docs.where(wordless))
