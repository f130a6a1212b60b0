"""Operator 9: repeated passages through a compacted De Bruijn graph of words.

Runs of ``span`` words are the edges of the graph.  An edge that occurs twice is
repeated; consecutive edges that always occur together lie on a nonbranching
path and compact into one.  Paths are put back on their source coordinates, and
every word that a repeated edge covers goes.

Most edges occur once, so they are sifted first: a run of ``span`` words always
holds the least hash of its 8-word runs, its seed, and equal runs have equal
seeds.  Only runs whose seed occurs twice are listed.  The sift is a bit map of
bounded size; wrong hits cost time, never results.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendorlake.llm import sift, textops
from vendorlake.llm.common import discard, stash, utf8

SPAN = 35
SEED = 8
_OTHER = np.uint64(0x5851F42D4C957F2D)


def _seeds(words: textops.Words, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each run, its hash, place of its seed, hash of its seed)."""
    at, edge = words.windows(span)
    if not len(at):
        return at, edge, at, edge
    small = textops.rolling(words.hashes, SEED)
    views = np.lib.stride_tricks.sliding_window_view(small, span - SEED + 1)
    place = at + views.argmin(axis=1)[at]
    return at, edge, place, small[place]


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _first_pass(span: int):
    """Per text: number of words, digest of all words, hashes of the seeds in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in textops.pieces(batch.column("text")):
                words = textops.Words(texts)
                _, _, place, _ = _seeds(words, span)
                place = np.unique(place)
                small = textops.rolling(words.hashes, SEED)
                ends = np.searchsorted(place, words.first).astype(np.int32)
                digests = [_digest((t.as_py() or "").encode().split()) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("tkey").slice(first, len(texts)), pa.array(words.counts, pa.int64()),
                     pa.array(digests, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(small[place].view(np.int64)))],
                    names=["tkey", "n_words", "whole", "seeds"])
    return run


def _listed(span: int, shared: Broadcast):
    """Per text with sifted runs: their places, hashes and check hashes, and the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for first, texts in textops.pieces(batch.column("text")):
                words = textops.Words(texts)
                at, edge, _, seed = _seeds(words, span)
                hit = sift.passes(bits, seed.view(np.int64))
                at, edge = at[hit], edge[hit]
                check = textops.rolling(textops.mix(words.hashes ^ _OTHER), span)[at] if len(at) else edge
                ends = np.searchsorted(at, words.first)
                some = np.flatnonzero(np.diff(ends) > 0)
                starts = at - np.repeat(words.first[:-1], np.diff(ends))
                cuts = pa.array(np.concatenate([[0], ends[some + 1]]).astype(np.int32))   # texts between have no runs
                yield pa.RecordBatch.from_arrays(
                    [batch.column("tkey").slice(first, len(texts)).take(pa.array(some)),
                     pa.ListArray.from_arrays(cuts, pa.array(starts.astype(np.int32))),
                     pa.ListArray.from_arrays(cuts, pa.array(edge.view(np.int64))),
                     pa.ListArray.from_arrays(cuts, pa.array(check.astype(np.uint32).view(np.int32))),
                     pa.array([squeeze(texts[int(i)].as_py().encode()) for i in some], pa.binary())],
                    names=["tkey", "place", "edge", "check", "body"])
    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tkey, body, spans): the words on the spans go."""
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        removed, digests = [], []
        for body, spans in zip(batch.column("body"), batch.column("spans")):
            words, kept, next_word = expand(body.as_py()).split(), [], 0
            for span in spans.as_py():                     # by first word; neighbours overlap
                kept += words[next_word:span["first_word"]]
                next_word = max(next_word, span["last_word"] + 1)
            kept += words[next_word:]
            removed.append(len(words) - len(kept))
            digests.append(_digest(kept))
        yield pa.RecordBatch.from_arrays(
            [batch.column("tkey"), pa.array(removed, pa.int64()), pa.array(digests, pa.binary())],
            names=["tkey", "removed", "digest"])


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(utf8(text)))


class Repeats:
    """The repeated runs of a corpus; every table is at the level of distinct texts.

    texts: tkey, copies, n_words, whole; listed: tid, tkey, place, edge, check,
    body; edges: edge, check, n, in_one, out_one (whether all its occurrences
    follow, or are followed by, one and the same listed edge).
    """

    def __init__(self, docs: DataFrame, text: str = "text", span: int = SPAN):
        if span <= SEED:
            raise ValueError(f"span must exceed {SEED} words")
        self.span = span
        spark = docs.sparkSession
        rows = docs.select(_text_key(F.col(text)).alias("tkey"), F.col(text).alias("text"))
        first = rows.mapInArrow(_first_pass(span), "tkey binary, n_words bigint, whole binary, seeds array<bigint>")
        self.texts = stash(first.groupBy("tkey").agg(
            F.count(F.lit(1)).alias("copies"), F.first(F.struct("n_words", "whole", "seeds")).alias("x"))
            .select("tkey", "copies", "x.*"), "texts")
        seeds = stash(self.texts.select(F.explode("seeds").alias("seed")).groupBy("seed")
                      .agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed"), "seeds")
        bits = spark.sparkContext.broadcast(sift.build(seeds, "seed", seeds.count()))
        discard(seeds)
        self.listed = stash(
            rows.mapInArrow(_listed(span, bits), "tkey binary, place array<int>, edge array<bigint>, check array<int>, body binary")
            .dropDuplicates(["tkey"]).withColumn("tid", F.monotonically_increasing_id()), "listed")
        bits.unpersist()

    def occurrences(self) -> DataFrame:
        """(tid, place, edge, check, prev, next): neighbours are 0 where not listed."""
        def beside(i: Column, by: int) -> Column:
            there = F.get("place", i + by) == F.get("place", i) + by
            return F.when(there, F.get("edge", i + by)).otherwise(0)

        each = F.transform("place", lambda p, i: F.struct(
            p.alias("place"), F.get("edge", i).alias("edge"), F.get("check", i).alias("check"),
            beside(i, -1).alias("prev"), beside(i, 1).alias("next")))
        return self.listed.select("tid", F.explode(each).alias("x")).select("tid", "x.*")

    def edges(self) -> DataFrame:
        def mark(c: str) -> Column:                  # 16 bits tell neighbours apart well enough
            return F.col(c).bitwiseAND(F.lit(0xFFFF)).cast("int")

        both = F.shiftleft(mark("prev"), 16).bitwiseOR(mark("next"))
        counted = (self.occurrences().select("edge", "check", both.alias("both")).groupBy("edge", "check")
                   .agg(F.count(F.lit(1)).alias("n"), F.bit_and("both").alias("all"), F.bit_or("both").alias("any")).where("n > 1"))
        differ = F.col("all").bitwiseXOR(F.col("any"))
        return counted.select("edge", "check", "n", (F.shiftrightunsigned(differ, 16) == 0).alias("in_one"),
                              (differ.bitwiseAND(F.lit(0xFFFF)) == 0).alias("out_one"))

    def paths(self) -> DataFrame:
        """(tid, spans): the compacted paths on their source texts; a span has path,
        n (occurrences of its first edge), first_word and last_word.

        The join with the repeated edges puts them back on their places; a run
        continues the path of the run before it where all occurrences of both do
        so.  A path is named by its first edge; its occurrences cover equal words.
        """
        edges = stash(self.edges(), "edges")
        there = self.occurrences().select("tid", "place", "edge", "check").join(edges, ["edge", "check"])
        runs = there.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct(
            "place", "edge", "n", "in_one", "out_one"))).alias("runs"))

        def begins(x: Column, i: Column) -> Column:
            before = F.get("runs", i - 1)
            goes_on = (before["place"] == x["place"] - 1) & before["out_one"] & x["in_one"]
            return F.coalesce(~goes_on, F.lit(True))

        heads = F.filter(F.transform("runs", lambda x, i: F.struct(
            x["edge"].alias("path"), x["n"].alias("n"), x["place"].alias("first"), i.alias("i"), begins(x, i).alias("head"))),
            lambda x: x["head"])
        span = F.transform("heads", lambda h, j: F.struct(
            h["path"].alias("path"), h["n"].alias("n"), h["first"].alias("first_word"),
            (F.get("runs", F.coalesce(F.get("heads", j + 1)["i"], F.size("runs")) - 1)["place"] + (self.span - 1)).alias("last_word")))
        return stash(runs.withColumn("heads", heads).select("tid", span.alias("spans")), "paths")

    def spans(self) -> DataFrame:
        """(tkey, path, n, first_word, last_word): where each repeated passage stands."""
        return (self.paths().select("tid", F.inline("spans")).join(self.listed.select("tid", "tkey"), "tid").drop("tid"))

    def removals(self) -> DataFrame:
        """(tkey, n_words, n_removed, kept_sha256) of every distinct text: the words
        on its spans go.  A text that several rows hold is repeated throughout.
        """
        cut = (self.listed.select("tid", "tkey", "body").join(self.paths(), "tid").select("tkey", "body", "spans")
               .mapInArrow(_remove, "tkey binary, removed bigint, digest binary"))
        texts = self.texts.select("tkey", "copies", "n_words", "whole").join(stash(cut, "cut"), "tkey", "left")
        all_gone = (F.col("copies") > 1) & (F.col("n_words") >= self.span)
        return stash(texts.select(
            "tkey", "n_words",
            F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
            F.when(all_gone, F.sha2(F.lit(b""), 256)).otherwise(
                F.lower(F.hex(F.coalesce("digest", "whole")))).alias("kept_sha256")), "removals")


def removal_report(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row.

    A word goes if it lies in a run of ``span`` words of its document that also
    starts elsewhere, in this document or another.  Null texts and texts without
    words: no words, nothing removed.  Repeated rows count as elsewhere.  Null
    keys are kept.  An empty table gives no rows.
    """
    done = Repeats(docs, text, span).removals()
    rows = docs.select(F.col(key).alias("doc_id"), _text_key(F.col(text)).alias("tkey"))
    return rows.join(done, "tkey").select("doc_id", "n_words", "n_removed", "kept_sha256")
