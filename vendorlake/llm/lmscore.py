"""Operator 6: language-model scores from a log-frequency Bloom filter.

The filter holds, for every word and word pair of the training texts, its count
on a log scale: an n-gram of quantised count q is a member q times, as (n-gram,
1) to (n-gram, q), so probing levels until the first miss gives the count back.
It is built in segments by the tasks, each sized to its own members, and
broadcast to the workers that score.

Single-word probabilities are exact: the counts of the frequent words are
broadcast (a bounded table), the rare rest is joined.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendorlake.llm import textops
from vendorlake.llm.common import discard, stash

SEGMENT_BITS = 12                       # of a 64-bit n-gram hash; the rest tells n-grams of a segment apart
BITS_PER_ENTRY, PROBES = 10, 5          # about 1 % wrong hits per probe level
#: Words whose counts are broadcast: at most 8 MB.
HEAD_WORDS = 500_000
#: Filters above this are broadcast in parts, one scoring pass each.
MAX_FILTER_BYTES = 256 << 20
#: Weight of the single-word model, in occurrences of the context.
MU = 100.0
_COUNTED, _SCORED_AT_ONCE = 16 << 20, 4 << 20       # bytes of text; more at once means fewer rows

_U = np.uint64
_START, _END = _U(0x243F6A8885A308D3), _U(0x13198A2E03707344)
_LOW = _U(64 - SEGMENT_BITS)


def _segment(context: np.ndarray) -> np.ndarray:
    return textops.mix(context ^ _U(0xA4093822299F31D0)) >> _LOW << _LOW


def gram1(word: np.ndarray) -> np.ndarray:
    """n-gram hash of a word as a context."""
    return _segment(word) | textops.mix(word ^ _U(0x082EFA98EC4E6C89)) >> _U(SEGMENT_BITS)


def gram2(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """n-gram hash of a pair; in the segment of its context."""
    return _segment(context) | textops.mix(context * _U(0x9E3779B97F4A7C15) + word) >> _U(SEGMENT_BITS)


class Tokens:
    """Words in lower case and one end per text: hash, the hash before it (or the
    start), the word number (-1: end) and the text of each token."""

    def __init__(self, texts: pa.Array):
        words = textops.Words(texts, lower=True)
        n = len(words.counts)
        self.words, self.counts = words, words.counts + 1
        self.owner = np.repeat(np.arange(n), self.counts)
        ends = np.cumsum(self.counts) - 1
        self.is_end = np.zeros(len(self.owner), bool)
        self.is_end[ends] = True
        self.word = np.full(len(self.owner), -1, np.int64)
        self.word[~self.is_end] = np.arange(len(words.hashes))
        self.hash = np.full(len(self.owner), _END, _U)
        self.hash[~self.is_end] = words.hashes
        self.before = np.empty_like(self.hash)
        self.before[1:] = self.hash[:-1]
        self.before[ends + 1 - self.counts] = _START


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in textops.pieces(batch.column(0), _COUNTED):
            tokens = Tokens(texts)
            h, at, n = np.unique(tokens.hash, return_index=True, return_counts=True)
            w, raw = tokens.words, tokens.words.data
            names = [raw[w.starts[i]:w.ends[i]].tobytes() if i >= 0 else b"" for i in tokens.word[at]]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(n.astype(np.int64))], names=["word", "n"])


def _word_hashes(words: pa.Array) -> np.ndarray:
    """The token hash of each word; the empty one is the end."""
    tokens = textops.Words(words)
    out = np.full(len(words), _END, _U)
    out[tokens.counts > 0] = tokens.hashes
    return out


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_word_hashes(batch.column("word")).view(np.int64)), batch.column("n")],
                                         names=["hash", "n"])


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in textops.pieces(batch.column(0), _COUNTED):
            tokens = Tokens(texts)
            grams = np.concatenate([gram2(tokens.before, tokens.hash), np.repeat(gram1(np.array([_START])), len(texts))])
            g, n = np.unique(grams, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])


def _context_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        g = gram1(_word_hashes(batch.column("word")))
        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), batch.column("n")], names=["gram", "n"])


def level(counts: np.ndarray) -> np.ndarray:
    """Quantised count: 1 for 1, 2 for 2 and 3, 3 for 4 to 7, ..."""
    return np.frexp(counts.astype(np.float64))[1]


def estimate(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 for level 0."""
    return np.where(levels > 0, (2.0 ** (levels - 1) + 2.0 ** levels - 1) / 2, 0.0)


def _places(grams: np.ndarray, q: int, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """The bits of (n-gram, q) in a segment of so many bits, one array per probe."""
    h = textops.mix(grams + _U(q * 0xD1B54A32D192ED03 % 2 ** 64))
    step = textops.mix(h) | _U(1)
    for _ in range(PROBES):
        yield h % sizes
        h = h + step


def build_segment(grams: np.ndarray, counts: np.ndarray) -> bytes:
    q = level(counts)
    size = _U(max(64, -(-int(q.sum()) * BITS_PER_ENTRY // 8) * 8))
    bits = np.zeros(int(size), bool)
    for j in range(1, int(q.max()) + 1):
        for place in _places(grams[q >= j], j, size):
            bits[place.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment, bits) from rows (gram, n) sorted by unsigned n-gram hash within a segment."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        g, n = (np.concatenate(x) for x in zip(*held))
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        bits = build_segment(g[first], np.add.reduceat(n, first))
        return pa.RecordBatch.from_arrays([pa.array([int(g[0] >> _LOW)], pa.int32()), pa.array([bits], pa.binary())],
                                          names=["segment", "bits"])

    for batch in batches:
        g, n = batch.column("gram").to_numpy().view(_U), batch.column("n").to_numpy()
        seg = g >> _LOW
        cuts = [0, *(np.flatnonzero(seg[1:] != seg[:-1]) + 1).tolist(), len(g)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                if held and held[-1][0][-1] >> _LOW != seg[a]:
                    yield flush()
                    held = []
                held.append((g[a:b], n[a:b]))
    if held:
        yield flush()


class Filter:
    """Some segments of the filter, side by side in one byte array.  ``owned``:
    the segments whose contexts this part scores, those without members too."""

    def __init__(self, sizes: dict[int, int], segments, owned: np.ndarray):
        """``sizes``: the bytes of each segment; ``segments``: (segment, bits) in turn."""
        self.owned = owned
        self.first = np.full(1 << SEGMENT_BITS, -1, np.int64)
        self.size = np.ones(1 << SEGMENT_BITS, _U)
        self.bits = np.zeros(sum(sizes.values()), np.uint8)
        at = 0
        for s, n in sizes.items():
            self.first[s], self.size[s] = at, n * 8
            at += n
        for s, bits in segments:                     # one copy of the whole filter, no more
            self.bits[self.first[s]:self.first[s] + len(bits)] = np.frombuffer(bits, np.uint8)

    def owns(self, grams: np.ndarray) -> np.ndarray:
        return self.owned[(grams >> _LOW).astype(np.int64)]

    def count(self, grams: np.ndarray) -> np.ndarray:
        """Estimated counts, by probing levels until the first miss."""
        distinct, back = np.unique(grams, return_inverse=True)
        seg = (distinct >> _LOW).astype(np.int64)
        first, size = self.first[seg], self.size[seg]
        levels = np.zeros(len(distinct), np.int64)
        alive = np.flatnonzero(first >= 0)
        q = 0
        while len(alive):
            q += 1
            g, f, m = distinct[alive], first[alive], size[alive]
            hit = np.ones(len(alive), bool)
            for place in _places(g, q, m):
                place = place.astype(np.int64)
                hit &= (self.bits[f + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 > 0
            alive = alive[hit]
            levels[alive] = q
        return estimate(levels)[back]


class Model:
    """Counts of the training texts; ``words``: word, n (the end: empty)."""

    def __init__(self, train: DataFrame, text: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES,
                 head_words: int = HEAD_WORDS):
        texts = train.select(F.col(text).alias("text"))
        self.words = stash(texts.mapInArrow(_count_words, "word binary, n bigint")
                           .groupBy("word").agg(F.sum("n").alias("n")), "words")
        row = self.words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.tokens, self.vocabulary = int(row.n or 0), int(row.v)
        self.head = self._head(head_words)
        grams = texts.mapInArrow(_count_pairs, "gram bigint, n bigint").union(
            self.words.select("word", "n").mapInArrow(_context_grams, "gram bigint, n bigint"))
        self.segments = stash(
            grams.repartition(F.shiftrightunsigned("gram", 64 - SEGMENT_BITS)).sortWithinPartitions("gram")
            .mapInArrow(_build, "segment int, bits binary"), "filter")
        self.max_filter_bytes = max_filter_bytes

    def _head(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and counts of the words above the least count that at most ``most`` words reach."""
        tally = self.words.groupBy("n").count()
        by_count = tally.orderBy(F.desc("n")).limit(most).toPandas()
        total = by_count["count"].cumsum()
        fits = by_count["n"][total <= most]
        least = int(fits.min()) if len(fits) else 2 ** 62
        rows = self.words.where(F.col("n") >= least).select("word", "n").mapInArrow(_hashes, "hash bigint, n bigint").toArrow()
        hashes, counts = (rows.column(i).to_numpy() for i in range(2))
        order = np.argsort(hashes)
        return hashes[order], counts[order]

    def layout(self) -> tuple[list[dict[int, int]], np.ndarray]:
        """The segments (and their bytes) of each part of the filter, parts being
        of bounded size, and the part of each segment.  One part, unless the
        filter is very large."""
        sizes = self.segments.select("segment", F.octet_length("bits").alias("n")).orderBy("segment").collect()
        parts: list[dict[int, int]] = [{}]
        part_of = np.zeros(1 << SEGMENT_BITS, np.int64)
        for row in sizes:                            # a number per segment
            if parts[-1] and sum(parts[-1].values()) + row.n > self.max_filter_bytes:
                parts.append({})
            parts[-1][row.segment] = row.n
            part_of[row.segment] = len(parts) - 1
        return parts, part_of

    def part(self, sizes: dict[int, int], owned: np.ndarray) -> Filter:
        rows = self.segments.where(F.col("segment").between(min(sizes, default=0), max(sizes, default=0)))
        return Filter(sizes, ((r.segment, r.bits) for r in rows.toLocalIterator()), owned)


def _score(shared: Broadcast, first_part: bool, total: int, mu: float):
    """Per text: tokens and known ones, sums over the frequent words, and the rare
    words with their pair weight and word weight, for the join.

    Every part scores the tokens whose context it owns; the first also does what
    needs no filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, head_n = shared.value
        for batch in batches:
            for at, texts in textops.pieces(batch.column("text"), _SCORED_AT_ONCE):
                t, n = Tokens(texts), len(texts)
                key = t.hash.view(np.int64)
                frequent, c = np.zeros(len(key), bool), np.zeros(len(key), np.int64)
                if len(head):
                    where = np.minimum(np.searchsorted(head, key), len(head) - 1)
                    frequent = head[where] == key
                    c = np.where(frequent, head_n[where], 0)
                pair = gram2(t.before, t.hash)
                ours = part.owns(pair)
                context = part.count(gram1(t.before))
                seen = np.minimum(part.count(pair), context) / (context + mu)
                rest = mu / (context + mu)
                p = (c + 1) / total

                def by_text(values: np.ndarray, which: np.ndarray) -> np.ndarray:
                    return np.bincount(t.owner[which], values[which], minlength=n).astype(np.float64)

                once = frequent & first_part
                rare = np.flatnonzero(~frequent & (ours | first_part))
                ends = np.searchsorted(t.owner[rare], np.arange(n + 1)).astype(np.int32)
                w = t.words
                names = [w.data[w.starts[i]:w.ends[i]].tobytes() if i >= 0 else b"" for i in t.word[rare]]
                tail = pa.StructArray.from_arrays(
                    [pa.array(names, pa.binary()), pa.array(np.full(len(rare), first_part)), pa.array(ours[rare]),
                     pa.array(seen[rare]), pa.array(rest[rare])], names=["word", "base", "ours", "seen", "rest"])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(at, n) for c in _KEPT), pa.array(t.counts * int(first_part), pa.int64()),
                     pa.array(by_text(np.ones(len(key)), once & (c > 0)).astype(np.int64)),
                     pa.array(by_text(np.log10(p), once), pa.float64()),
                     pa.array(by_text(np.log10(seen + rest * p), frequent & ours), pa.float64()),
                     pa.ListArray.from_arrays(pa.array(ends), tail)],
                    names=[*_KEPT, "n_tokens", "known", "base", "score", "tail"])
    return run


_KEPT = ("rid", "doc_id", "held_out")
_SCORED = ("rid bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, score double, "
           "tail array<struct<word: binary, base: boolean, ours: boolean, seen: double, rest: double>>")


def score_rows(rows: DataFrame, model: Model, mu: float = MU) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of rows (doc_id,
    held_out, text).

    The probability of a word after its context is (pair count + mu p(word)) /
    (context count + mu), the counts from the filter, p(word) exact with one
    added to each count.
    """
    sc = rows.sparkSession.sparkContext
    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    parts, part_of = model.layout()
    if len(parts) > 1:                               # several passes need one numbering
        rows = stash(rows, "rows")
    total = model.tokens + model.vocabulary + 1
    scored = None
    for i, sizes in enumerate(parts):
        shared = sc.broadcast((model.part(sizes, part_of == i), *model.head))
        one = stash(rows.mapInArrow(_score(shared, i == 0, total, mu), _SCORED), "scored")
        shared.unpersist()
        scored = one if scored is None else scored.unionByName(one)
    c = F.coalesce("n", F.lit(0))
    p = (c + 1) / float(total)
    rare = (scored.select("rid", F.inline("tail")).join(model.words, "word", "left")
            .groupBy("rid").agg(
                F.sum((F.col("base") & (c > 0)).cast("long")).alias("known2"),
                F.sum(F.when(F.col("base"), F.log10(p)).otherwise(0.0)).alias("base2"),
                F.sum(F.when(F.col("ours"), F.log10(F.col("seen") + F.col("rest") * p)).otherwise(0.0)).alias("score2")))
    sums = scored.drop("tail")
    if len(parts) > 1:
        sums = sums.groupBy(*_KEPT).agg(*[F.sum(x).alias(x) for x in ("n_tokens", "known", "base", "score")])
    return sums.join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("base2", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("score2", F.lit(0.0))).alias("score"))


def held_out(key: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether a row is kept from training: crc32 of the key as text; null is ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", mu: float = MU,
                    max_filter_bytes: int = MAX_FILTER_BYTES, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row;
    the model learns from the rows that are not held out.

    Null texts are empty: one token, the end.  Null keys count as the key ''.
    Repeated rows are learned from and scored each.  Without training rows all
    counts are 0.  An empty table gives no rows.
    """
    out = held_out(F.col(key))
    model = Model(docs.where(~out), text, max_filter_bytes, head_words)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), out.alias("held_out"), F.col(text).alias("text"))
    scores = score_rows(rows, model, mu)
    discard(model.segments)
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
                         "base_score", "score")
