"""Operator 12: language identification by multinomial naive Bayes.

The features of a text are its character 1-, 2- and 3-grams, hashed to buckets:
letters in lower case, any other character a blank, one blank around the text,
grams without a letter left out.  Tasks add up the grams of each language as one
vector; the sums become a matrix of log probabilities, which is broadcast (64
languages at a time, 16 MB; more languages take more passes).  Texts are scored
as sparse rows in coordinate form: the buckets that occur, gathered from the
matrix and added by text.

Log probabilities are whole multiples of 2**-20 and their sums are exact, so a
text's result does not depend on how rows fall into partitions or batches.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlake.llm import textops, vectors
from vendorlake.llm.common import discard, stash
from vendorlake.llm.lmscore import held_out

BUCKET_BITS = 16
LONGEST = 3                              # characters in a gram
ALPHA = 0.5                              # added to every count
LANGS_AT_ONCE = 64                       # languages in a broadcast matrix, or in the vectors of a task
NONE = "und"
FOLDS, FOLD = 5, 0                       # documents kept from training
_SCALE = 1 << 20
_CUT = 1 << 20                           # characters handled at once
_U = np.uint64


@lru_cache(1)
def _symbols() -> np.ndarray:
    """Per code point: its lower case if it is a letter, else 0 (no letters lie above)."""
    out = np.zeros(0x33000, np.uint32)
    for i in range(len(out)):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _some(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """(text number, characters) of pieces, about _CUT characters at once; the
    pieces of a long text overlap by LONGEST - 1."""
    owners, held, size = [], [], 0
    for i, text in enumerate(texts):
        text = f"\0{text or ''}\0"
        for a in range(0, len(text), _CUT):
            owners.append(i)
            held.append(text[a:a + _CUT + LONGEST - 1])
            size += len(held[-1])
            if size >= _CUT:
                yield owners, held
                owners, held, size = [], [], 0
    if held:
        yield owners, held


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every gram of the texts, some at a time."""
    table = _symbols()
    for owners, held in _some(texts):
        codes = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], 0).astype(_U)
        sizes = np.array([len(x) for x in held])
        ends = np.cumsum(sizes)
        piece = np.repeat(np.arange(len(held)), sizes)
        owner = np.array(owners)[piece]
        left = ends[piece] - np.arange(len(codes))             # characters from here to the end of the piece
        ours = sizes[piece] - left < _CUT                      # not the overlap with the next piece
        value, letters = np.zeros(len(codes), _U), np.zeros(len(codes), bool)
        for n in range(1, LONGEST + 1):
            m = max(len(codes) - n + 1, 0)
            value = value[:m] * _U(0x110000) + symbols[n - 1:n - 1 + m]
            letters = letters[:m] | (symbols[n - 1:n - 1 + m] > 0)
            at = np.flatnonzero(letters & ours[:m] & (left[:m] >= n))
            hashed = textops.mix(value[at] + _U(n << 60)) >> _U(64 - BUCKET_BITS)
            yield owner[at], hashed.astype(np.int64)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language: the grams of its texts by bucket, and last the texts with a letter."""
    width = 1 << BUCKET_BITS
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for at, texts in textops.pieces(batch.column("text")):
            langs = batch.column("lang").slice(at, len(texts)).to_pylist()
            names = sorted(set(langs))
            if len(sums) + len(names) > LANGS_AT_ONCE:
                for name, vector in sums.items():
                    yield from vectors.slices(name, vector)
                sums = {}
            number = {name: i for i, name in enumerate(names)}
            of = np.array([number[x] for x in langs], np.int64)
            lettered = np.zeros(len(texts), bool)
            for name in names:
                sums.setdefault(name, np.zeros(width + 1, np.int64))
            for owner, bucket in grams(texts.to_pylist()):
                lettered[owner] = True
                lang = of[owner]
                for i in np.flatnonzero(np.bincount(lang, minlength=len(names))):
                    sums[names[i]][:width] += np.bincount(bucket[lang == i], minlength=width)
            for i, n in enumerate(np.bincount(of[lettered], minlength=len(names))):
                sums[names[i]][width] += n
    for name, vector in sums.items():
        yield from vectors.slices(name, vector)


class Model:
    """Gram counts of each language, learned from the rows (text, lang) with both."""

    def __init__(self, rows: DataFrame):
        learned = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
        self.sums = stash(vectors.added(learned.mapInArrow(_learn, vectors.ROWS)), "langid")
        last = (1 << BUCKET_BITS) // vectors.SLICE          # the slice of the number of texts
        found = self.sums.where(F.col("slice") == last).collect()
        self.texts = {r.name: int(np.frombuffer(r.counts, np.int64)[0]) for r in sorted(found)}
        self.langs = list(self.texts)

    def part(self, langs: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(languages, scaled log shares of texts, scaled log probabilities by language and bucket)."""
        width, total = 1 << BUCKET_BITS, sum(self.texts.values())
        n = np.zeros((len(langs), width + vectors.SLICE), np.int64)
        row = {x: i for i, x in enumerate(langs)}
        for r in self.sums.where(F.col("name").isin(langs)).toLocalIterator():
            held = np.frombuffer(r.counts, np.int64)
            n[row[r.name], r.slice * vectors.SLICE:r.slice * vectors.SLICE + len(held)] = held
        n = n[:, :width]
        p = np.log(n + ALPHA) - np.log(n.sum(axis=1, keepdims=True) + ALPHA * width)
        prior = np.log([self.texts[x] / total for x in langs])
        return langs, np.rint(prior * _SCALE).astype(np.int64), np.rint(p * _SCALE).astype(np.int32)


def _score(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, matrix = shared.value
        for batch in batches:
            for at, texts in textops.pieces(batch.column("text")):
                sums = np.repeat(prior[:, None], len(texts), axis=1)
                lettered = np.zeros(len(texts), bool)
                for owner, bucket in grams(texts.to_pylist()):
                    lettered[owner] = True
                    for i in range(len(langs)):            # whole numbers below 2**53: exact
                        sums[i] += np.bincount(owner, matrix[i][bucket], minlength=len(texts)).astype(np.int64)
                best = sums.argmax(axis=0)
                top = sums.max(axis=0)
                mass = np.exp((sums - top) / _SCALE).sum(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(at, len(texts)) for c in _KEPT), pa.array([langs[i] for i in best], pa.string()),
                     pa.array(top), pa.array(mass), pa.array(lettered)], names=[*_KEPT, "lang", "top", "mass", "lettered"])
    return run


_KEPT = ("rid", "doc_id", "held_out")
_SCORED = "rid bigint, doc_id bigint, held_out boolean, lang string, top bigint, mass double, lettered boolean"


def predict(rows: DataFrame, model: Model, langs_at_once: int = LANGS_AT_ONCE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of rows (doc_id, held_out, text); score
    is the posterior probability of the language.  Ties go to the least name."""
    if not model.langs:
        return rows.select("doc_id", "held_out", F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    blocks = [model.langs[i:i + langs_at_once] for i in range(0, len(model.langs), langs_at_once)]
    if len(blocks) > 1:                                      # several passes need one numbering
        rows = stash(rows, "rows")
    scored = None
    for block in blocks:
        one = rows.mapInArrow(_score(rows.sparkSession.sparkContext.broadcast(model.part(block))), _SCORED)
        if len(blocks) > 1:
            one = stash(one, "scored")                       # one matrix at a time
        scored = one if scored is None else scored.unionByName(one)
    if len(blocks) > 1:
        best = scored.groupBy(*_KEPT, "lettered").agg(
            F.max("top").alias("best"), F.collect_list(F.struct("top", "lang", "mass")).alias("blocks"))   # one a block
        top = F.filter("blocks", lambda b: b["top"] == F.col("best"))
        scored = best.select(*_KEPT, "lettered", F.array_min(F.transform(top, lambda b: b["lang"])).alias("lang"),
                             F.aggregate(F.array_sort("blocks"), F.lit(0.0), lambda s, b: s + b["mass"] * F.exp(
                                 (b["top"] - F.col("best")) / F.lit(float(_SCALE)))).alias("mass"))
    return scored.select("doc_id", "held_out", F.when(F.col("lettered"), F.col("lang")).otherwise(F.lit(NONE)).alias("lang_pred"),
                         F.when(F.col("lettered"), 1 / F.col("mass")).otherwise(F.lit(0.0)).alias("score"))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
             langs_at_once: int = LANGS_AT_ONCE) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row; learned from the rows with a text
    and a language that are not held out (crc32 of the key as text, modulo 5, is 0).

    Null, empty and letterless texts: ``und``, score 0; so is all without training
    rows.  Letterless texts are not learned from.  A null key counts as the key ''
    (held out).  Repeated rows are learned from and predicted each.  Ties go to the
    least language name.  An empty table gives no rows.  Keys are cast to bigint.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key), FOLDS, FOLD).alias("held_out"),
                       F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = Model(rows.where(~F.col("held_out")))
    out = predict(rows.drop("lang"), model, langs_at_once)
    discard(model.sums)
    return out
