"""Operator 13: phrase collocations, counted through broadcast double-array tries.

1. Level by level, tasks name the runs of k words whose first and last k - 1
   words may both be frequent (bit maps of fixed size say which: nothing frequent
   is missed) and Spark adds up their counts, cut at 31, by a 59-bit hash.  What
   reaches the threshold is a candidate: Apriori-safe, a superset of the frequent.
2. One more pass spells the candidates out.
3. Candidates and their words go into double-array tries of bounded size, built
   by tasks.  Each is broadcast in turn; numpy advances the states of all
   positions of a block of text together, word by word, and counts the accepting
   states; the shards' counts are summed.  These counts are the frequencies.

A word is a 64-bit hash of its language and bytes, taken apart into digits of 10
bits for the trie, so no node has more than 1,024 children.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendorlake.llm import sift, textops, vectors
from vendorlake.llm.common import discard, stash

LONGEST, LEAST, BEST = 4, 30, 2000
COVER_PERCENT, SCALE = 80, 2_000_000
NONE = "und"
#: Entries of a trie: some 64 MB of arrays to broadcast, and of tries that a pass over the texts counts.
TRIE_ENTRIES, AT_ONCE = 1_500_000, 2
_BLOCK = 1 << 20                        # bytes of text handled at once (the arrays of a block take some 40 times that)
_HELD = 3 << 19                         # runs of words counted together, and distinct ones a task remembers
_DIGIT = 10
_DRAWN = 4                              # a state with more children is placed where it fits first
_WINDOW = 1024                          # places tried at once
_CLAMP = 5                              # bits of a count beside a hash
_MOST = (1 << _CLAMP) - 1               # enough to tell what reaches LEAST
_U = np.uint64

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"]] = True
_BREAK[10:14] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True


class Positions:
    """The words of some texts: symbol (a hash of language and word), bytes, text
    and run; words of one run follow each other with no break between them."""

    def __init__(self, data: np.ndarray, at: np.ndarray, langs: list[str]):
        self.data, self.langs = textops._LOWER[data], langs
        inside = ~_GAP[data]
        first = np.zeros(len(data) + 1, bool)
        first[at] = True
        first[-1] = True
        before, after = first[:-1].copy(), first[1:].copy()
        before[1:] |= ~inside[:-1]
        after[:-1] |= ~inside[1:]
        self.starts = np.flatnonzero(inside & before)
        self.ends = np.flatnonzero(inside & after) + 1
        self.owner = np.searchsorted(at, self.starts, "right") - 1
        self.run = np.cumsum(_BREAK[data])[self.starts] + self.owner
        self.symbols = symbols(textops.hash_words(self.data, self.starts, self.ends), langs, self.owner)

    def together(self, k: int) -> np.ndarray:
        """Whether the k words from each position on are of one run."""
        n = max(len(self.run) - k + 1, 0)
        return self.run[:n] == self.run[k - 1:k - 1 + n]

    def hashes(self, k: int) -> np.ndarray:
        return (textops.rolling(self.symbols, k) >> _U(_CLAMP)).astype(np.int64)

    def spell(self, at: np.ndarray, k: int) -> pa.Array:
        """The k words from each position on, joined by one space."""
        sizes = self.ends[at + k - 1] - self.starts[at]
        words = sum(self.ends[at + i] - self.starts[at + i] for i in range(k))
        gaps = [self.data[np.minimum(self.ends[at + i], len(self.data) - 1)] == 32 for i in range(k - 1)]
        plain = reduce(np.logical_and, gaps, sizes == words + k - 1)     # single spaces already
        out = np.empty(len(at), object)
        lengths = sizes[plain]
        ends = np.cumsum(lengths)
        where = np.repeat(self.starts[at[plain]] - (ends - lengths), lengths) + np.arange(lengths.sum())
        raw, offsets = self.data[where].tobytes(), [0, *ends.tolist()]
        out[plain] = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        for i in np.flatnonzero(~plain):
            out[i] = b" ".join(self.data[self.starts[at[i] + j]:self.ends[at[i] + j]].tobytes() for j in range(k))
        return pa.array(out, pa.binary()).cast(pa.string())


def symbols(words: np.ndarray, langs: list[str], owner: np.ndarray) -> np.ndarray:
    names = sorted(set(langs))
    raw = [x.encode() for x in names]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    hashed = textops.hash_words(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends)
    number = {x: i for i, x in enumerate(names)}
    return textops.mix(words ^ textops.mix(hashed + _U(1))[np.array([number[x] for x in langs], np.int64)][owner])


def _blocks(batch: pa.RecordBatch) -> Iterator[Positions]:
    """The words of the rows (text, lang), about _BLOCK bytes at once; a longer text
    is cut at a break."""
    for at, texts in textops.pieces(batch.column("text"), _BLOCK):
        langs = batch.column("lang").slice(at, len(texts)).to_pylist()
        texts = pc.fill_null(texts, "")
        if len(texts) == 1 and (data := np.frombuffer(texts[0].as_buffer(), np.uint8)).size > _BLOCK:
            cuts = np.flatnonzero(_BREAK[data]) + 1
            a = 0
            while a < len(data):
                i = np.searchsorted(cuts, a + _BLOCK)
                b = int(cuts[i]) if i < len(cuts) else len(data)
                yield Positions(data[a:b], np.zeros(1, np.int64), langs)
                a = b
            continue
        raw = [x.as_buffer() for x in texts]
        sizes = np.array([x.size for x in raw], np.int64)
        full = np.flatnonzero(sizes)
        if len(full):
            yield Positions(np.frombuffer(b"".join(raw[i] for i in full), np.uint8), np.cumsum(sizes[full]) - sizes[full],
                            [langs[i] for i in full])


def _support(shared: Broadcast | None, k: int):
    """Hash and clamped count, in one number, of the distinct k-word runs of some
    blocks whose first and last k - 1 words pass the bit map."""
    def counted(grams: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(grams), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found << _CLAMP | np.minimum(n, _MOST))], names=["code"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for p in _blocks(batch):
                grams = p.hashes(k)
                if k > 1:
                    may = sift.passes(shared.value, p.hashes(k - 1))
                    grams = grams[may[:-1] & may[1:] & p.together(k)]
                held.append(grams)
                size += len(grams)
                if size >= _HELD:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)
    return run


def _spelled(shared: Broadcast, longest: int):
    """Every run of 2 to ``longest`` words that passes its bit map, spelled out, once
    a block at most; and the number of words of each language (phrase null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {k: np.zeros(0, np.int64) for k in range(2, longest + 1)}      # spelled by this task
        for batch in batches:
            for p in _blocks(batch):
                n = np.bincount(p.owner, minlength=len(p.langs))
                yield _named(pa.array(p.langs, pa.string()), pa.nulls(len(n), pa.string()), pa.nulls(len(n), pa.int64()), pa.array(n), 1)
                for k in range(2, longest + 1):
                    grams = p.hashes(k)
                    may = np.flatnonzero(p.together(k) & sift.passes(shared.value[k], grams))
                    found, at = np.unique(grams[may], return_index=True)
                    place = np.searchsorted(known[k], found)
                    new = np.searchsorted(known[k], found, "right") == place
                    found, at = found[new], may[at[new]]
                    known[k] = np.insert(known[k], place[new], found) if len(known[k]) < _HELD else found
                    langs = pa.array(p.langs, pa.string()).take(pa.array(p.owner[at]))
                    yield _named(langs, p.spell(at, k), pa.array(found), pa.nulls(len(at), pa.int64()), k)
    return run


def _named(lang: pa.Array, phrase: pa.Array, gram: pa.Array, n: pa.Array, k: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, gram, n, pa.array(np.full(len(lang), k))],
                                      names=["lang", "phrase", "gram", "n", "k"])


class Trie:
    """A double array over digits of symbol numbers: from state s digit c leads to
    t = base[s] + c if check[t] is s; accept[t] is the entry that ends there, or -1."""

    def __init__(self, symbols: np.ndarray, base: np.ndarray, check: np.ndarray, accept: np.ndarray, entries: int):
        self.symbols, self.base, self.check, self.accept, self.entries = symbols, base, check, accept, entries
        self.digits = digits(len(symbols))

    @classmethod
    def build(cls, words: np.ndarray, counts: np.ndarray) -> Trie:
        """Of entries of ``counts`` symbols each, which lie one after the other in ``words``."""
        known = np.unique(words)
        d = digits(len(known))
        numbers = np.searchsorted(known, words) + 1
        first = np.cumsum(counts) - counts
        state = np.zeros(len(counts), np.int64)
        width = 1 << _DIGIT
        base, check = np.zeros(width, np.int64), np.full(2 * width, -1, np.int64)
        rng = np.random.default_rng(len(words))
        for step in range(int(counts.max(initial=0)) * d):
            live = np.flatnonzero(counts * d > step)
            digit = numbers[first[live] + step // d] >> _DIGIT * (d - 1 - step % d) & width - 1
            edges, of = np.unique(state[live] << _DIGIT | digit, return_inverse=True)
            parents, edge_parent = np.unique(edges >> _DIGIT, return_inverse=True)
            base, check, slots = _place(parents, edge_parent, edges & width - 1, base, check, rng)
            state[live] = slots[of]
        accept = np.full(len(check), -1, np.int32)
        accept[state] = np.arange(len(counts))
        return cls(known, base.astype(np.int32), check.astype(np.int32), accept, len(counts))

    @cached_property
    def _buckets(self) -> tuple[np.ndarray, np.ndarray, np.uint64]:
        """The symbols, closed by the greatest number, where those of each leading bits
        start, and the shift that leaves these bits: hashes are spread evenly."""
        bits = len(self.symbols).bit_length() + 1
        shift = _U(64 - bits)
        starts = np.searchsorted(self.symbols, np.arange(1 << bits, dtype=np.uint64) << shift)
        return np.append(self.symbols, _U(2 ** 64 - 1)), starts, shift

    @cached_property
    def _heads(self) -> np.ndarray:
        """The state that each first symbol, by its number, leads to; -1 for none."""
        number = np.arange(len(self.symbols) + 1)
        ok, state = self._step(np.zeros(len(number), np.int64), number)
        heads = np.full(len(number), -1, np.int64)
        heads[ok] = state
        return heads

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The number of each symbol, from 1; 0 if no entry has it."""
        known, starts, shift = self._buckets
        at = starts[words >> shift]
        low = np.flatnonzero(known[at] < words)
        while len(low):
            at[low] += 1
            low = low[known[at[low]] < words[low]]
        return np.where((known[at] == words) & (at < len(self.symbols)), at + 1, 0)

    def _step(self, state: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(those whose symbol leads on, the states it leads them to)."""
        ok = np.flatnonzero(number > 0)
        state, number = state[ok], number[ok]
        for i in range(self.digits):
            to = self.base[state] + (number >> _DIGIT * (self.digits - 1 - i) & (1 << _DIGIT) - 1)
            on = self.check[to] == state
            ok, state, number = ok[on], to[on], number[on]
        return ok, state

    def count(self, words: np.ndarray, run: np.ndarray, longest: int) -> np.ndarray:
        """How often each entry occurs in the words within a run."""
        numbers = self.numbers(words)
        total = np.zeros(self.entries, np.int64)
        state = self._heads[numbers]
        at = np.flatnonzero(state >= 0)
        state = state[at]
        for k in range(longest):
            if k:                                          # the next word of the same run
                ok = at + k < len(run)
                ok[ok] = run[at[ok] + k] == run[at[ok]]
                at, state = at[ok], state[ok]
                ok, state = self._step(state, numbers[at + k])
                at = at[ok]
            entry = self.accept[state]
            total += np.bincount(entry[entry >= 0], minlength=self.entries)
        return total


def digits(symbols: int) -> int:
    return max(1, -(-int(symbols).bit_length() // _DIGIT))


def _place(parents: np.ndarray, edge_parent: np.ndarray, digit: np.ndarray, base: np.ndarray, check: np.ndarray,
           rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Find a base for each parent (edges by parent) such that its children fall on free slots.

    Parents with several children come first, those with most before the others, each
    where it fits first.  The others, most of all, draw a base at once; of those whose
    slots are free the first wins a slot that several want; the others draw again.
    Half of the slots are used in the end."""
    width = 1 << _DIGIT
    slots = np.full(len(digit), -1, np.int64)
    fan = np.bincount(edge_parent, minlength=len(parents))
    start = np.cumsum(fan) - fan
    room = max(len(check) - width, 2 * (int((check >= 0).sum()) + len(digit)))
    check = np.concatenate([check, np.full(room + width - len(check), -1, np.int64)])
    new = np.zeros(len(parents), np.int64)
    near = np.arange(_WINDOW)

    def fit(some: np.ndarray) -> None:
        nonlocal check
        at = width
        for i in some:
            edges = slice(start[i], start[i] + fan[i])
            away = digit[edges] - digit[start[i]]                 # its digits ascend
            while True:
                if at + _WINDOW + 2 * width > len(check):
                    check = np.concatenate([check, np.full(_WINDOW + 2 * width, -1, np.int64)])
                fits = (check[at:at + _WINDOW + width] < 0)[away[:, None] + near].all(axis=0)
                if fits.any():
                    break
                at += _WINDOW
            first = at + int(fits.argmax())
            new[i], slots[edges] = first - digit[start[i]], first + away
            check[first + away] = parents[i]

    for low, high in ((64, width), (16, 64), (8, 16), (_DRAWN, 8)):
        some = np.flatnonzero((fan > low) & (fan <= high))
        fit(some[np.argsort(-fan[some], kind="stable")])
    todo = np.flatnonzero(fan <= _DRAWN)
    room = len(check) - width
    for _ in range(64):
        if not len(todo):
            break
        new[todo] = rng.integers(1, room, len(todo))
        mine = np.zeros(len(parents), bool)
        mine[todo] = True
        e = np.flatnonzero(mine[edge_parent])
        want = new[edge_parent[e]] + digit[e]
        claim = np.full(len(check), -1, np.int32)
        claim[want[::-1]] = edge_parent[e][::-1]
        lost = (check[want] >= 0) | (claim[want] != edge_parent[e])
        failed = np.bincount(edge_parent[e][lost], minlength=len(parents)) > 0
        won = ~failed[edge_parent[e]]
        slots[e[won]] = want[won]
        check[want[won]] = parents[edge_parent[e[won]]]
        todo = todo[failed[todo]]
    fit(todo)
    base = np.concatenate([base, np.zeros(len(check) - len(base), np.int64)])
    base[parents] = new
    return base, check, slots


_TRIE = "part bigint, symbols binary, base binary, check binary, accept binary, entries bigint"


def _build(table: pa.Table) -> pa.Table:
    """The trie of one part; its entries are the phrases in order."""
    order = table.sort_by([("lang", "ascending"), ("phrase", "ascending")])
    words = textops.Words(order.column("phrase").combine_chunks())
    trie = Trie.build(symbols(words.hashes, order.column("lang").to_pylist(), words.owner()), words.counts)
    arrays = [trie.symbols, trie.base, trie.check, trie.accept]
    return pa.table([pa.array([table.column("part")[0].as_py()]), *(pa.array([x.tobytes()], pa.binary()) for x in arrays),
                     pa.array([trie.entries])], names=["part", "symbols", "base", "check", "accept", "entries"])


def _count(tries: dict[int, Broadcast], longest: int):
    """The counts of the tries (by part) over the rows: their words are taken apart once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {part: Trie(*shared.value) for part, shared in tries.items()}
        total = {part: np.zeros(trie.entries, np.int64) for part, trie in held.items()}
        for batch in batches:
            for p in _blocks(batch):
                for part, trie in held.items():
                    total[part] += trie.count(p.symbols, p.run, longest)
        for part, counts in total.items():
            yield from vectors.slices(str(part), counts)
    return run


def candidates(rows: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k) of every run of 2 to ``longest`` words that may occur
    ``least`` times, (lang, n) with the number of words), from rows (text, lang)."""
    spark = rows.sparkSession
    if least > _MOST:                                        # counts are cut at _MOST: safe for any threshold
        least = _MOST
    maps: list[np.ndarray | None] = [None]
    kept = None
    for k in range(1, longest + 1):
        shared = spark.sparkContext.broadcast(maps[-1])
        frequent = stash(rows.mapInArrow(_support(shared, k), "code bigint")
                         .groupBy(F.shiftrightunsigned("code", _CLAMP).alias("gram"))
                         .agg(F.sum(F.col("code").bitwiseAND(_MOST)).alias("n")).where(F.col("n") >= least).select("gram"),
                         "support")
        maps.append(sift.build(frequent, "gram", frequent.count()))
        shared.unpersist()
        if k > 1:
            level = frequent.withColumn("k", F.lit(k).cast("long"))
            kept = level if kept is None else kept.unionByName(level)
    shared = spark.sparkContext.broadcast(maps)
    named = stash(rows.mapInArrow(_spelled(shared, longest), "lang string, phrase string, gram bigint, n bigint, k bigint")
                  .groupBy("lang", "phrase", "gram", "k").agg(F.sum("n").alias("n")), "spelled")
    shared.unpersist()
    phrases = named.where(F.col("phrase").isNotNull()).join(kept, ["gram", "k"], "left_semi").select("lang", "phrase", "k")
    return phrases, named.where(F.col("phrase").isNull()).groupBy("lang").agg(F.sum("n").alias("n"))


def frequencies(rows: DataFrame, phrases: DataFrame, longest: int, entries: int = TRIE_ENTRIES) -> DataFrame:
    """(lang, phrase, k, f) of the phrases (lang, phrase, k) and of their words,
    counted in the rows (text, lang)."""
    words = phrases.select("lang", F.explode(F.split("phrase", " ")).alias("phrase")).distinct().withColumn("k", F.lit(1).cast("long"))
    every = stash(phrases.unionByName(words), "entries")
    parts = max(1, -(-every.count() // entries))
    # phrases with the same first two words lie together: a word's paths do not start in every trie
    first = F.substring_index("phrase", " ", 2)
    every = every.withColumn("part", F.pmod(F.xxhash64("lang", first), F.lit(parts)))
    numbered = every.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("lang", "phrase")) - 1)
    tries = stash(every.select("part", "lang", "phrase").groupBy("part").applyInArrow(_build, _TRIE), "tries")
    counted = None
    for low in range(0, parts, AT_ONCE):
        some = {}
        for part in range(low, min(low + AT_ONCE, parts)):
            for r in tries.where(F.col("part") == part).collect():        # one bounded trie
                arrays = [np.frombuffer(x, kind) for x, kind in
                          zip((r.symbols, r.base, r.check, r.accept), (np.uint64, np.int32, np.int32, np.int32))]
                some[part] = rows.sparkSession.sparkContext.broadcast((*arrays, r.entries))
        if some:
            one = stash(vectors.added(rows.mapInArrow(_count(some, longest), vectors.ROWS)), "counts")
            counted = one if counted is None else counted.unionByName(one)
        for shared in some.values():
            shared.unpersist()
    if counted is None:                                                # no candidates at all
        return every.select("lang", "phrase", "k", F.lit(0).cast("long").alias("f"))
    sums = vectors.counts(counted).select(F.col("name").cast("long").alias("part"), "at", F.col("n").alias("f"))
    return numbered.join(sums, ["part", "at"]).select("lang", "phrase", "k", "f")


def _run(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(counts: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of ``counts`` that stay: those
    that a longer one does not cover, at their lowest-scoring cut."""
    frequent = counts.where(F.col("f") >= least)
    found = frequent.where(F.col("k") >= 2).select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    inner = (found.where(F.col("k") >= 3)
             .select("lang", "a", "w", "k", F.explode(F.expr("sequence(2L, k - 1)")).alias("size"))
             .select("lang", "a", "w", "size", F.explode(F.expr("sequence(1L, k - size + 1)")).alias("start"))
             .groupBy("lang", _run(F.col("w"), F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("cover")))
    wide = "decimal(38,0)"
    stay = found.join(inner, ["lang", "phrase"], "left").where(F.coalesce(
        F.col("cover").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * COVER_PERCENT, F.lit(True)))
    cuts = stay.select("lang", "phrase", "a", "w", "k", F.explode(F.expr("sequence(1L, k - 1)")).alias("cut")).select(
        "lang", "phrase", "a", "cut", _run(F.col("w"), F.lit(1), F.col("cut")).alias("left"),
        _run(F.col("w"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    l = frequent.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    r = frequent.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    both = cuts.join(l, ["lang", "left"]).join(r, ["lang", "right"]).withColumn(
        "score", F.expr(f"cast(a as {wide}) * cast({SCALE} as decimal(7,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    return best.select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST,
                 best: int = BEST, entries: int = TRIE_ENTRIES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``best`` phrases of each language.

    Null texts are empty, a null language is ``und``.  Repeated rows count each.
    Ties of score and frequency go by the phrase's bytes.  Languages without a
    phrase, and an empty table, give no rows.
    """
    rows = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(NONE)).alias("lang"))
    phrases, totals = candidates(rows, least, longest)
    counts = stash(frequencies(rows, phrases, longest, entries), "frequencies")
    found = stash(scored(counts, least), "collocations")
    discard(counts)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))                     # a language is not one task's
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= best)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
