"""Conversation trie (11), language identification (12), collocations (13)."""
import collections
import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from vendorlake.llm import collocations, convtrie, langid, textops, vectors
from vendorlake.llm.common import documents
from vendorlake.llm.queries import QUERIES

SF_SMALL = "/root/testdata/sf0.001"


# conversation trie

TURNS = ("conv_id bigint, turn bigint, role string, text string, "
         # names the operator uses inside
         "at string, n int, level int, path string, block int, part int, p int, tid string, t1 string, n_convs int")


def _hash(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16] + len(text).to_bytes(4, "big")


def _turns(seed, convs=60, longest=12, common=0.5):
    """Conversations that share beginnings; some equal, some long, some with odd turns."""
    r = random.Random(seed)
    script = [("user" if i % 2 else "assistant", f"line {i} é😀") for i in range(60)]
    rows = []
    for c in r.sample(range(-150, 900), convs):
        n = r.randint(1, longest) if r.random() < 0.9 else r.randint(20, 45)
        keep = r.randint(0, n) if r.random() < common else n
        said = [script[i] if i < keep else ("user", f"own {r.randint(0, 3)}") for i in range(n)]
        rows += [(c, i, *s) for i, s in enumerate(said)]
    return rows


ODD_TURNS = [(None, 0, "user", "nobody"), (3, None, None, None), (3, None, "", ""), (3, 0, None, "x"), (3, 0, None, "x"), (4, 7, "user", None),
             (100, 1, "user", "first"), (100, 5, "user", "second"), (101, 2, "user", "own"), (101, 2, "assistant", "own"), (103, 1, None, ""),
             (10**15, 1, "user", "far" * 50_000), (10**15 + 1, 1, "user", "far" * 50_000)]


def _trie(spark, rows, width=convtrie.BLOCK):
    extra = ("a", 1, 2, "p", 3, 4, 5, "t", "t1", 6)
    df = spark.createDataFrame([(*r, *extra) for r in rows], TURNS).repartition(5)
    out = convtrie.trie(df, width)
    return sorted((tuple(x) for x in out.collect()), key=lambda x: (x[1], x[0]))


@pytest.mark.parametrize("width,seed", [(convtrie.BLOCK, 1), (2, 3), (5, 5)])
def test_trie_equals_brute_force(spark, width, seed):
    rows = _turns(seed) + ODD_TURNS
    assert _trie(spark, rows, width) == brute.conversation_trie(rows, _hash)


def test_trie_of_equal_and_of_turnless_conversations(spark):
    rows = [(c, i, "user", f"t{i}") for c in range(1, 40) for i in range(10)]         # conversation 0 is absent
    got = _trie(spark, rows, 4)
    assert got == brute.conversation_trie(rows, _hash) and got[0][3] == 39
    one = [(7, 0, "user", "alone")]
    assert _trie(spark, one) == brute.conversation_trie(one, _hash)
    assert _trie(spark, []) == []
    nothing = [(c, 0, "user", "gone") for c in (101, 102, 103, 104, 105, 106)]        # shorter than their h: turnless
    assert _trie(spark, nothing) == brute.conversation_trie(nothing, _hash)


def test_many_ends_are_hashed_in_ranges(spark):
    ids = random.Random(1).sample(range(10**9), 500) + list(range(25_000))
    df = spark.createDataFrame([(b"a", i) for i in set(ids)] + [(b"b", 5)], "path binary, conv_id bigint")
    got = {bytes(r.path): r.ends for r in convtrie.ends_hash(df).collect()}
    assert got == {b"a": hashlib.sha256(",".join(map(str, sorted(set(ids)))).encode()).hexdigest(), b"b": hashlib.sha256(b"5").hexdigest()}


def test_turns_of_one_conversation_span_sorted_parts(spark):
    rows = [(5, i // 3, "user", f"t{i % 7}") for i in range(900)] + [(9, 1, "user", "x")] * 40
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").select(
        "conv_id", "turn", convtrie.turn_id(F.col("role"), F.col("text")).alias("tid"))
    got = convtrie.numbered(df).orderBy("conv_id", "p").collect()
    want = sorted((c, t, _hash(r, x)) for c, t, r, x in rows)
    assert [(r.conv_id, bytes(r.tid)) for r in got] == [(c, x) for c, _, x in want]
    assert [r.p for r in got] == [*range(1, 901), *range(1, 41)]


def test_registered_trie_reads_all_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_conversation_trie"](spark, SF_SMALL).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[1], r[0])) == brute.conversation_trie(rows, _hash)


# language identification

LANGS = {"aa": "abcde", "bb": "efghi", "cc": "ijklméß"}


def _texts(seed=1, n=80):
    r = random.Random(seed)
    rows = [(None, "abc abd", "aa"), (1, None, "aa"), (2, "", "bb"), (3, " 123 !? \n", "bb"), (4, "edcba é", None), (5, "İΣß ÀÉ 😀 中文 x", "cc"),
            (6, "abcde", "aa"), (6, "abcde", "aa"), (7, "e", "zz")]
    for i in range(n):
        lang = r.choice(sorted(LANGS))
        rows.append((100 + i, " ".join("".join(r.choice(LANGS[lang]) for _ in range(r.randint(1, 7))) for _ in range(r.randint(1, 40))), lang))
    return rows


def _bucket(gram):
    value = 0
    for c in gram:
        value = value * 0x110000 + (ord(c) if c != " " else 0)
    value = np.array([(value + (len(gram) << 60)) % 2**64], np.uint64)
    return int(textops.mix(value)[0] >> np.uint64(64 - langid.BUCKET_BITS))


def _identified(spark, rows, **options):
    extra = (1, "a", 2.0, "b")
    df = spark.createDataFrame([(*r, *extra) for r in rows], "doc_id bigint, text string, lang string, rid int, top string, mass double, held_out string")
    return langid.identify(df.repartition(4), **options).collect()


def _same(got, rows):
    want = brute.language_scores(rows, _bucket, 1 << langid.BUCKET_BITS, langid.ALPHA, 1 << 20)
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    got, want = sorted(map(tuple, got), key=key), sorted(((r[0], *w) for r, w in zip(rows, want)), key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-9)


@pytest.mark.parametrize("at_once", [langid.LANGS_AT_ONCE, 2, 1])
def test_languages_equal_brute_force(spark, at_once):
    rows = _texts()
    _same(_identified(spark, rows, langs_at_once=at_once), rows)


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    rows = _texts(2, 10) + [(900, "abcde fghij " * 30_000, "bb"), (901, "x" * 3_000_000, "cc")]
    _same(_identified(spark, rows), rows)
    monkeypatch.setattr(langid, "_CUT", 7)
    texts = [t for _, t, _ in rows[:18]]
    cut = collections.Counter((int(a), int(b)) for o, h in langid.grams(texts) for a, b in zip(o, h))
    monkeypatch.setattr(langid, "_CUT", 1 << 20)
    assert cut == collections.Counter((int(a), int(b)) for o, h in langid.grams(texts) for a, b in zip(o, h))


def test_no_training_rows_and_no_rows(spark):
    assert {(r.lang_pred, r.score) for r in _identified(spark, [(1, "abc", None), (2, None, "aa")])} == {("und", 0.0)}
    assert _identified(spark, []) == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op12_language_id"](spark, sf).join(documents(spark, sf).select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


# collocations

def _found(spark, rows, partitions=4, **options):
    df = spark.createDataFrame([(*r, 1, "b", "c", 2) for r in rows], "text string, lang string, f int, phrase string, gram string, n int")
    return sorted(map(tuple, collocations.collocations(df.repartition(partitions), **options).collect()))


def _prose(seed=1, n=120):
    r = random.Random(seed)
    words = ["a", "b", "Ab", "été", "É", "x y", "😀", "c\u000bd", "z'z", "longer", "word"]
    rows = [(None, "en"), ("", None), (" \t ", "en"), ("...!?\n\n", "fr"), ("a a a a a a a a a a a", "en"), ("one", None), ("a\tb  a b", None)]
    for _ in range(n):
        text = "".join(r.choice(words) + r.choice([" "] * 8 + [", ", "\t", "  ", ".", "\n"]) for _ in range(r.randint(1, 60)))
        rows += [(text, r.choice(["en", "en", "fr", None]))] * r.choice([1, 1, 2])
    return rows


@pytest.mark.parametrize("least,best,entries", [(30, 2000, collocations.TRIE_ENTRIES), (3, 2000, 50), (5, 7, 200), (40, 2000, 100)])
def test_collocations_equal_brute_force(spark, least, best, entries):
    rows = _prose(1, 120 if least < 30 else 1200)
    want = brute.collocations(rows, least, best=best)
    assert want and _found(spark, rows, least=least, best=best, entries=entries) == want


def test_long_text_and_no_candidates(spark, monkeypatch):
    rows = [("the same words again, " * 100_000, "en"), ("x" * 1_000_000, "en"), ("solid " * 200_000, "fr")]
    assert _found(spark, rows) == brute.collocations(rows)
    assert _found(spark, [("only once", "en")]) == [] and _found(spark, []) == []


class _Shared:
    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize("step", [
    lambda: collocations._support(_Shared(None), 1),
    lambda: collocations._support(_Shared(np.full(1 << 17, 255, np.uint8)), 2),
    lambda: collocations._spelled(_Shared([None, *(np.zeros(1 << 17, np.uint8) for _ in range(4))]), 4)])
def test_counting_phrases_takes_little_memory_at_once(step):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefg", k=5)) for _ in range(3000)]
    texts = [" ".join(r.choices(words, k=500)) for _ in range(4000)]            # 12 MB
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * len(texts))], names=["text", "lang"])
    tracemalloc.start()
    rows = sum(len(b) for b in step()(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows and peak < 120 << 20


@pytest.mark.parametrize("held", [1, 50, 10 ** 6])
def test_few_runs_held_at_once(spark, monkeypatch, held):
    monkeypatch.setattr(collocations, "_HELD", held)
    monkeypatch.setattr(collocations, "_BLOCK", 400)
    batch = pa.RecordBatch.from_arrays([pa.array(["a b a b, a b c", "a b c d"] * 30), pa.array(["en", "fr"] * 30)], names=["text", "lang"])
    codes = collections.Counter()
    for b in collocations._support(_Shared(None), 1)(iter([batch])):
        for code in b.column(0).to_pylist():
            codes[code >> 5] += code & 31
    assert sorted(min(n, 30) for n in codes.values()) == [30] * 7
    full = np.full(1 << 17, 255, np.uint8)
    named = pa.Table.from_batches(list(collocations._spelled(_Shared([None, full, full, full, full]), 4)(iter([batch, batch]))))
    got = {(x["lang"], x["phrase"]) for x in named.to_pylist() if x["phrase"]}
    assert got == {("en", x) for x in ("a b", "b a", "b c", "a b a", "b a b", "a b c", "a b a b")} | {
        ("fr", x) for x in ("a b", "b c", "c d", "a b c", "b c d", "a b c d")}


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9 * 10**15
    counts = spark.createDataFrame([("en", "a", 1, big + 1), ("en", "b", 1, big + 2), ("en", "a b", 2, big)], "lang string, phrase string, k bigint, f bigint")
    r = collocations.scored(counts, 30).collect()[0]
    assert (r.a, r.l, r.r, r.score) == (big, big + 1, big + 2, 2000000 * big // (2 * big + 3))


@pytest.mark.parametrize("alphabet,n", [(3, 200), (3000, 4000), (40, 20_000)])
def test_trie_holds_its_entries_and_no_others(alphabet, n):
    r = random.Random(alphabet)
    phrases = sorted({tuple(r.randrange(alphabet) for _ in range(r.randint(1, 4))) for _ in range(n)})
    words = np.array([w for p in phrases for w in p], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    trie = collocations.Trie.build(words, np.array([len(p) for p in phrases]))
    text = [r.randrange(alphabet + 1) for _ in range(5000)]
    run = np.cumsum([r.random() < 0.1 for _ in text])
    got = trie.count(np.array(text, np.uint64) * np.uint64(0x9E3779B97F4A7C15), run, 4)
    want = collections.Counter(tuple(text[i:i + k]) for k in range(1, 5) for i in range(len(text) - k + 1) if run[i] == run[i + k - 1])
    assert got.tolist() == [want[p] for p in phrases]


def test_registered_collocations_read_all_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in documents(spark, sf).select("text", "lang").collect()]
    want = brute.collocations(rows)
    assert want and sorted(map(tuple, QUERIES["op13_collocations"](spark, sf).collect())) == want


def test_vectors_add_up(spark):
    def run(batches):
        for batch in batches:
            for x in batch.column(0).to_pylist():
                v = np.zeros(40_000, np.int64)
                v[[x, 39_999]] = x
                yield from vectors.slices(str(x % 2), v)
    got = {(r.name, r.at): r.n for r in vectors.counts(vectors.added(spark.range(1, 50).repartition(7).mapInArrow(run, vectors.ROWS))).collect()}
    want = {(str(x % 2), x): x for x in range(1, 50)}
    assert got == want | {(str(b), 39_999): sum(x for x in range(1, 50) if x % 2 == b) for b in (0, 1)}
