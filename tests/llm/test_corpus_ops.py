"""Search (1), mixing (2), packing (4), LM scores (6), near-dedup (7), the pipeline."""
import collections
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import make_rows
from vendorlake.llm import components, linededup, lmscore, minhash, mixing, packing, quality, search, textops
from vendorlake.llm.queries import QUERIES


def test_queries_are_registered():
    import __spark_entry__
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert names["pipeline"] is corpus_pipeline.run
    assert all(names[x] is f for x, f in QUERIES.items())


# search

def _hash_of(word):
    return int(textops.Words(pa.array([word.decode()])).hashes.view(np.int64)[0])


@pytest.mark.parametrize("shard_bytes,block", [(search.SHARD_BYTES, search.QUERY_BLOCK), (3000, 4)])
def test_search_matches_brute_force(frame, rows, shard_bytes, block):
    out = collections.defaultdict(list)
    for r in search.search_documents(frame(rows), F.col("doc_id") % 3 == 0, shard_bytes=shard_bytes, block=block).collect():
        out[r.query_id].append((r.rank, r.doc_id, r.score))
    want = brute.bm25(rows, lambda d: d % 3 == 0, _hash_of)
    for q, hits in want.items():
        got = sorted(out.get(q, []))
        assert [r for r, _, _ in got] == list(range(1, len(hits) + 1))
        assert [s for _, _, s in got] == pytest.approx([s for s, _ in hits])
        assert [d for _, d, _ in got if [round(s, 6) for s, _ in hits].count(round(_, 6)) == 1] == \
            [d for s, d in hits if [round(x, 6) for x, _ in hits].count(round(s, 6)) == 1]
    assert set(out) <= set(want)


def _same_hits(found, want):
    out = collections.defaultdict(list)
    for r in found.collect():
        out[r.query_id].append((r.rank, r.doc_id, r.score))
    assert set(out) == {q for q, hits in want.items() if hits}
    for q, hits in want.items():
        got, scores = sorted(out.get(q, [])), [round(s, 6) for s, _ in hits]
        assert [r for r, _, _ in got] == list(range(1, len(hits) + 1))
        assert [s for _, _, s in got] == pytest.approx([s for s, _ in hits])
        assert [d for _, d, s in got if scores.count(round(s, 6)) == 1] == [d for s, d in hits if scores.count(round(s, 6)) == 1]


def test_the_search_query_asks_with_every_word(spark, frame, tmp_path):
    """No word of a query document is left out, as brute force without a cut shows."""
    rows = make_rows(seed=5, n=120)
    text = dict(rows)
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute.bm25(rows, lambda d: d % 20 == 0, _hash_of, most=None)
    assert max(len(set(brute.words(text[q], lower=True))) for q in want) > 64
    _same_hits(QUERIES["op1_bmw_bm25_search"](spark, str(tmp_path)), want)


def test_keyword_search_asks_with_the_most_telling_words(frame, rows):
    want = brute.bm25(rows, lambda d: d % 3 == 0, _hash_of, most=32)
    _same_hits(search.search_documents(frame(rows), F.col("doc_id") % 3 == 0, words=32), want)


def test_search_blocks_by_terms(frame, rows):
    want = brute.bm25(rows, lambda d: d % 3 == 0, _hash_of, most=None)
    _same_hits(search.search_documents(frame(rows), F.col("doc_id") % 3 == 0, words=None, shard_bytes=3000, terms=500), want)


def test_search_prunes_ranges_without_loss():
    """Many ranges: most lie under the floor, and the best are still exact."""
    r = random.Random(4)
    texts = [" ".join(r.choices([f"w{i}" for i in range(50)], k=r.randint(1, 30))) for _ in range(3000)]
    columns = search.index_shard(pa.array(range(3000)), pa.array(texts))
    shard = {n: columns.column(n)[0].values.to_numpy(zero_copy_only=False).astype(np.int64) for n in columns.schema.names}
    terms = np.sort(shard["terms"][:8])
    idf = np.linspace(0.5, 3, 8)
    best = search.Best(10, 1)
    search.search_shard(shard, np.zeros(8, np.int64), terms, idf, 15.0, best)
    scores = np.zeros(3000)
    for t, w in zip(terms, idf):
        for d, text in enumerate(texts):
            tf = sum(h == t for h in (_cached(x) for x in text.split()))
            scores[d] += w * search._norm(tf, len(text.split()), 15.0) if tf else 0
    order = np.lexsort((np.arange(3000), -scores))[:10]
    _, ids, found = best.rows()
    assert ids.tolist() == order.tolist() and found == pytest.approx(scores[order])


def _long_queries():
    """A shard with copies, and (q, term, idf) of twenty of its documents."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choices(words, weights=[1 / (i + 1) for i in range(400)], k=r.randint(1, 200))) for _ in range(600)]
    texts += ["", "w0"] + [texts[7]] * 150 + [" ".join(reversed(texts[8].split(" ")))] * 30
    columns = search.index_shard(pa.array([(i * 7919) % 100_003 for i in range(len(texts))]), pa.array(texts))
    shard = {n: columns.column(n)[0].values.to_numpy(zero_copy_only=False).astype(np.int64) for n in columns.schema.names}
    term, q, _, _ = search._postings(pa.array(texts[:20] + ["w399 none", "nothing"]))
    order = np.lexsort((term, q))
    term, q = term[order], q[order]
    return shard, q, term, np.log(1 + 800 / (1 + np.abs(term) % 700))


@pytest.mark.parametrize("often,cells", [(24, 1 << 21), (2, 1 << 21), (24, 3000), (10 ** 6, 1 << 21)])
@pytest.mark.parametrize("k", [1, 10, 1000])
def test_product_and_postings_find_the_same(monkeypatch, often, cells, k):
    """To the last bit and tie, from any floor."""
    shard, q, term, idf = _long_queries()
    found = {}
    for many in (10 ** 9, 0):
        monkeypatch.setattr(search, "_MANY", many)
        if not many:
            monkeypatch.setattr(search, "_OFTEN", often)
            monkeypatch.setattr(search, "_CELLS", cells)
            monkeypatch.setattr(search, "_BATCH", cells)
        best = search.Best(k, 22)
        for _ in range(2):                               # the second time with floors, the documents once more
            search.search_shard(shard, q, term, idf, 90.0, best)
            found.setdefault(many, []).append([x.tolist() for x in best.rows()])
    assert found[0] == found[10 ** 9] and len(found[0][0][0]) >= 20


def test_long_queries_read_few_postings(monkeypatch):
    shard, q, term, idf = _long_queries()
    read, expand = [], search._expand
    monkeypatch.setattr(search, "_expand", lambda first, count: read.append(int(np.sum(count))) or expand(first, count))
    best = search.Best(10, 22)
    search.search_shard(shard, q, term, idf, 90.0, best)
    at = np.searchsorted(shard["terms"], term).clip(max=len(shard["terms"]) - 1)
    at = at[shard["terms"][at] == term]
    size = np.diff(shard["block_from"][shard["blocks_from"]])
    assert sum(read) < size[at].sum()


def test_like_documents_share_ranges():
    """Two vocabularies that take turns: a word is in the ranges of its own only, and scores are kept."""
    r = random.Random(5)
    texts = [" ".join(r.choices([f"{'ab'[i % 2]}{j}" for j in range(60)], k=r.randint(20, 40))) for i in range(2000)]
    columns = search.index_shard(pa.array(range(2000)), pa.array(texts))
    shard = {n: columns.column(n)[0].values.to_numpy(zero_copy_only=False).astype(np.int64) for n in columns.schema.names}
    ranges = 2000 // search.RANGE + 1
    assert np.diff(shard["blocks_from"]).max() <= ranges * 3 // 4          # some ranges lie between groups
    assert sorted(shard["doc_ids"].tolist()) == list(range(2000))
    for d, n in zip(shard["doc_ids"], shard["lengths"]):
        assert n == len(texts[d].split(" "))


def test_every_shard_has_one_turn(spark):
    shards = spark.range(700).toDF("s")
    for n in (0, 1, 40, 700):
        some, turns = shards.where(F.col("s") < n), search._turns(n)
        sizes = [some.where(t).count() for t in turns]
        assert sum(sizes) == n and some.where(sum((t.cast("int") for t in turns), F.lit(0)) != 1).count() == 0
        assert n < 700 or sizes[0] < sizes[1] < sizes[2] and sizes[0] < 40


def test_tasks_return_what_reaches_the_floor():
    """Shards far from the best send nothing once the best of others are known."""
    class Shared:
        def __init__(self, value):
            self.value = value
    texts = [" ".join(["far"] * 9 + [f"x{i}", "near"]) for i in range(50)]
    bodies = pa.RecordBatch.from_arrays([pa.array([search._pack(search.index_shard(pa.array(range(50)), pa.array(texts)))])], names=["body"])
    term, _, _, _ = search._postings(pa.array(["near"]))
    shared = Shared((np.array([7]), np.zeros(1, np.int32), term, np.zeros(1, np.int32), np.array([2.0])))
    (all_,), (few,) = (list(search._run_block(shared, 11.0, 10, f)(iter([bodies]))) for f in (None, Shared(np.array([2.5]))))
    assert len(all_) == 10 and len(few) == 0


_seen = {}


def _cached(word):
    if word not in _seen:
        _seen[word] = _hash_of(word.encode())
    return _seen[word]


def test_search_odd_rows_and_empty(frame, odd_rows):
    out = search.search_documents(frame(odd_rows), F.col("doc_id") >= 5000).collect()
    twins = [(r.rank, r.doc_id) for r in out if r.query_id == 5000]
    assert sorted(twins)[:2] == [(1, 5000), (1, 5000)]           # both repeated rows ask
    assert search.search_documents(frame([]), F.col("doc_id") == 1).count() == 0


# mixing

@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(1, 9), st.integers(0, 40)), min_size=1))
def test_pfair_schedule(sources):
    parts = {s: w for s, (w, _) in sources.items()}
    blocks = {s: n for s, (_, n) in sources.items()}
    phases = mixing.schedule(blocks, parts)
    slots = sorted((mixing.slot_of(phases, s, b), s) for s in blocks for b in range(blocks[s]))
    assert [t for t, _ in slots] == list(range(sum(blocks.values())))
    for p in phases:                         # less than one block from target, all through the phase
        total, seen = sum(parts[s] for s in p.first), collections.Counter()
        length = sum(p.until[s] - p.first[s] for s in p.first)
        for i in range(length):
            seen[slots[p.start + i][1]] += 1
            for s in p.first:
                assert abs(seen[s] - Fraction((i + 1) * parts[s], total)) < 1


def test_positions(frame, odd_rows):
    targets = {"src0": 3, "src1": 1, mixing.OTHER: 1}
    docs = frame(odd_rows)
    out = mixing.positions(docs, targets, block=4).collect()
    assert sorted(r.position for r in out) == list(range(len(odd_rows)))
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(d for d, _ in odd_rows)
    assert {r.pool for r in out if r.source in (None, "src2")} == {mixing.OTHER}
    for pool in {r.pool for r in out}:
        own = sorted((r.source_rank, r.position, r.slot) for r in out if r.pool == pool)
        assert [x[0] for x in own] == list(range(len(own))) and own == sorted(own, key=lambda x: x[1])
        assert all(a[2] == b[2] for a, b in zip(own, own[1:]) if a[0] // 4 == b[0] // 4)
    mixed = mixing.mixed(docs, targets, block=4)
    assert mixed.columns == docs.columns
    place = {r.doc_id: r.position for r in out}
    order = [r.doc_id for r in mixed.collect()]
    unique = [d for d in order if d is not None and d < 5000]
    assert unique == sorted(unique, key=place.get)


def test_mixing_empty_and_bad_targets(frame):
    assert mixing.positions(frame([]), {mixing.OTHER: 1}).count() == 0
    with pytest.raises(ValueError):
        mixing.positions(frame([]), {"a": 1})


# packing

def check_packing(out, rows, capacity):
    encode = packing.Tokenizer()
    ids = [np.array(encode.ids(t or "") + [0], "<u4") for _, t in rows]
    want = collections.Counter()
    for (d, _), x in zip(rows, ids):
        for n, (a, size) in enumerate(packing.cut(len(x), capacity)):
            want[d, n, a, size, zlib.crc32(x[a:a + size].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, size in sorted(b):
            assert offset == end
            end += size
        assert end <= capacity
    return len(bins), sum(map(len, ids))


@pytest.mark.parametrize("capacity,chunk", [(2048, 50_000), (64, 8), (2048, 2)])
def test_packing(frame, odd_rows, capacity, chunk):
    out = packing.pack(frame(odd_rows), capacity=capacity, chunk=chunk).collect()
    bins, tokens = check_packing(out, odd_rows, capacity)
    if chunk > 100:
        assert bins <= 1.02 * tokens / capacity + 1


def test_tokens_equal_the_json_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    plain, ours = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Tokenizer()
    r = random.Random(2)
    texts = ["".join(r.choice(list("ab '\n\t  é😀1٣_\x1f\x85") + ["<|endoftext|>", "'ll"]) for _ in range(r.randint(0, 50))) for _ in range(500)]
    assert [plain.encode(t, add_special_tokens=False).ids for t in texts] == [ours.ids(t) for t in texts]


def test_endless_runs_are_packed_whole(frame):
    """Two million blanks, line breaks or letters in a row, by the operator and the pipeline's stage."""
    import public_tokenizers
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {1: "a" + " " * 2_000_000 + "b", 2: "x" * 2_000_000, 3: "\n" * 2_000_000, 4: " " * packing.LONG_RUN, 5: "short"}
    want = {d: len(plain.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts.items()}
    docs = frame(list(texts.items()))
    for out in (packing.pack(docs), corpus_pipeline.packing_stage(docs.sparkSession, docs, "")):
        assert {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want
    assert packing.Tokenizer().ids(texts[1]) == plain.encode(texts[1], add_special_tokens=False).ids


def test_best_fit_and_empty(frame):
    assert sorted(map(sorted, packing.best_fit([6, 5, 5, 4], 10))) == [[0, 3], [1, 2]]
    assert packing.cut(5, 2) == [(0, 1), (1, 2), (3, 2)] and packing.cut(4, 2) == [(0, 2), (2, 2)]
    assert packing.pack(frame([])).count() == 0


# language model

@pytest.mark.parametrize("filter_bytes,head", [(lmscore.MAX_FILTER_BYTES, lmscore.HEAD_WORDS), (2000, 20)])
def test_lm_scores(frame, odd_rows, filter_bytes, head):
    out = lmscore.score_documents(frame(odd_rows), max_filter_bytes=filter_bytes, head_words=head).collect()
    want = brute.lm(odd_rows)
    got = collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out)
    assert got == collections.Counter((d, *w[:4], round(w[4], 5)) for (d, _), w in zip(odd_rows, want))
    # estimated counts: within a few per cent in all of the exact model
    assert sum(r.score for r in out) == pytest.approx(sum(w[5] for w in want), rel=0.05)


def test_lm_held_out_gain(frame):
    """On texts it has not seen the pair model beats the single-word model."""
    r = random.Random(9)
    follow = {i: r.sample(range(200), 3) for i in range(200)}
    rows = []
    for d in range(150):
        w = [r.randrange(200)]
        for _ in range(120):
            w.append(r.choice(follow[w[-1]]))
        rows.append((d, " ".join(f"v{x}" for x in w)))
    out = [x for x in lmscore.score_documents(frame(rows)).collect() if x.held_out]
    assert out and sum(x.score for x in out) > 0.8 * sum(x.base_score for x in out)


def test_filter_counts_back():
    n = np.random.Generator(np.random.PCG64(1))
    grams = np.unique(n.integers(0, 2 ** 52, 20_000, np.uint64))        # all in segment 0
    counts = n.integers(1, 200, len(grams))
    bits = lmscore.build_segment(grams, counts)
    part = lmscore.Filter({0: len(bits)}, [(0, bits)], np.ones(1 << lmscore.SEGMENT_BITS, bool))
    exact = lmscore.estimate(lmscore.level(counts))
    got = part.count(grams)
    assert (got >= exact).all() and (got == exact).mean() > 0.97
    others = n.integers(0, 2 ** 52, 20_000, np.uint64)
    assert (part.count(others) == 0).mean() > 0.97
    assert lmscore.estimate(np.array([0, 1, 2, 3])).tolist() == [0, 1, 2.5, 5.5]


def test_filter_false_hits():
    """About 1 % of the n-grams that are no members hit, not 2 %."""
    n = np.random.Generator(np.random.PCG64(3))
    bits = lmscore.build_segment(np.unique(n.integers(0, 2 ** 52, 20_000, np.uint64)), np.ones(20_000, np.int64))
    part = lmscore.Filter({0: len(bits)}, [(0, bits)], np.ones(1 << lmscore.SEGMENT_BITS, bool))
    assert (part.count(n.integers(0, 2 ** 52, 50_000, np.uint64)) > 0).mean() < 0.015


def test_lm_empty_and_no_training(frame):
    assert lmscore.score_documents(frame([])).count() == 0
    held = [(d, "some words") for d in range(60) if zlib.crc32(str(d).encode()) % 7 == 2][:3]
    for r in lmscore.score_documents(frame(held)).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and r.base_score == 0


# near-dedup

@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(frame, rows, k):
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(rows), k=k).collect()}
    ids, _ = brute.near_components(rows, k)
    assert out == {d: (len(brute.shingles(t, k)), ids[i], ids[i] == d) for i, (d, t) in enumerate(rows)}
    assert sum(not x[2] for x in out.values()) > 10


def test_near_duplicates_odd_rows(frame, odd_rows):
    ids, groups = brute.near_components(odd_rows, 5)
    got = collections.Counter((r.doc_id, r.component_id) for r in minhash.near_duplicates(frame(odd_rows)).collect())
    assert got == collections.Counter((d, ids[i]) for i, (d, _) in enumerate(odd_rows))
    docs = frame(odd_rows)
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert left.count() == len(groups)
    assert minhash.near_duplicates(frame([])).count() == 0 and minhash.drop_near_duplicates(frame([])).count() == 0


def test_hot_bucket_loses_no_component(frame):
    """A bucket of many that differ from its least member but link among themselves."""
    r = random.Random(8)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for d in range(90):
        w = list(base)
        for i in r.sample(range(0, 100, 9), r.randint(0, 4)):
            w[i] = f"z{r.randrange(4)}"
        rows.append((d, " ".join(w)))
    ids, _ = brute.near_components(rows, 5)
    out = {x.doc_id: x.component_id for x in minhash.near_duplicates(frame(rows)).collect()}
    assert out == {d: ids[i] for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(1, 2), (4, 3), (2, 1), (5, 5), (9, 4)]])
def test_components(spark, edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    out = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert out == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# pipeline

def test_pipeline_matches_brute_force(spark, frame):
    rows = make_rows(seed=3, n=40)
    docs = frame(rows)
    kept = [(d, t) for d, t in rows if not brute.quality(t)[5]]
    lines = brute.kept_lines(kept)
    cut = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i in lines[d] or not brute.WORD.search(x))) for d, t in kept if lines[d]]
    _, groups = brute.near_components(cut, 5)
    left = [min(cut[i] for i in g) for g in groups.values()]
    for (name, stage), want in zip(corpus_pipeline.STAGES, (kept, cut, left, left)):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert collections.Counter((r.doc_id, r.text) for r in docs.collect()) == collections.Counter(want), name
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, "").collect(), left, 2048)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "mixing", "packing"]


def test_packed_sequences_keep_the_mix(spark, frame):
    """Prefixes of the packed output stay near the targets, the longest texts being
    all of one source."""
    rows = [(d, " ".join([f"w{d}"] * (60 if d % 5 > 2 else 10))) for d in range(6000)]
    docs = frame(rows, partitions=1)         # a fifth null, src1, src2 each, two fifths src0
    out = corpus_pipeline.packing_stage(spark, docs, "").collect()
    check_packing(out, rows, 2048)
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    parts = {s: corpus_pipeline.TARGETS[s or mixing.OTHER] for s in ("src0", "src1", "src2", None)}
    share = parts["src0"] / sum(parts.values())
    seen = 0
    for n, r in enumerate(sorted(out, key=lambda r: (r.sequence_id, r.offset))[:4500], 1):     # src0 lasts for 5,000
        seen += source[r.doc_id] == "src0"
        assert abs(seen - share * n) <= packing.WINDOW * (1 - share) + 2 * mixing.BLOCK


def test_open_bins_of_windows_are_merged(frame):
    """What windows leave open is packed on, in the rounds of ``pack``, neighbours together."""
    rows = [(d, " ".join(["w"] * (5 + d * 7 % 23))) for d in range(400)]
    docs = frame(rows).withColumn("at", F.col("doc_id"))
    plain, _ = check_packing(packing.pack(docs, capacity=64).collect(), rows, 64)
    for chunk in (50_000, 16):
        out = packing.pack_in_order(docs, "at", capacity=64, window=4, chunk=chunk).collect()
        bins, _ = check_packing(out, rows, 64)
        assert bins <= plain * (1.03 if chunk > 100 else 1.2)
        firsts = collections.defaultdict(list)
        for r in out:
            firsts[r.sequence_id].append(r.doc_id)
        least = [min(firsts[i]) for i in sorted(firsts)]
        assert least == sorted(least)
    assert packing.pack_in_order(frame([]).withColumn("at", F.col("doc_id")), "at").count() == 0


def test_pipeline_on_an_empty_table(spark, frame):
    docs = frame([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
