"""The tries of operator 13: dense arrays, several in one pass over the texts."""
import numpy as np

from vendorlake.llm import collocations


def _random_trie(rng, n, vocabulary):
    symbols = np.unique(rng.integers(0, 2 ** 64, vocabulary, dtype=np.uint64))
    symbols[0], symbols[-1] = 0, np.uint64(2 ** 64 - 1)
    heavy = rng.zipf(1.3, (n, 3)) % len(symbols)                       # some words have many successors
    phrases = sorted({tuple(int(i) for i in row[:rng.integers(1, 4)]) for row in heavy})
    counts = np.array([len(p) for p in phrases])
    words = symbols[np.concatenate([np.array(p) for p in phrases])]
    return symbols, phrases, collocations.Trie.build(words, counts)


def test_half_of_a_tries_slots_are_used():
    _, phrases, trie = _random_trie(np.random.default_rng(5), 60_000, 20_000)
    used = int((trie.check >= 0).sum())
    assert len(trie.check) < 2.5 * used + 8192                          # five times and more when spans were kept whole
    assert len(trie.base) == len(trie.check) == len(trie.accept) and trie.base.min() >= 0
    assert int((trie.accept >= 0).sum()) == len(phrases)


def test_dense_tries_count_like_a_dictionary():
    rng = np.random.default_rng(6)
    symbols, phrases, trie = _random_trie(rng, 3_000, 300)
    text = np.append(rng.zipf(1.3, 4_000) % len(symbols), [0, len(symbols) - 1])
    run = np.cumsum(rng.random(len(text)) < 0.1)
    words = symbols[text]
    words[::50] = np.uint64(12345)                                      # in no phrase
    text[::50] = -1
    want = [sum(tuple(text[i:i + len(p)]) == p and len(set(run[i:i + len(p)])) == 1 for i in range(len(text) - len(p) + 1))
            for p in phrases[:200]]
    assert trie.count(words, run, 3)[:200].tolist() == want
    assert trie.numbers(np.array([0, 2 ** 64 - 1, 12345], np.uint64)).tolist() == [
        int(np.searchsorted(trie.symbols, s)) + 1 if s in trie.symbols else 0 for s in (np.uint64(0), np.uint64(2 ** 64 - 1), np.uint64(12345))]


def test_a_pass_counts_several_tries(spark, monkeypatch):
    rows = spark.createDataFrame([(f"w{i % 7} w{i % 5} w{i % 3} end", "en") for i in range(400)], "text string, lang string")
    passes, count = [], collocations._count
    monkeypatch.setattr(collocations, "_count", lambda tries, longest: passes.append(sorted(tries)) or count(tries, longest))
    phrases, _ = collocations.candidates(rows, 5, 3)
    phrases = phrases.localCheckpoint()
    one = {tuple(r) for r in collocations.frequencies(rows, phrases, 3).collect()}
    some = {tuple(r) for r in collocations.frequencies(rows, phrases, 3, entries=15).collect()}
    assert one == some and len(one) > 50 and passes[0] == [0] and len(passes[1]) == 2
    assert len(passes) - 1 < len({p for x in passes[1:] for p in x})
