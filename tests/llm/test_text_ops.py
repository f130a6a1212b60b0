"""Word handling, quality rules (3), line dedup (8), substring dedup (9)."""
import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from vendorlake.llm import linededup, quality, substrings, textops


@pytest.mark.parametrize("lower", [False, True])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_and_windows(lower, kind):
    r = random.Random(5)
    texts = ["".join(r.choice("ab \n\té\x1fZ") for _ in range(r.randint(0, 40))) for _ in range(200)] + [None, "", " ", "x" * 99]
    r.shuffle(texts)
    array = pa.array(texts, kind).slice(3, 180)
    w = textops.Words(array, lower)
    want = [brute.words(t, lower) for t in array.to_pylist()]
    assert w.counts.tolist() == [len(x) for x in want]
    assert [bytes(w.data[s:e]) for s, e in zip(w.starts, w.ends)] == [y for x in want for y in x]
    for k in (1, 2, 3, 8, 35):
        at, h = w.windows(k)
        runs = [tuple(x[i:i + k]) for x in want for i in range(len(x) - k + 1)]
        assert len(runs) == len(h) and len(set(zip(runs, h.tolist()))) == len(set(runs)) == len(set(h.tolist()))
    assert sum(len(x) for _, x in textops.pieces(array, 50)) == 180


def test_long_words_hash_alike_in_any_place():
    word = "y" * (textops._PIECE + 5)
    a = textops.Words(pa.array([word + " z", "z " + word]))
    assert a.hashes[0] == a.hashes[3] and a.hashes[1] == a.hashes[2]


def test_quality_matches_brute_force(frame, odd_rows):
    out = quality.judge(frame(odd_rows)).select("doc_id", "f.*", "base_failed", "kept", "host_rejected").collect()
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    assert got == collections.Counter((d, *brute.quality(t)) for d, t in odd_rows)
    assert all(r.kept == (not r.base_failed and not r.host_rejected) for r in out)


def test_hosts_are_shrunk_and_rejected(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "too short"
    rows = [("clean", good)] * 40 + [("mixed", good)] * 30 + [("mixed", bad)] * 5 + [("rotten", bad)] * 38 + [("rotten", good)] * 2 \
        + [("tiny", bad)] + [(None, good)] * 3
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id bigint, text string, source string")
    out = quality.judge(docs, keep=("doc_id",)).collect()
    rejected = {r.host for r in out if r.host_rejected}
    assert "rotten" in rejected and not rejected & {"clean", "mixed", None}
    kept = {r.doc_id for r in out if r.kept}
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == kept
    one = quality.host_verdicts(docs.select("source", quality.features(docs.text).alias("f")), "source")
    a, b = quality.beta_prior(one, "short")
    assert 0 < a < b


def test_quality_empty(frame):
    assert quality.judge(frame([])).count() == 0 and quality.keep_good(frame([])).count() == 0


def test_lines_match_brute_force(frame, rows):
    want = brute.kept_lines(rows)
    out = {r.doc_id: (r.n_lines, r.n_kept, r.n_removed, r.kept_lines) for r in linededup.line_report(frame(rows)).collect()}
    n = {d: sum(1 for x in (t or "").split("\n") if brute.WORD.search(x)) for d, t in rows}
    assert out == {d: (n[d], len(k), n[d] - len(k), k) for d, k in want.items()}
    assert sum(r[2] for r in out.values()) > 50
    docs = frame(rows)
    left = {r.doc_id: (r.text, r.n_chars) for r in linededup.drop_repeated_lines(docs, length="n_chars").collect()}
    for d, t in rows:
        if brute.WORD.search(t or "") and not want[d]:
            assert d not in left
        elif t is None:
            assert left[d][0] is None
        else:
            text = "\n".join(x for i, x in enumerate(t.split("\n")) if i in want[d] or not brute.WORD.search(x))
            assert left[d] == (text, len(text))


def test_sets_of_lines_are_sorted_by_one_number(monkeypatch):
    texts = pa.array(["b a b\nA c  d\n\n e", None, "", "one two three four five six\n" * 50, "x " * 300])
    rank = np.random.default_rng(1).integers(0, 200, linededup.CELLS).astype(np.uint8)
    plain = np.lexsort

    def slow(keys):
        raise AssertionError("sorted by several keys")

    monkeypatch.setattr(np, "lexsort", slow)
    got = [linededup._line_sets(texts, r) for r in (None, rank)]
    monkeypatch.setattr(np, "lexsort", plain)
    monkeypatch.setattr(linededup, "_ties", lambda number, h: True)              # as if hashes shared a number
    for a, b in zip(got, (linededup._line_sets(texts, r) for r in (None, rank))):
        assert a[0].equals(b[0]) and a[4] == b[4] and all((a[i] == b[i]).all() for i in (1, 2, 3, 5, 6))
    same, first = np.array([1, 1, 2], np.uint64), np.array([5, 5, 6], np.uint64)
    monkeypatch.undo()
    assert not linededup._ties(same, first) and linededup._ties(same, np.array([5, 7, 6], np.uint64))


def test_words_found_once_and_unwanted_lines_cost_nothing(frame, monkeypatch):
    """A word that is nowhere else has no list; only lines that are asked for are hashed."""
    texts = pa.array(["a b c d e\nf g h\n\nold line", "a b c d e", None])
    rank = np.full(linededup.CELLS, 1, np.uint8)
    rank[linededup.cell(textops.Words(pa.array(["a", "b"])).hashes)] = 2
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([7, -8, 9]), texts], names=["d", "t", "text"])

    class Shared:
        def __init__(self, value):
            self.value = value
    (out,) = linededup._classes_of(Shared(rank), 80)(iter([batch]))
    assert out.column("blocks").to_pylist()[0] == [0, 0] and len(out.column("prefix")[0]) == 2
    rank[:] = 2
    (out,) = linededup._classes_of(Shared(rank), 80)(iter([batch]))
    assert out.column("blocks").to_pylist()[0] == [1, 1]
    wanted = np.zeros(linededup.WANTED, bool)
    wanted[linededup._places(np.array([7]), np.array([1], np.int32))] = True
    hashed = []
    words = textops.Words
    monkeypatch.setattr(textops, "Words", lambda x, lower: hashed.extend(x.to_pylist()) or words(x, lower))
    (bodies,) = linededup._bodies_of(Shared(wanted))(iter([batch]))
    assert hashed == ["f g h"] and len(bodies) == 1 and len(bodies.column("words")[0].as_py()) == 24


def test_candidates_in_one_look_or_two(frame, rows, monkeypatch):
    want = brute.kept_lines(rows)
    for few in (0, 1 << 30):
        monkeypatch.setattr(linededup, "FEW", few)
        assert {r.doc_id: r.kept_lines for r in linededup.line_report(frame(rows)).collect()} == want


def test_lines_with_odd_keys(frame):
    same = "a line of five words\nanother line of five words"
    rows = [(None, same), (5, same), (5, same), (5, "a line of five words"), (6, "own words here only now")]
    out = collections.Counter((r.doc_id, tuple(r.kept_lines)) for r in linededup.line_report(frame(rows)).collect())
    assert out == {(None, (0, 1)): 1, (5, ()): 3, (6, (0,)): 1}
    assert linededup.line_report(frame([])).count() == 0


def test_many_alike_lines_in_one_list(frame):
    """A long list of one rare word: near lines, and lines that only share it."""
    r = random.Random(3)
    lines = []
    for i in range(120):
        common = [f"c{j}" for j in range(9)] if i % 3 else [f"u{i}_{j}" for j in range(9)]
        lines.append("rare " + " ".join(common + ([f"x{i}"] if r.random() < 0.5 else [])))
    rows = list(enumerate(lines))
    out = {x.doc_id: x.kept_lines for x in linededup.line_report(frame(rows)).collect()}
    assert out == brute.kept_lines(rows)


@pytest.mark.parametrize("named", [linededup.NAMED, (1, 2, 3), (1,)])
def test_lines_around_the_threshold(frame, named, monkeypatch):
    """Long variants of one line, some similar, most not quite: early candidates fail."""
    monkeypatch.setattr(linededup, "NAMED", named)
    r = random.Random(8)
    base = [f"w{j}" for j in range(60)]
    rows = []
    for i in range(160):
        words = [f"n{i}_{j}" if r.random() < 0.1 else w for j, w in enumerate(base)]
        r.shuffle(words)
        rows.append((i, " ".join(words) + "\n" + " ".join(r.sample(base, 20) + [f"o{i}_{j}" for j in range(r.randint(3, 6))])))
    out = {x.doc_id: x.kept_lines for x in linededup.line_report(frame(rows)).collect()}
    want = brute.kept_lines(rows)
    assert out == want and 20 < sum(0 in k for k in want.values()) < 150


def test_substrings_match_brute_force(frame, odd_rows):
    out = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removal_report(frame(odd_rows)).collect())
    want = brute.substrings([t for _, t in odd_rows])
    assert out == collections.Counter((d, *x) for (d, _), x in zip(odd_rows, want))
    assert sum(x[1] for x in want) > 1000


def test_substring_paths_cover_equal_words(frame, rows):
    rep = substrings.Repeats(frame(rows), span=20)
    by_key = {bytes(r.tkey): None for r in rep.texts.collect()}
    import hashlib
    for _, t in rows:
        by_key[hashlib.md5((t or "").encode()).digest()] = brute.words(t)
    spans = rep.spans().collect()
    assert spans
    starts = collections.defaultdict(set)
    for s in spans:
        words = by_key[bytes(s.tkey)][s.first_word:s.last_word + 1]
        assert len(words) >= 20 and s.n >= 2
        starts[s.path].add(tuple(words[:20]))
    assert all(len(x) == 1 for x in starts.values())
    got = collections.Counter((r.n_words, r.n_removed) for r in substrings.removal_report(frame(rows), span=20).collect())
    assert got == collections.Counter(x[:2] for x in brute.substrings([t for _, t in rows], 20))


def test_substrings_overlaps_inside_one_text_and_empty(frame):
    periodic = " ".join(f"p{i % 7}" for i in range(60))
    rows = [(1, periodic), (2, " ".join(f"q{i}" for i in range(80)))]
    out = {r.doc_id: r.n_removed for r in substrings.removal_report(frame(rows)).collect()}
    assert out == {1: brute.substrings([periodic])[0][1], 2: 0}
    assert substrings.removal_report(frame([])).count() == 0
    with pytest.raises(ValueError):
        substrings.Repeats(frame([]), span=8)


def test_columns_and_rules_of_any_name(spark, tmp_path):
    """Columns called like the operators' own, and rule sets of every kind."""
    from vendorlake.llm import linededup, quality, secrets
    rows = [(1, "password = abcdef123\nsame words in this line here", "x"), (2, "same words in this line here\nother", "x"), (None, None, None)]
    named = spark.createDataFrame(rows, "d long, t string, Spans string")
    got = {r.doc_id: (r.n_lines, r.n_kept) for r in linededup.line_report(named, key="d", text="t").collect()}
    assert got == {1: (2, 2), 2: (2, 1), None: (0, 0)}
    assert {r.d: r.t for r in linededup.drop_repeated_lines(named, key="d", text="t").collect()}[2] == "other"
    found = secrets.scan_versions(named, secrets.Ledger(spark, str(tmp_path / "ledger")), text="t").collect()
    assert sorted(len(r.spans) for r in found) == [0, 0, 1] and found[0].asDict().keys() == {"d", "blob", "spans"}
    docs = named.select(named.d.alias("doc_id"), named.t.alias("text"), named.Spans.alias("source"))
    for rules in ((quality.Rule("docs", "n_words < 3"),), (quality.Rule("docs", "n_words < 3", True),), ()):
        judged = {r.doc_id: r.base_failed for r in quality.judge(docs, rules=rules).collect()}
        assert judged == {1: False, 2: False, None: any(r.drops for r in rules)}
