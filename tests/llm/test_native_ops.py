"""Sharding (10) and secret scan (5)."""
import collections
import hashlib
import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from vendorlake.llm import secrets, sharding
from vendorlake.session import scratch_path

EQUAL = {s: 1.0 for s in range(6)}


@pytest.mark.parametrize("which", ["rows", "odd_rows"])
def test_shard_table(frame, which, request):
    rows = request.getfixturevalue(which)
    out = sharding.shard_table(frame(rows), "doc_id", EQUAL, grown=EQUAL | {6: 1.0}).collect()
    want = collections.Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    by_shard, by_key = collections.defaultdict(list), collections.defaultdict(set)
    for r in out:
        by_shard[r.shard].append(r.slot)
        by_key[r.doc_id].add(r.shard)
        assert r.grown_shard in (r.shard, 6)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert all(len(s) == 1 for s in by_key.values())


def test_shares_follow_weights_and_growth_moves_few(spark):
    weights = {0: 1.0, 1: 2.0, 2: 5.0}
    keys = spark.range(20_000).select(
        sharding.shard_of(F.col("id"), weights).alias("a"), sharding.shard_of(F.col("id"), weights | {3: 2.0}).alias("b"))
    n = collections.Counter((r.a, r.b) for r in keys.collect())
    for s, w in weights.items():
        assert abs(sum(c for (a, _), c in n.items() if a == s) / 20_000 - w / 8) < 0.02
    assert all(b in (a, 3) for a, b in n)
    assert abs(sum(c for (_, b), c in n.items() if b == 3) / 20_000 - 0.2) < 0.02


def test_shards_empty_and_bad_weights(frame):
    assert sharding.shard_table(frame([]), "doc_id", EQUAL).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("doc_id"), {0: 0.0})


@pytest.fixture()
def ledger(spark):
    return secrets.Ledger(spark, scratch_path(spark, f"ledger-{uuid.uuid4().hex}"))


def test_secrets_match_brute_force(frame, odd_rows, ledger):
    found = secrets.scan_versions(frame(odd_rows).select("doc_id", "text", "n"), ledger)
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    got = collections.Counter((r.doc_id, r.s) for r in found.select("doc_id", secrets.span_text(base).alias("s")).collect())
    assert got == collections.Counter((d, ",".join(brute.secrets(t))) for d, t in odd_rows)
    assert any("assign" in s for _, s in got)
    more = {r.s for r in found.select(secrets.span_text(F.col("spans")).alias("s")).collect()}
    assert any("github" in s for s in more)


def test_ledger_scans_only_what_is_new(spark, frame, rows, ledger):
    docs = frame(rows).select("doc_id", "text")
    secrets.scan_versions(docs, ledger, secrets.BASE_RULES)
    blobs = len({t or "" for _, t in rows})
    assert ledger.pairs().count() == 3 * blobs
    found = ledger.findings().count()
    new = frame([(9000, "token = zzzzzzzz1"), (9001, rows[0][1])]).select("doc_id", "text")
    secrets.scan_versions(docs.union(new), ledger, secrets.BASE_RULES)
    assert ledger.pairs().count() == 3 * (blobs + 1) and ledger.findings().count() == found + 1
    # a new version of one rule is scanned against all blobs, the others are not
    newer = (*secrets.BASE_RULES[:2], secrets.Rule("hex", "[0-9a-f]{30,}", 30, version=2))
    out = secrets.scan_versions(docs, ledger, newer)
    assert ledger.pairs().count() == 4 * blobs + 3
    assert out.count() == len(rows)
    # what a run left that never committed does not count
    ledger.pairs().limit(1).withColumn("run", F.lit("dead")).write.mode("append").parquet(f"{ledger.folder}/pairs")
    assert ledger.pairs().count() == 4 * blobs + 3


def test_secrets_empty_table(frame, ledger):
    assert secrets.scan_versions(frame([]).select("doc_id", "text"), ledger).count() == 0


def test_null_text_is_the_empty_blob(frame, ledger):
    row = secrets.scan_versions(frame([(1, None)]).select("doc_id", "text"), ledger).first()
    assert bytes(row.blob).hex() == hashlib.sha256(b"").hexdigest() and row.spans == []


def test_numbers_of_a_hot_key_are_dealt_out(spark):
    """A third of the rows without a key: whole numbers, in many buckets."""
    from vendorlake.llm import common
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"), (F.col("id") % 2).alias("g"), F.lit("x").alias("_row"))
    got = common.number_within(rows, "g", ["k"], "at", per_bucket=100)
    assert got.columns == ["k", "g", "_row", "at"] and got.count() == 30_000
    for r in got.groupBy("g").agg(F.count_distinct("at").alias("d"), F.min("at").alias("a"), F.max("at").alias("b")).collect():
        assert (r.d, r.a, r.b) == (15_000, 0, 14_999)
    assert sorted(map(tuple, got.select("k", "g").collect()), key=str) == sorted(map(tuple, rows.select("k", "g").collect()), key=str)


def test_known_texts_are_not_moved(spark, tmp_path, monkeypatch):
    """A second scan of the same versions looks at no text; a new one at that text only."""
    rows = [(i, f"password = secret{i:04d}") for i in range(30)] + [(99, None)]
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    seen = []
    scan = secrets.scan_blobs
    monkeypatch.setattr(secrets, "scan_blobs", lambda blobs, rules: seen.append(blobs.count()) or scan(blobs, rules))
    for extra, limit in (([], 20_000), ([], 20_000), ([(100, "token = abcdefgh")], 20_000), ([(101, "token = hgfedcba")], 0)):
        rows = rows + extra
        monkeypatch.setattr(secrets, "MAX_BROADCAST", limit)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = {r.doc_id: len(r.spans) for r in secrets.scan_versions(docs, ledger).collect()}
        assert found == {d: int(t is not None) for d, t in rows}
    assert seen == [31, 0, 1, 1]
