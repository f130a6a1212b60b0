"""The queries of the training-data operators (and their DuckDB SQL)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlake.llm import collocations, convtrie, langid, linededup, lmscore, minhash, mixing, packing, quality, search, secrets, sharding, substrings
from vendorlake.llm.common import documents
from vendorlake.llm.oracle import ORACLE_SQL  # noqa: F401 - read beside QUERIES
from vendorlake.session import scratch_path

SHARDS = 24
#: Parts of the mix per source; what is not named shares the parts of mixing.OTHER.
TARGETS = {"src0": 12, **{f"src{i}": 3 + i % 4 for i in range(1, 20)}, mixing.OTHER: 4}


def op10_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 equal shards, and the shard each would have among 25."""
    out = sharding.shard_table(documents(spark, sf_dir), "doc_id",
                               {s: 1.0 for s in range(SHARDS)}, grown={SHARDS: 1.0})
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                      "grown_shard")


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, through a ledger that starts empty."""
    ledger = secrets.Ledger(spark, scratch_path(spark, "secret-ledger"))
    found = secrets.scan_versions(documents(spark, sf_dir).select("doc_id", "text"), ledger)
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secrets.BASE_RULES]))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
                        secrets.span_text(F.col("spans")).alias("spans"))


def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, its own failure and the verdict with its host's."""
    out = quality.judge(documents(spark, sf_dir))
    return out.select("doc_id", "f.n_words", "f.word_chars", "f.n_symbols", "f.n_dup_lines", "f.n_repeat_words",
                      "base_failed", "kept", "host", "host_docs", "host_rejected")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(documents(spark, sf_dir))


def op2_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the mix of the sources."""
    return mixing.positions(documents(spark, sf_dir).select("doc_id", "source"), TARGETS, key="doc_id")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near copies, on 4-word shingles."""
    return minhash.near_duplicates(documents(spark, sf_dir), k=4).drop("component", "tkey")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document that no earlier line resembles."""
    return linededup.line_report(documents(spark, sf_dir))


def op9_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated passages."""
    return substrings.removal_report(documents(spark, sf_dir))


def op6_bloom_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every document, learned from six sevenths of them."""
    return lmscore.score_documents(documents(spark, sf_dir))


def op1_bmw_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 20, by all its words."""
    return search.search_documents(documents(spark, sf_dir), F.col("doc_id") % 20 == 0)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of them."""
    return langid.identify(documents(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language."""
    return collocations.collocations(documents(spark, sf_dir))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all conversations."""
    return convtrie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op11_conversation_trie": op11_conversation_trie,
           "op13_collocations": op13_collocations,
           "op12_language_id": op12_language_id,
           "op1_bmw_bm25_search": op1_bmw_bm25_search,
           "op6_bloom_lm_scores": op6_bloom_lm_scores,
           "op9_debruijn_dedup": op9_debruijn_dedup,
           "op8_line_dedup": op8_line_dedup,
           "op7_minhash_near_dedup": op7_minhash_near_dedup,
           "op2_pfair_mixing": op2_pfair_mixing,
           "op4_best_fit_packing": op4_best_fit_packing,
           "op3_host_quality": op3_host_quality,
           "op5_secret_ledger": op5_secret_ledger,
           "op10_rendezvous_sharding": op10_rendezvous_sharding}
