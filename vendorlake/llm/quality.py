"""Operator 3: document quality rules with host-level verdicts.

Rules fail or pass a document.  Failures are summed per host (the ``source``),
each host's failure rate of a rule is shrunk towards the rate of all hosts by a
beta prior fitted to them, and a host whose shrunk rate is too high takes all
its documents with it.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorlake.llm import textops
from vendorlake.llm.common import fresh, stash

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True        # fixed values
_BLANKS = " \t\n\v\f\r"


def _piece_features(texts: pa.Array) -> np.ndarray:
    words = textops.Words(texts)
    n = len(texts)
    out = np.zeros((len(FEATURES), n), np.int64)
    out[0] = words.counts
    in_word = words.inside & ((words.raw & 0xC0) != 0x80)      # first byte of each code point
    symbol = _SYMBOL[words.raw]
    for i, text in enumerate(texts.to_pylist()):
        lo, hi = words.at[i], words.at[i + 1]
        out[1, i] = np.count_nonzero(in_word[lo:hi])
        out[2, i] = np.count_nonzero(symbol[lo:hi])
        lines = [x for x in (text or "").split("\n") if x.strip(_BLANKS)]
        out[3, i] = len(lines) - len(set(lines))
        out[5, i] = len(lines)
    at, h = words.windows(WINDOW)
    if len(at):
        doc = words.owner()
        order = np.lexsort((h, doc[at]))
        same = (h[order][1:] == h[order][:-1]) & (doc[at][order][1:] == doc[at][order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edges = np.zeros(len(doc) + 1, np.int64)
        np.add.at(edges, at[twice], 1)
        np.add.at(edges, at[twice] + WINDOW, -1)
        covered = np.cumsum(edges)[:-1] > 0
        out[4] = np.bincount(doc[covered], minlength=n)
    return out


@F.arrow_udf(T.StructType([T.StructField(f, T.LongType()) for f in FEATURES]))
def _features(texts: pa.Array) -> pa.Array:
    parts = [_piece_features(x) for _, x in textops.pieces(texts)]
    table = np.concatenate(parts, axis=1) if parts else np.zeros((len(FEATURES), 0), np.int64)
    return pa.StructArray.from_arrays([pa.array(x) for x in table], names=list(FEATURES))


def features(text: Column) -> Column:
    """Struct of counts over the whole text (null text: no words, all 0).

    n_words; word_chars, the code points in words; n_symbols; n_dup_lines, the
    lines with a word that equal an earlier line; n_repeat_words, the words in
    8-word windows that occur again in the text; n_lines, the lines with a word.
    """
    return _features(text)


@dataclass(frozen=True)
class Rule:
    """``fails``: SQL over the features.  ``drops``: whether a failing document
    goes by itself; the others only count towards the host's verdict."""
    name: str
    fails: str
    drops: bool = False


RULES = (
    Rule("short", "n_words < 20", True),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words", True),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("dup_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", "word_chars > 20 * n_words"),
)
#: A host goes when its shrunk failure rate of a rule exceeds this.
HOST_LIMIT = 0.5


def beta_prior(failed: DataFrame, rule: str) -> tuple[float, float]:
    """(a, b) by moments: mean and between-host variance of the failure rates,
    hosts weighted by their documents.  One row reaches the driver."""
    r = F.col(rule) / F.col("docs")
    total = failed.agg(F.sum("docs").alias("n"), F.count(F.lit(1)).alias("hosts"), F.sum(rule).alias("f"),
                       F.sum(F.col("docs") * r * r).alias("square")).first()
    if not total.n:
        return 1.0, 1.0
    mean = min(max(total.f / total.n, 1e-6), 1 - 1e-6)
    between = total.square / total.n - mean * mean - mean * (1 - mean) * total.hosts / total.n
    strength = mean * (1 - mean) / between - 1 if between > 0 else 1e6
    strength = min(max(strength, 1.0), 1e6)
    return mean * strength, (1 - mean) * strength


def host_verdicts(docs: DataFrame, host: str, rules: Sequence[Rule] = RULES,
                  limit: float = HOST_LIMIT) -> DataFrame:
    """Per host: host, docs, failures per rule (by its name; ``f_`` before one that is
    a column's here), host_rejected.

    ``docs`` has a column f with the features.  Null hosts are one host.
    """
    column = {r.name: f"f_{r.name}" if r.name in ("host", "docs", "host_rejected") else r.name for r in rules}
    fails = docs.select(F.col(host).alias("host"), "f.*")
    counts = stash(fails.groupBy("host").agg(
        F.count(F.lit(1)).alias("docs"),
        *[F.sum(F.expr(r.fails).cast("long")).alias(column[r.name]) for r in rules]), "hosts")
    rejected = F.lit(False)
    for r in rules:
        a, b = beta_prior(counts, column[r.name])
        rejected = rejected | ((F.col(column[r.name]) + a) / (F.col("docs") + a + b) > limit)
    return counts.withColumn("host_rejected", rejected)


def base_failed(f: str = "f", rules: Sequence[Rule] = RULES) -> Column:
    drops = " OR ".join(f"({r.fails})" for r in rules if r.drops) or "false"
    for name in FEATURES:
        drops = drops.replace(name, f"{f}.{name}")
    return F.expr(drops)


def judge(docs: DataFrame, text: str = "text", host: str = "source",
          rules: Sequence[Rule] = RULES, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, f (features), host verdict columns, base_failed, kept.

    Null text fails as short; an empty table gives no rows; repeated rows are
    judged and counted each.  Texts are read once; only counts are shuffled.
    """
    told = stash(docs.select(*keep, F.col(host).alias("host"), features(F.col(text)).alias("f")), "features")
    verdicts = host_verdicts(told, "host", rules)
    v = verdicts.select(F.col("host").alias("h"), F.col("docs").alias("host_docs"), "host_rejected")
    return (told.join(v, F.col("host").eqNullSafe(F.col("h"))).drop("h")
            .withColumn("base_failed", base_failed(rules=rules))
            .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source",
              rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that pass, with their columns as they were.

    Two passes over the texts (the host verdicts, then the filter) instead of a
    second copy of them.  An empty table stays empty.
    """
    verdicts = host_verdicts(docs.select(F.col(host).alias("host"), features(F.col(text)).alias("f")), "host", rules)
    f, h = fresh(docs, "_f"), fresh(docs, "_h")
    bad_hosts = verdicts.where("host_rejected").select(F.col("host").alias(h))
    good = docs.withColumn(f, features(F.col(text))).where(~base_failed(f, rules)).drop(f)
    return good.join(bad_hosts, F.col(host).eqNullSafe(F.col(h)), "left_anti")
