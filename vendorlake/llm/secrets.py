"""Operator 5: secret scan with an incremental blob ledger.

Every version of a file is addressed by the SHA-256 of its content.  The ledger
remembers which (blob, rule, rule version) pairs were scanned and what was
found; a scan reads only the pairs it has not seen, one text per blob, and then
joins the findings back to all paths.  Built-in functions only.
"""
from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vendorlake.llm.common import discard, stash, utf8


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has at
    least ``least`` characters.  A changed rule needs a new version."""
    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    version: int = 1

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules of the contract, in its order.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),   # runs are maximal, so shorter ones can be skipped at once
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
)
RULES = BASE_RULES + MORE_RULES

_PAIRS = "blob binary, rule string, run string"
_FINDINGS = "blob binary, rule string, start bigint, end bigint, run string"


def blob_id(text: Column) -> Column:
    """Content address; null text is the empty blob."""
    return F.unhex(F.sha2(utf8(text), 256))


class Ledger:
    """Append-only tables in one folder.  A run writes its findings and its
    scanned pairs, and then one row in ``runs``; rows of a run that is not there
    never count, so a run that died is simply repeated."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}")

    def _committed(self, table: str, schema: str) -> DataFrame:
        # a row per scan ever made: small enough for the planner to broadcast
        return self._read(table, schema).join(self._read("runs", "run string"), "run", "left_semi")

    def pairs(self) -> DataFrame:
        return self._committed("pairs", _PAIRS)

    def findings(self) -> DataFrame:
        return self._committed("findings", _FINDINGS)

    def append(self, pairs: DataFrame, findings: DataFrame, run: str) -> None:
        findings.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{self.folder}/findings")
        pairs.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{self.folder}/pairs")
        self.spark.range(1).select(F.lit(run).alias("run")).coalesce(1).write.mode("append").parquet(f"{self.folder}/runs")


def _matches(text: Column, rule: Rule, due: Column) -> Column:
    """Per match of the rule: (gap before it, its length, length of the group).

    The pieces between the matches come from splitting at the same pattern, so
    running sums of gaps and lengths give the places, in code points.
    """
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    rows = F.transform(F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap")),
                       lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("len"),
                                          F.length(F.regexp_extract(x["hit"], rule.pattern, rule.group)).alias("held")))
    return F.when(due & text.rlike(rule.pattern), rows)


#: Addresses that are broadcast to find their texts (2 MB); more are joined.
MAX_BROADCAST = 20_000


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(blob, rule, start, end) of the matches in ``blobs`` (blob, text, due tags)."""
    found = blobs.select("blob", F.explode(F.array(*[
        F.struct(F.lit(r.tag).alias("rule"), F.lit(r.least).alias("least"),
                 _matches(F.col("text"), r, F.array_contains("due", r.tag)).alias("hits")) for r in rules])).alias("x"))
    hits = found.where(F.size("x.hits") > 0).select(
        "blob", "x.rule", "x.least", F.posexplode("x.hits").alias("i", "hit"))
    so_far = Window.partitionBy("blob", "rule").orderBy("i")
    end = F.sum(F.col("hit.gap").cast("long") + F.col("hit.len")).over(so_far)
    return (hits.withColumn("end", end).where(F.col("hit.held") >= F.col("least"))
            .select("blob", "rule", (F.col("end") - F.col("hit.len")).alias("start"), "end"))


def scan_versions(versions: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES,
                  text: str = "text") -> DataFrame:
    """Scan what the ledger has not seen; return ``versions`` without its text,
    plus ``blob`` and ``spans`` (array of start, kind, end; by start, then rule order).

    ``versions``: a row per path or version; all columns but the text are kept, but
    that columns of its own called blob or spans (any case) give way.  Null
    text: empty.  Repeated rows and copies are scanned once and all get the
    spans.  An empty table gives no rows.
    """
    tags = [r.tag for r in rules]
    seen = ledger.pairs().where(F.col("rule").isin(tags)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    # the ledger is asked by address; only texts with something due are moved
    all_tags = F.array(*[F.lit(t) for t in tags])
    due = stash(versions.select(blob_id(F.col(text)).alias("blob")).distinct().join(seen, "blob", "left")
                .select("blob", F.array_except(all_tags, F.coalesce("seen", F.array().cast("array<string>"))).alias("due"))
                .where(F.size("due") > 0), "due")
    few = due.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    texts = versions.select(blob_id(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    wanted = texts.join(F.broadcast(due) if few else due, "blob").dropDuplicates(["blob"])
    found = stash(scan_blobs(wanted, rules), "found")
    ledger.append(due.select("blob", F.explode("due").alias("rule")), found, uuid.uuid4().hex)
    discard(found, due)

    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.tag), F.lit(i))])
    per_blob = (ledger.findings().where(F.col("rule").isin(tags))
                .groupBy("blob").agg(F.array_sort(F.collect_list(F.struct(
                    "start", order[F.col("rule")].alias("nth"), "end"))).alias("spans")))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    named = stash(per_blob.withColumn("spans", F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), F.get(kinds, s["nth"]).alias("kind"), s["end"].alias("end")))), "per-blob")
    kept = [c for c in versions.columns if c != text and c.lower() not in ("blob", "spans")]
    paths = versions.select(*[F.col(f"`{c}`") for c in kept], blob_id(F.col(text)).alias("blob"))
    return (paths.join(named, "blob", "left")
            .withColumn("spans", F.coalesce("spans", F.array().cast(named.schema["spans"].dataType)))
            .select(*paths.columns, "spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
