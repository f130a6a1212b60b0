"""Operator 2: mixing sources to target weights by Pfair scheduling.

A source with w of D parts gets its i-th block released at floor(i D / w) and
due at ceil((i + 1) D / w); earliest deadline first then keeps every source less
than one block from its target at all times.  With whole parts the schedule
repeats every D slots, so one period is scheduled and every block of the corpus
finds its slot by arithmetic.  When a source runs out, a new phase begins with
the parts of those that are left: no row is dropped or repeated.
"""
from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlake.llm.common import fresh, number_within

#: Sources without a target of their own (null too) are mixed as one.
OTHER = "(other)"
BLOCK = 64
#: Bound on the rows of the schedule that is broadcast.
MAX_PATTERN = 1_000_000


def period(parts: Mapping[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period of sum(parts) slots."""
    total = sum(parts.values())
    jobs = sorted((i * total // w, -(-(i + 1) * total // w), name) for name, w in parts.items() for i in range(w))
    slots: dict[str, list[int]] = {name: [] for name in parts}
    due: list[tuple[int, str]] = []
    nth = 0
    for t in range(total):
        while nth < len(jobs) and jobs[nth][0] <= t:
            heapq.heappush(due, (jobs[nth][1], jobs[nth][2]))
            nth += 1
        slots[heapq.heappop(due)[1]].append(t)
    return slots


@dataclass(frozen=True)
class Phase:
    start: int                        # first slot
    total: int                        # slots of a period
    first: dict[str, int]             # blocks of each source before the phase
    until: dict[str, int]             # and at its end
    slots: dict[str, list[int]]


def schedule(blocks: Mapping[str, int], parts: Mapping[str, int]) -> list[Phase]:
    """Phases that place ``blocks`` whole blocks of each source."""
    done = {s: 0 for s, n in blocks.items() if n > 0}
    phases, start = [], 0
    while done:
        shared = math.gcd(*(parts[s] for s in done))
        now = {s: parts[s] // shared for s in done}
        slots, total = period(now), sum(now.values())

        def last(s: str) -> int:
            rounds, i = divmod(blocks[s] - done[s] - 1, now[s])
            return rounds * total + slots[s][i]

        length = min(last(s) for s in done) + 1
        until = {s: done[s] + length // total * now[s] + bisect_left(slots[s], length % total) for s in done}
        phases.append(Phase(start, total, dict(done), until, slots))
        start += length
        done = {s: n for s, n in until.items() if n < blocks[s]}
    return phases


def slot_of(phases: list[Phase], source: str, block: int) -> int:
    for p in phases:
        if source in p.first and p.first[source] <= block < p.until[source]:
            rounds, i = divmod(block - p.first[source], len(p.slots[source]))
            return p.start + rounds * p.total + p.slots[source][i]
    raise ValueError((source, block))


def _placed(rows: DataFrame, targets: Mapping[str, int], source: str, key: str, block: int,
            names: tuple[str, str, str, str]) -> DataFrame:
    """``rows`` with (pool, rank, slot, position) under ``names``."""
    if not targets or min(targets.values()) < 1 or OTHER not in targets:
        raise ValueError(f"targets need whole parts of 1 or more, and those of {OTHER!r}")
    pool, rank, slot, position = names
    named = [s for s in targets if s != OTHER]
    pooled = rows.withColumn(pool, F.when(F.col(source).isin(named), F.col(source)).otherwise(F.lit(OTHER)))
    counts = {r[pool]: r["n"] for r in pooled.groupBy(pool).agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = {s: -(-n // block) for s, n in counts.items()}          # at most len(targets) rows
    phases = schedule(blocks, targets)
    pattern = [(s, p.first[s], p.until[s], i, p.start + t, len(p.slots[s]), p.total)
               for p in phases for s in p.slots for i, t in enumerate(p.slots[s])]
    if len(pattern) > MAX_PATTERN:
        raise ValueError(f"the schedule has {len(pattern)} rows; use smaller parts")
    spark = rows.sparkSession
    c = {x: fresh(rows, f"_{x}") for x in ("s", "first", "until", "i", "start", "w", "total")}
    pat = F.broadcast(spark.createDataFrame(
        pattern, ", ".join(f"{c[x]} {'string' if x == 's' else 'bigint'}" for x in c)))
    numbered = number_within(pooled, pool, [key], rank)
    nth = F.floor(F.col(rank) / block)
    since = nth - F.col(c["first"])
    at = numbered.join(pat, (F.col(pool) == F.col(c["s"])) & (nth >= F.col(c["first"])) & (nth < F.col(c["until"]))
                       & (since % F.col(c["w"]) == F.col(c["i"])))
    at = at.withColumn(slot, F.col(c["start"]) + F.floor(since / F.col(c["w"])) * F.col(c["total"]))
    # only the last block of a source is short: later slots move up by what it lacks
    short = [(slot_of(phases, s, blocks[s] - 1), blocks[s] * block - n) for s, n in counts.items()]
    lacking = F.lit(0).cast("long")
    for s, n in short:
        if n:
            lacking = lacking + F.when(F.col(slot) > s, n).otherwise(0)
    return (at.withColumn(position, F.col(slot) * block + F.col(rank) % block - lacking)
            .select(*pooled.columns, rank, slot, position))


def positions(docs: DataFrame, targets: Mapping[str, int], source: str = "source", key: str = "doc_id",
              block: int = BLOCK) -> DataFrame:
    """key, source, pool, source_rank, slot, position of every row.

    Within a source the order is a fixed shuffle by the hash of the key.
    ``position`` counts all rows from 0 without gaps; slot t holds one block.
    Targets whose whole parts need a pattern of more than MAX_PATTERN slots are
    refused: use smaller parts.
    Null or unnamed sources form the pool OTHER; null keys and repeated rows get
    a place each; an empty table gives no rows.
    """
    rows = docs.select(F.col(key), F.col(source))
    return _placed(rows, targets, source, key, block, ("pool", "source_rank", "slot", "position"))


def placed(docs: DataFrame, targets: Mapping[str, int], out: str, source: str = "source", key: str = "doc_id",
           block: int = BLOCK) -> DataFrame:
    """``docs`` with the position of each row, as ``positions`` has it, as ``out``."""
    names = (*(fresh(docs, x) for x in ("_pool", "_rank", "_slot")), out)
    return _placed(docs, targets, source, key, block, names).select(*docs.columns, out)


def mixed(docs: DataFrame, targets: Mapping[str, int], source: str = "source", key: str = "doc_id",
          block: int = BLOCK) -> DataFrame:
    """``docs`` in the order of the mix: range-partitioned and sorted by position,
    so that files written from it hold the mix, in the order of their names."""
    position = fresh(docs, "_position")
    out = placed(docs, targets, position, source, key, block)
    return out.repartitionByRange(position).sortWithinPartitions(position).select(*docs.columns)
