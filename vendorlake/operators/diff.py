"""Result checks: the small-result cap and parallel-run table diffs."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendorlake.model import MAX_INLINE_ROWS
from vendorlake.session import materialize

#: Ranges at each level of the digest tree.
FAN = 4096


class ResultTooLarge(ValueError):
    pass


def capped_result(df: DataFrame, cap: int = MAX_INLINE_ROWS, name: str = "result") -> DataFrame:
    """Return ``df`` if it has at most ``cap`` rows, else raise.

    Counts at most ``cap + 1`` rows (``limit`` stops the scan early) instead
    of a full count.
    """
    n = df.limit(cap + 1).count()
    if n > cap:
        raise ResultTooLarge(f"{name}: over {cap} rows, too many for one json document; write it as parquet")
    return df


def table_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows only in ``new`` / only in ``old`` (multiset difference), tagged.

    One union and one aggregate: a row counts +1 in ``new`` and -1 in ``old``,
    and what is left of the sum is repeated that many times.
    """
    cols = new.columns
    n, side = "_n", "side"
    sums = (new.withColumn(n, F.lit(1)).unionByName(old.select(*cols).withColumn(n, F.lit(-1)))
            .groupBy(*cols).agg(F.sum(n).cast("int").alias(n)).filter(F.col(n) != 0))
    left = sums.withColumn(side, F.when(F.col(n) > 0, "only_new").otherwise("only_old"))
    return left.withColumn(n, F.explode(F.array_repeat(F.lit(0), F.abs(n)))).select(*cols, side)


def _digests(df: DataFrame, by: Sequence[str], sign: int) -> DataFrame:
    """Rows and the sum of the rows' hashes per group, of one side."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_row").cast("decimal(38,0)")).alias("digest")).select(
        *by, (F.col("n") * sign).alias("n"), (F.col("digest") * sign).alias("digest"), F.lit(sign).alias("side"), F.col("n").alias("rows"))


def _differing(new: DataFrame, old: DataFrame, by: Sequence[str]) -> DataFrame:
    """The groups whose rows differ between the sides; with the rows of each."""
    both = _digests(new, by, 1).unionByName(_digests(old, by, -1))
    return both.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("digest").alias("digest"), F.sum(F.when(F.col("side") > 0, F.col("rows"))).alias("n_new"),
        F.sum(F.when(F.col("side") < 0, F.col("rows"))).alias("n_old")).where("n <> 0 or digest <> 0").drop("n", "digest")


def diff_detail(new: DataFrame, old: DataFrame, key: Sequence[str], fan: int = FAN) -> DataFrame:
    """What differs between two versions of a table, by key and column.

    Both sides are hashed into ``fan`` ranges of the key and each range into ``fan``
    again; only ranges whose digests differ are looked into, so rows of equal ranges
    are never shuffled or compared.  Returns key, change, column, old_value,
    new_value (as text): a row for each column that changed; one without a column
    for a key on one side only (``only_new``, ``only_old``); and for a key that
    either side has more than once (``repeated``), with its numbers of rows.
    Null keys are keys; equal rows differ only in number.  Rows are told apart by
    64-bit hashes of their values.
    """
    cols = [c for c in new.columns if c not in key]
    names = list(key)

    def hashed(df: DataFrame) -> DataFrame:
        values = [x for c in cols for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
        keys = [x for c in names for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
        return df.select(*[F.col(f"`{c}`") for c in new.columns], F.pmod(F.xxhash64(*keys), F.lit(fan)).alias("_range"),
                         F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(fan)).alias("_part"), F.xxhash64(*keys, *values).alias("_row"))

    new, old = hashed(new), hashed(old)
    ranges = materialize(_differing(new, old, ["_range"]).select("_range"), "ranges")          # at most ``fan`` rows
    new, old = (df.join(F.broadcast(ranges), "_range", "left_semi") for df in (new, old))
    parts = materialize(_differing(new, old, ["_range", "_part"]).select("_range", "_part"), "parts")
    new, old = (df.join(parts, ["_range", "_part"], "left_semi") for df in (new, old))
    keys = materialize(_differing(new, old, names), "differing_keys")

    def of(df: DataFrame, side: str) -> DataFrame:
        return df.select(*names, *[F.col(f"`{c}`").cast("string").alias(f"{side}_{i}") for i, c in enumerate(cols)])

    def same(a: str) -> Column:
        return F.col(a).eqNullSafe(F.col(f"k_{a}"))

    single = keys.where("n_new = 1 and n_old = 1").select(*names)
    others = keys.where("not coalesce(n_new = 1 and n_old = 1, false)").select(
        *names, F.when((F.coalesce("n_new", F.lit(0)) > 1) | (F.coalesce("n_old", F.lit(0)) > 1), "repeated")
        .when(F.col("n_old").isNull(), "only_new").otherwise("only_old").alias("change"), F.lit(None).cast("string").alias("column"),
        F.when((F.coalesce("n_new", F.lit(0)) > 1) | (F.coalesce("n_old", F.lit(0)) > 1), F.coalesce("n_old", F.lit(0)).cast("string")).alias("old_value"),
        F.when((F.coalesce("n_new", F.lit(0)) > 1) | (F.coalesce("n_old", F.lit(0)) > 1), F.coalesce("n_new", F.lit(0)).cast("string")).alias("new_value"))
    joined = single
    for df, side in ((new, "new"), (old, "old")):
        right = of(df, side).select(*[F.col(c).alias(f"k_{c}") for c in names], *[f"{side}_{i}" for i in range(len(cols))])
        condition = same(names[0])
        for c in names[1:]:
            condition = condition & same(c)
        joined = joined.join(right, condition).drop(*[f"k_{c}" for c in names])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"old_{i}").alias("old_value"), F.col(f"new_{i}").alias("new_value"))
                      for i, c in enumerate(cols)])
    changed = joined.select(*names, F.lit("changed").alias("change"), F.inline(F.filter(pairs, lambda p: ~p["old_value"].eqNullSafe(p["new_value"]))))
    return changed.unionByName(others)
