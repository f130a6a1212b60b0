"""Data tests of the canonical model, and the per-file quality gate.

Test semantics follow the public generic tests: ``not_null`` counts NULL
rows; ``unique`` counts non-null values occurring more than once;
``accepted_values`` counts distinct non-null values outside the list (NULL
passes).  ``cast_gate`` counts cells whose text does not cast to the declared
type (ANSI casts would fail the whole job on them).

Everything for one table is computed in at most two aggregations: one
``groupBy(by).agg(...)`` for null / accepted / cast counts, and one
``groupBy(by, col)`` per unique column.  Both partially aggregate map-side.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlake.model import Entity, entity
from vendorlake.operators.staging import staging_exprs

RESULT_COLUMNS = ("model", "column_name", "test_name", "failures")


def _ent(model) -> Entity:
    return model if isinstance(model, Entity) else entity(model)


def _long(wide: DataFrame, by: list[str], specs: list[tuple[str, str, str]], model: str) -> DataFrame:
    """Unpivot the one-row-per-group aggregate into (column, test, failures)."""
    if not specs:
        return None
    stack = F.explode(F.array(*[
        F.struct(F.lit(col).alias("column_name"), F.lit(test).alias("test_name"),
                 F.col(alias).cast("bigint").alias("failures"))
        for alias, col, test in specs]))
    return wide.select(*by, stack.alias("_t")).select(
        *by, F.lit(model).alias("model"), "_t.column_name", "_t.test_name", "_t.failures")


def run_tests(staged: DataFrame, model, by: list[str] | None = None) -> DataFrame:
    """All declared tests of ``model`` over ``staged`` -> long result rows.

    ``by`` (e.g. ``["_source_file"]``) evaluates every test per group, so one
    bad file can be rejected alone.
    """
    ent, by = _ent(model), list(by or [])
    aggs, specs = [], []
    for col in ent.columns:
        for t in col.tests:
            alias = f"_{t.kind}_{col.name}"
            c = F.col(col.name)
            if t.kind == "not_null":
                aggs.append(F.count_if(c.isNull()).alias(alias))
            elif t.kind == "accepted_values":
                bad = c.isNotNull() & ~c.isin(*t.values)
                aggs.append(F.count_distinct(F.when(bad, c)).alias(alias))
            else:
                continue
            specs.append((alias, col.name, t.kind))
    parts = []
    if aggs:
        grouped = staged.groupBy(*by) if by else staged
        parts.append(_long(grouped.agg(*aggs), by, specs, ent.name))
    for col in ent.columns:
        if any(t.kind == "unique" for t in col.tests):
            dup = (staged.filter(F.col(col.name).isNotNull())
                   .groupBy(*by, col.name).count().filter(F.col("count") > 1))
            u = dup.groupBy(*by).agg(F.count(F.lit(1)).alias("failures")) if by else \
                dup.agg(F.count(F.lit(1)).alias("failures"))
            parts.append(u.select(*by, F.lit(ent.name).alias("model"),
                                  F.lit(col.name).alias("column_name"),
                                  F.lit("unique").alias("test_name"),
                                  F.col("failures").cast("bigint")))
    return reduce(DataFrame.unionByName, parts)


def test_not_null(staged: DataFrame, columns: list[str]) -> DataFrame:
    return staged.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def test_unique(staged: DataFrame, column: str) -> DataFrame:
    """The offending values and how often each occurs."""
    return (staged.filter(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count(F.lit(1)).alias("n_records")).filter(F.col("n_records") > 1))


def test_accepted_values(staged: DataFrame, column: str, values) -> DataFrame:
    """The offending values and their row counts (NULL is accepted)."""
    c = F.col(column)
    return (staged.filter(c.isNotNull() & ~c.isin(*values)).groupBy(column)
            .agg(F.count(F.lit(1)).alias("n_records")))


def cast_gate(raw: DataFrame, model, by: list[str] | None = None) -> DataFrame:
    """Per group and typed column: cells with text that does not cast.

    Returns only offending (group, column) rows with ``bad_cells`` > 0.
    """
    ent, by = _ent(model), list(by or [])
    typed = [c for c in ent.columns if not c.expr and c.data_type not in ("string", None)
             and c.name in raw.columns]
    if not typed:
        return raw.sparkSession.createDataFrame(
            [], ", ".join([f"{b} string" for b in by] + ["column_name string", "bad_cells bigint"]))
    aggs = [F.count_if(F.col(c.name).isNotNull()
                       & F.expr(f"try_cast(`{c.name}` as {c.data_type})").isNull())
            .alias(c.name) for c in typed]
    wide = (raw.groupBy(*by) if by else raw).agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(c.name).alias("column_name"),
                                         F.col(c.name).cast("bigint").alias("bad_cells"))
                                for c in typed]))
    return (wide.select(*by, stack.alias("_t"))
            .select(*by, "_t.column_name", "_t.bad_cells")
            .filter(F.col("bad_cells") > 0))


def failing_groups(results: DataFrame, by: list[str]) -> DataFrame:
    """One row per failing group with a readable reason."""
    bad = results.filter(F.col("failures") > 0)
    item = F.concat(F.col("test_name"), F.lit("("), F.col("column_name"), F.lit(")="),
                    F.col("failures").cast("string"))
    return bad.groupBy(*by).agg(
        F.concat(F.lit("data tests failed: "),
                 F.array_join(F.array_sort(F.collect_list(item)), "; ")).alias("reason"))


def quality_gate(raw: DataFrame, model, by: str = "_source_file",
                 materialize: bool = False) -> tuple[DataFrame, DataFrame]:
    """Stage ``raw`` and split it into (good staged rows, rejected groups).

    A group (file) is rejected when any cell fails its cast or any data test
    fails within it; the rest of the batch goes on.  Good rows are the
    staged rows of groups not rejected (a left anti join on the group key).

    The cast flags are computed in the same projection as the staging, so
    the raw input is parsed once; with ``materialize`` that staged frame is
    written to the shared folder first and every check reads the columnar
    copy (worth it when the source is CSV).
    """
    ent = _ent(model)
    typed = [c for c in ent.columns if not c.expr and c.data_type not in ("string", None)
             and c.name in raw.columns]
    flags = [f"(`{c.name}` is not null and try_cast(`{c.name}` as {c.data_type}) is null) "
             f"as `_bad_{c.name}`" for c in typed]
    staged = raw.selectExpr(*staging_exprs(ent, safe=True, keep=(by,)), *flags)
    if materialize:
        from vendorlake.session import materialize as _write
        staged = _write(staged, "staged")
    flag_cols = [f"_bad_{c.name}" for c in typed]
    if typed:
        counts = staged.groupBy(by).agg(*[F.count_if(F.col(f)).alias(f) for f in flag_cols])
        item = F.explode(F.array(*[
            F.struct(F.lit(c.name).alias("column_name"), F.col(f"_bad_{c.name}").alias("bad"))
            for c in typed]))
        bad_cells = (counts.select(by, item.alias("_t"))
                     .select(by, "_t.column_name", "_t.bad").filter(F.col("bad") > 0))
        cast_rej = bad_cells.groupBy(by).agg(F.concat(
            F.lit("cast failed: "),
            F.array_join(F.array_sort(F.collect_list(F.concat(
                F.col("column_name"), F.lit("="), F.col("bad").cast("string")))), "; ")
        ).alias("reason"))
    else:
        cast_rej = None
    clean = staged.drop(*flag_cols)
    test_rej = failing_groups(run_tests(clean, ent, [by]), [by])
    parts = [test_rej] if cast_rej is None else [cast_rej, test_rej]
    rejected = (reduce(DataFrame.unionByName, parts).groupBy(by)
                .agg(F.array_join(F.array_sort(F.collect_list("reason")), " | ").alias("reason")))
    good = clean.join(rejected.select(by), by, "left_anti")
    return good, rejected

