"""Schema-driven staging: the canonical model *is* the projection.

Per declared column: its ``expr`` verbatim, else ``cast(name as type)`` when a
non-string type is declared, else the bare column.  Undeclared columns are
dropped, which Catalyst turns into column pruning at the scan.
"""
from __future__ import annotations

from pyspark.sql import DataFrame

from vendorlake.model import Entity, entity


def staging_exprs(ent: Entity, safe: bool = False,
                  keep: tuple[str, ...] = ()) -> list[str]:
    cast = "try_cast" if safe else "cast"
    out = []
    for col in ent.columns:
        if col.expr:
            e = col.expr
        elif col.data_type and col.data_type != "string":
            e = f"{cast}(`{col.name}` as {col.data_type})"
        else:
            e = f"`{col.name}`"
        out.append(f"{e} as `{col.name}`")
    return out + [f"`{k}`" for k in keep]


def build_staging(df: DataFrame, model: str | Entity, safe: bool = False,
                  keep_lineage: bool = False) -> DataFrame:
    """``safe`` uses try_cast (bad cells become NULL for the tests to catch);
    the default is the model's plain cast, which fails on a bad cell."""
    ent = model if isinstance(model, Entity) else entity(model)
    keep = tuple(c for c in ("_source_file",) if keep_lineage and c in df.columns)
    return df.selectExpr(*staging_exprs(ent, safe, keep))


def stg_orders(raw: DataFrame, **kw) -> DataFrame:
    return build_staging(raw, "stg_orders", **kw)


def stg_customers(raw: DataFrame, **kw) -> DataFrame:
    return build_staging(raw, "stg_customers", **kw)


def stg_payments(raw: DataFrame, **kw) -> DataFrame:
    return build_staging(raw, "stg_payments", **kw)


def stg_settlements(raw: DataFrame, **kw) -> DataFrame:
    return build_staging(raw, "stg_settlements", **kw)
