"""Routes, specs, entities and models from one JSON document.

    {"entities": [{"name": "stg_refunds", "source_table": "raw.refunds", "tags": ["refunds"],
                   "columns": [{"name": "refund_id", "type": "int", "tests": ["not_null", "unique"]},
                               {"name": "reason", "expr": "lower(trim(reason))",
                                "tests": [{"accepted_values": ["damaged", "late"]}]}]}],
     "routes":   [{"pattern": "refunds_*.csv", "route": "refunds", "spec": "refunds"}],
     "specs":    {"refunds": {"tags": ["refunds"], "source_table": "raw.refunds",
                              "column_aliases": {"refund_id": ["Refund No"]},
                              "outputs": ["analytics.refunds_by_reason"]}},
     "models":   [{"name": "refunds_by_reason", "deps": ["stg_refunds"], "tags": ["refunds"],
                   "sql": "SELECT reason, count(*) AS n FROM stg_refunds GROUP BY reason"}]}

The document extends what the library declares (its routes come first in the
match); an entry of a known name replaces it.  Nothing is run to check it: every
expression and statement is analysed by Spark against the declared columns, and
what is named must exist.  All faults are reported together.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from vendorlake.model import NOT_NULL, UNIQUE, Column, Entity, Route, Spec, Test, accepted
from vendorlake.operators.staging import build_staging
from vendorlake.plans.jobs import Config, DEFAULT, Model, run_sql

_KEYS = {"document": {"entities", "routes", "specs", "models"},
         "entity": {"name", "source_table", "tags", "columns"}, "column": {"name", "type", "expr", "tests"},
         "route": {"pattern", "route", "spec"}, "spec": {"tags", "source_table", "column_aliases", "outputs", "model"},
         "model": {"name", "deps", "tags", "sql"}}


class ConfigError(ValueError):
    """Everything that is wrong with a document, one fault a line."""

    def __init__(self, faults: list[str]):
        super().__init__("\n".join(faults))
        self.faults = faults


def load_config(spark: SparkSession, document: Mapping, base: Config = DEFAULT) -> Config:
    """The configuration a document makes of ``base``; ConfigError if it is faulty."""
    faults: list[str] = []
    _known(document, "document", "the document", faults)
    entities, specs, models = dict(base.entities), dict(base.specs), dict(base.models)
    own = [e for e in (_entity(d, faults) for d in document.get("entities", [])) if e]
    entities |= {e.name: e for e in own}
    for e in own:
        models[e.name] = Model(e.name, (e.source_table,), e.tags, lambda raw, e=e: build_staging(raw, e), e.name)
    routes = []
    for d in document.get("routes", []):
        if _known(d, "route", f"route {d.get('route')}", faults, {"pattern", "route"}):
            routes.append(Route(d["pattern"], d["route"], d.get("spec")))
    for name, d in (document.get("specs") or {}).items():
        if _known(d, "spec", f"spec {name}", faults):
            specs[name] = Spec(name, tuple(d.get("tags", ())), d.get("source_table"),
                               {k: tuple(v) for k, v in (d.get("column_aliases") or {}).items()}, tuple(d.get("outputs", ())), d.get("model"))
    written = []
    for d in document.get("models", []):
        if _known(d, "model", f"model {d.get('name')}", faults, {"name", "deps", "sql"}):
            written.append(d["name"])
            models[d["name"]] = Model(d["name"], tuple(d["deps"]), tuple(d.get("tags", ())),
                                      lambda *tables, d=d: run_sql(tables[0].sparkSession, d["sql"], dict(zip(d["deps"], tables)), {}))
    replaced = {(r.pattern, r.route) for r in routes}
    registry = (*routes, *(r for r in base.registry if (r.pattern, r.route) not in replaced))
    config = Config(registry, specs, entities, models)
    _check(spark, config, [e.name for e in own], written, faults)
    if faults:
        raise ConfigError(faults)
    return config


def _known(d, kind: str, what: str, faults: list[str], needed: set[str] = frozenset()) -> bool:
    """Whether the entry can be read at all."""
    if not isinstance(d, Mapping):
        faults.append(f"{what} is no object")
        return False
    for key in sorted(set(d) - _KEYS[kind]):
        faults.append(f"{what}: unknown key {key!r} (known: {sorted(_KEYS[kind])})")
    missing = sorted(needed - set(d))
    if missing:
        faults.append(f"{what} lacks {missing}")
    return not missing


def _test(d, what: str, faults: list[str]) -> Test | None:
    if d == "not_null":
        return NOT_NULL
    if d == "unique":
        return UNIQUE
    if isinstance(d, Mapping) and set(d) == {"accepted_values"}:
        return accepted(*d["accepted_values"])
    faults.append(f"{what}: unknown test {d!r}")
    return None


def _entity(d, faults: list[str]) -> Entity | None:
    what = f"entity {d.get('name') if isinstance(d, Mapping) else d}"
    if not _known(d, "entity", what, faults, {"name", "source_table", "columns"}):
        return None
    if not d["name"].startswith("stg_"):
        faults.append(f"{what}: a staging model is named stg_...")
    columns = []
    for c in d["columns"]:
        at = f"{what}, column {c.get('name') if isinstance(c, Mapping) else c}"
        if _known(c, "column", at, faults, {"name"}):
            tests = [_test(t, at, faults) for t in c.get("tests", [])]
            columns.append(Column(c["name"], c.get("type", "string"), c.get("expr"), tuple(t for t in tests if t)))
    names = [c.name.lower() for c in columns]
    for twice in sorted({n for n in names if names.count(n) > 1}):
        faults.append(f"{what}: column {twice!r} is declared twice")
    return Entity(d["name"], d["source_table"], tuple(columns), tuple(d.get("tags", ())))


def _reason(exc: Exception) -> str:
    return str(exc).split("\n")[0].split(" SQLSTATE")[0]


def _empty(spark: SparkSession, entity: Entity) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"`{c.name}` string" for c in entity.columns))


def _check(spark: SparkSession, config: Config, own: list[str], written: list[str], faults: list[str]) -> None:
    """Analyse expressions and statements; look up what they and the specs name."""
    tables: dict[str, DataFrame] = {}
    for name, entity in config.entities.items():
        raw, fine = _empty(spark, entity), True
        for c in entity.columns if name in own else ():
            try:
                build_staging(raw, Entity(name, entity.source_table, (c,))).schema
            except PySparkException as exc:
                faults.append(f"entity {name}, column {c.name}: {_reason(exc)}")
                fine = False
        if fine:
            tables[name] = build_staging(raw, entity)
    pending = list(written)
    while pending:
        ready = [n for n in pending if not any(d in pending for d in config.models[n].deps)]
        if not ready:
            faults.append(f"models {sorted(pending)} need each other")
            break
        for n in ready:
            pending.remove(n)
            missing = [d for d in config.models[n].deps if d not in config.models]
            if missing:
                faults.append(f"model {n} needs unknown {missing}")
            elif all(d in tables or _built(config, d, tables) for d in config.models[n].deps):
                try:
                    tables[n] = config.models[n].build(*[tables[d] for d in config.models[n].deps])
                    tables[n].schema
                except PySparkException as exc:
                    faults.append(f"model {n}: {_reason(exc)}")
    for r in config.registry:
        if r.spec is not None and r.spec not in config.specs:
            faults.append(f"route {r.route} has no spec {r.spec!r}")
    for spec in config.specs.values():
        entity = config.entities.get(spec.staging_model) if spec.staging_model else None
        if spec.staging_model and entity is None:
            faults.append(f"spec {spec.name} has no entity {spec.staging_model!r}")
        for canon in spec.column_aliases if entity else ():
            if canon not in entity.column_names:
                faults.append(f"spec {spec.name}: alias for {canon!r}, which {entity.name} does not declare")
        for out in spec.outputs:
            if out.split(".")[-1] not in config.models:
                faults.append(f"spec {spec.name} has no model for its output {out!r}")


def _built(config: Config, name: str, tables: dict[str, DataFrame]) -> bool:
    """Build a declared model over empty tables, if what it needs is sound."""
    model = config.models[name]
    if all(d in tables or (d in config.models and _built(config, d, tables)) for d in model.deps):
        tables[name] = model.build(*[tables[d] for d in model.deps])
    return name in tables
