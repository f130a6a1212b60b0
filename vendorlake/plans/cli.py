"""Run a JSON job spec:  python -m vendorlake.plans.cli --spec job.json

The spec shape is the one vendors' jobs already use::

    {"name": "daily-revenue",
     "inputs":  [{"source": "<path>", "table": "raw.orders", "format": "csv",
                  "hygiene": {"sanitize_headers": true,
                              "column_aliases": {"customer": ["cust"]},
                              "require_columns": ["order_id", ...]}}],
     "dbt_args": ["build", "--select", "tag:orders"],
     "dbt_vars": {"since": "2026-08-01"},
     "sql_models": {"recent": "SELECT * FROM daily_revenue WHERE order_date >= CAST(:since AS DATE)"},
     "outputs": [{"table": "analytics.daily_revenue",
                  "destination": "<path>", "format": "parquet"}],
     "catalog": {"type": "rest", "name": "lake", "uri": "...", "warehouse": "..."}}

A spec with ``"landing": "<prefix>"`` runs the file batch on that prefix instead
(``publish``: where its tables, outputs and quarantine go).  Either kind takes a
``"config"``: routes, specs, entities and models as ``plans.config`` reads them.
Outputs are parquet unless they ask for ``json`` (one document of at most
``max_rows`` rows).  With a catalog, tables are kept in its format.
Prints one final line ``ETL_RESULT {json}`` (success, outputs or error) and
exits non-zero on a deterministic rejection or a failed data test.
"""
from __future__ import annotations

import argparse
import json
import sys

from vendorlake.model import MAX_INLINE_ROWS
from vendorlake.plans.jobs import DEFAULT, InputSpec, JobSpec, OutputSpec, run_batch, run_job


def selectors(dbt_args: list[str]) -> tuple[str, ...]:
    """The model selectors after ``--select`` / ``-s`` (all models if none)."""
    out, take = [], False
    for a in dbt_args:
        if a in ("--select", "-s"):
            take = True
        elif a.startswith("-"):
            take = False
        elif take:
            out.extend(a.split())
    return tuple(out) or ("tag:orders", "tag:customers", "tag:payments", "tag:settlements",
                          "tag:consolidated")


def job_from_dict(spec: dict) -> JobSpec:
    inputs = []
    for inp in spec.get("inputs", []):
        h = inp.get("hygiene") or {}
        inputs.append(InputSpec(
            source=inp.get("source") or inp["key"], table=inp["table"],
            format=inp.get("format", "csv"),
            sanitize_headers=bool(h.get("sanitize_headers", inp.get("format", "csv") == "csv")),
            column_aliases={k: tuple(v) for k, v in (h.get("column_aliases") or {}).items()},
            require_columns=tuple(h.get("require_columns") or ())))
    outputs = [OutputSpec(o["table"], o.get("destination") or o.get("key"), o.get("format", "parquet"),
                          o.get("max_rows", MAX_INLINE_ROWS)) for o in spec.get("outputs", [])]
    return JobSpec(spec.get("name", "job"), inputs, selectors(spec.get("dbt_args", ["build"])),
                   outputs, spec.get("dbt_vars") or {}, spec.get("sql_models") or {})


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="vendorlake-job")
    ap.add_argument("--spec", required=True, help="path of the job spec JSON")
    args = ap.parse_args(argv)
    with open(args.spec) as f:
        spec = json.load(f)

    from pyspark.sql import SparkSession

    from vendorlake.plans.catalog import catalog_conf, table_format
    from vendorlake.plans.config import ConfigError, load_config
    builder = SparkSession.builder.appName(spec.get("name", "vendorlake-job"))
    for k, v in catalog_conf(spec.get("catalog")).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    try:
        config = load_config(spark, spec["config"]) if spec.get("config") else DEFAULT
    except ConfigError as exc:
        print("ETL_RESULT " + json.dumps({"success": False, "error": str(exc), "tests": []}))
        return 1
    if spec.get("landing"):
        done = run_batch(spark, spec["landing"], publish=spec.get("publish"), config=config)
        print("ETL_RESULT " + json.dumps({"success": True, "report": done["report"].first().asDict(), "outputs": done["outputs"]}))
        return 0
    res = run_job(spark, job_from_dict(spec), table_format=table_format(spec.get("catalog")), config=config)
    if res["success"]:
        print("ETL_RESULT " + json.dumps({"success": True, "outputs": res["outputs"]}))
        return 0
    print("ETL_RESULT " + json.dumps({"success": False, "error": res["error"],
                                      "tests": res["tests"]}, default=str))
    return 1


if __name__ == "__main__":
    sys.exit(main())
