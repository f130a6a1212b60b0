"""Table catalogs: none (the session's own, per run) or Iceberg via REST or
Glue.  Returns the Spark configuration to build a session with; the
Iceberg runtime jar must be on the cluster's classpath (it is not bundled)."""
from __future__ import annotations

from collections.abc import Mapping

# Configuration keys and classes of the public Iceberg runtime.
EXTENSIONS = "org.apache.iceberg.spark.extensions.IcebergSparkSessionExtensions"
CATALOG_CLASS = "org.apache.iceberg.spark.SparkCatalog"
#: Per catalog type the settings below ``spark.sql.catalog.<name>.``; a value in
#: braces is taken from the catalog's own entry, which must then be there.
TYPE_SETTINGS: dict[str, dict[str, str]] = {
    "rest": {"type": "rest", "uri": "{uri}"},
    "glue": {"catalog-impl": "org.apache.iceberg.aws.glue.GlueCatalog"},
}


def catalog_conf(catalog: Mapping[str, str] | None) -> dict[str, str]:
    """Settings for a catalog entry (name, type, uri, warehouse); none without one."""
    if not catalog:
        return {}
    entry = {"name": "lake", "type": "rest", **catalog}
    settings = TYPE_SETTINGS.get(entry["type"])
    if settings is None:
        raise ValueError(f"catalog type {entry['type']!r} is not one of {sorted(TYPE_SETTINGS)}")
    own = {key: value.format(**entry) for key, value in settings.items()}
    if entry.get("warehouse"):
        own["warehouse"] = entry["warehouse"]
    prefix = f"spark.sql.catalog.{entry['name']}"
    return {"spark.sql.extensions": EXTENSIONS, "spark.sql.defaultCatalog": entry["name"], prefix: CATALOG_CLASS,
            **{f"{prefix}.{key}": value for key, value in own.items()}}


def table_format(catalog: Mapping[str, str] | None) -> str:
    """parquet tables without a catalog, iceberg with one."""
    return "iceberg" if catalog else "parquet"
