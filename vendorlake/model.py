"""The canonical data model, route registry and policy constants.

One declaration drives the staging projection (``operators.staging``), the
landing contract (``operators.hygiene.column_contract``) and the data tests
(``operators.quality``).  Adding a field is one ``Column`` entry.
"""
from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Test:
    kind: str                      # not_null | unique | accepted_values
    values: tuple[str, ...] = ()


NOT_NULL = Test("not_null")
UNIQUE = Test("unique")


def accepted(*values: str) -> Test:
    return Test("accepted_values", tuple(values))


@dataclass(frozen=True)
class Column:
    name: str
    data_type: str = "string"
    expr: str | None = None        # SQL expression used verbatim (not cast again)
    tests: tuple[Test, ...] = ()


@dataclass(frozen=True)
class Entity:
    name: str                      # staging model name, e.g. stg_orders
    source_table: str              # landed raw table, e.g. raw.orders
    columns: tuple[Column, ...]
    tags: tuple[str, ...] = ()

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]


# ---------------------------------------------------------------------------
# These must equal the reference's canonical model exactly
# (column names, order, types, cleanup expressions, tests, accepted values).
# ---------------------------------------------------------------------------
STG_ORDERS = Entity(
    "stg_orders", "raw.orders",
    (
        Column("order_id", "int", tests=(NOT_NULL, UNIQUE)),
        Column("customer", "string", tests=(NOT_NULL,)),
        Column("order_date", "date", tests=(NOT_NULL,)),
        Column("amount", "double", tests=(NOT_NULL,)),
        Column("status", "string", expr="lower(trim(status))",
               tests=(NOT_NULL, accepted("completed", "cancelled", "pending"))),
    ),
    tags=("orders",),
)

STG_CUSTOMERS = Entity(
    "stg_customers", "raw.customers",
    (
        Column("customer", "string", tests=(NOT_NULL, UNIQUE)),
        Column("segment", "string", expr="lower(trim(segment))", tests=(NOT_NULL,)),
        Column("region", "string", expr="lower(trim(region))", tests=(NOT_NULL,)),
    ),
    tags=("customers",),
)

STG_PAYMENTS = Entity(
    "stg_payments", "raw.payments",
    (
        Column("payment_id", "int", tests=(NOT_NULL, UNIQUE)),
        Column("order_id", "int", tests=(NOT_NULL,)),
        Column("paid_amount", "double", tests=(NOT_NULL,)),
        Column("paid_date", "date", tests=(NOT_NULL,)),
    ),
    tags=("payments",),
)

STG_SETTLEMENTS = Entity(
    "stg_settlements", "raw.settlements",
    (
        Column("batch_id", "string", tests=(NOT_NULL,)),
        Column("order_ref", "string", tests=(NOT_NULL, UNIQUE)),
        Column("vendor", "string", tests=(NOT_NULL,)),
        Column("item_count", "int"),
        Column("submitted_amount", "double", tests=(NOT_NULL,)),
        Column("priced_amount", "double", tests=(NOT_NULL,)),
        Column("variance_pct", "double"),
        Column("outcome", "string", expr="lower(trim(outcome))",
               tests=(NOT_NULL, accepted("settled", "denied", "escalated"))),
        Column("decision_source", "string",
               tests=(accepted("auto", "reviewer", "validation", "sla_timeout"),)),
        Column("payable_amount", "double", tests=(NOT_NULL,)),
        Column("note", "string"),
    ),
    tags=("settlements",),
)

ENTITIES: dict[str, Entity] = {
    e.name: e for e in (STG_ORDERS, STG_CUSTOMERS, STG_PAYMENTS, STG_SETTLEMENTS)
}


def entity(name: str) -> Entity:
    return ENTITIES[name if name.startswith("stg_") else "stg_" + name]


def canonical_columns(model_name: str) -> list[str]:
    return entity(model_name).column_names


# ---------------------------------------------------------------------------
# Route registry (order matters: first match wins) and the
# per-route specs with their column aliases.
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Route:
    pattern: str
    route: str
    spec: str | None


REGISTRY: tuple[Route, ...] = (
    Route("orders_*.csv", "orders", "transform-spec-1"),
    Route("customers_*.csv", "customers", "transform-spec-2"),
    Route("payments_*.csv", "payments", "transform-spec-3"),
    Route("vendor_orders_*.csv", "vendor-orders", None),
)


@dataclass(frozen=True)
class Spec:
    name: str
    select_tags: tuple[str, ...]
    source_table: str | None = None
    column_aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    outputs: tuple[str, ...] = ()
    model: str | None = None

    @property
    def staging_model(self) -> str | None:
        if self.model:
            return self.model
        if self.source_table:
            return "stg_" + self.source_table.split(".")[-1]
        return None


SPECS: dict[str, Spec] = {
    "transform-spec-1": Spec("transform-spec-1", ("orders",), "raw.orders",
                             outputs=("analytics.daily_revenue",)),
    "transform-spec-2": Spec("transform-spec-2", ("customers",), "raw.customers",
                             column_aliases={"customer": ("cust", "customer_name"),
                                             "segment": ("seg", "tier"),
                                             "region": ("rgn", "geo")},
                             outputs=("analytics.dim_customers",)),
    "transform-spec-3": Spec("transform-spec-3", ("payments",), "raw.payments",
                             outputs=("analytics.fct_payments",)),
    "consolidation": Spec("consolidation", ("consolidated",),
                          outputs=("analytics.executive_summary",)),
    "settlements": Spec("settlements", ("settlements",), "raw.settlements",
                        outputs=("analytics.pricing_summary",)),
}

# ---------------------------------------------------------------------------
# Settlement policy, vocabulary and limits.
# ---------------------------------------------------------------------------
VARIANCE_THRESHOLD_PCT = 10.0
REVIEW_SLA_SECONDS = 300
SLA_ACTION = "escalate"            # or "deny"
VALID_DECISIONS = ("approve", "deny")

REMIT_COLUMNS = (
    "batch_id", "order_ref", "vendor", "item_count", "submitted_amount",
    "priced_amount", "variance_pct", "outcome", "decision_source",
    "payable_amount", "note",
)

MAX_INLINE_ROWS = 100_000          # rows of a json document, which is opt-in
DEFAULT_PATTERN = "*.csv*"
