"""Alias proposals against a plain greedy assignment."""
import re

from vendorlake.model import ENTITIES
from vendorlake.operators.hygiene import Resolver
from vendorlake.operators.proposals import ABBREVIATION, LEAST, alias_table, propose

COLUMNS = {e.name: e.column_names for e in ENTITIES.values()}


def _grams(name):
    padded = f"  {name} "
    return {padded[i:i + 3] for i in range(len(padded) - 2)}


def _score(header, canonical):
    if header == canonical:
        return 1000
    a, b = _grams(header), _grams(canonical)
    shared = 1000 * len(a & b) // len(a | b)
    short = len(header) >= 2 and re.match("".join(f"{c}[0-9a-z_]*" if c != "_" else c for c in header), canonical)
    return max(shared, ABBREVIATION) if short else shared


def _greedy(headers, columns):
    out, headers, columns = {}, set(headers), set(columns)
    while True:
        pairs = [(-_score(h, c), c, h) for h in headers for c in columns if _score(h, c) >= LEAST]
        if not pairs:
            return out
        score, c, h = min(pairs)
        out[h] = (c, -score)
        headers.remove(h)
        columns.remove(c)


def test_proposals_equal_a_greedy_assignment(spark):
    groups = {"a": ["cust", "seg", "rgn"], "b": ["order_no", "customer_name", "date", "amt", "state", "order_date"], "c": ["x", "zzz", "1", "total_amount"],
              "d": ["payment", "paid_date", "paid", "order", "orderid"], "e": ["vendor_name", "order_ref_no", "items", "submitted", "priced", "variance", "note"],
              "f": ["status", "status_2", "amount", "amounts", "é_amount"]}
    rows = [(g, e, h) for g, hs in groups.items() for e in COLUMNS for h in [*hs, hs[0], None, ""]]
    headers = spark.createDataFrame(rows, "group string, entity string, header string")
    found = propose(headers, COLUMNS)
    got = {}
    for r in found.collect():
        assert got.setdefault((r.group, r.entity), {}).setdefault(r.header, (r.canonical, r.score)) == (r.canonical, r.score)
    want = {(g, e): _greedy(hs, cs) for g, hs in groups.items() for e, cs in COLUMNS.items()}
    assert got == {k: v for k, v in want.items() if v}
    customers = {h: c for h, (c, _) in got["a", "stg_customers"].items()}
    assert customers == {"cust": "customer", "seg": "segment", "rgn": "region"}
    table = {(r.entity, r.canonical, r.header) for r in alias_table(found).collect()}
    assert ("stg_customers", "region", "rgn") in table and not any(c == h for _, c, h in table)
    assert propose(headers.limit(0), COLUMNS).count() == 0


def test_resolver_reports_what_comes_to_one_name():
    resolver = Resolver(True, {"customer": ["Cust", "buyer"], "region": ["geo"], "area": ["Geo"]})
    header = resolver.header(["CUST", "Buyer", "geo", "_source_file", "Other Col"])
    assert header.columns == ("customer", "customer", "area", "_source_file", "other_col")
    assert header.shared == {"customer": ("CUST", "Buyer")} and header.lacks(["area", "x"]) == ["x"]
    assert Resolver(False).header(["A", "a"], fold_case=True).shared == {"a": ("A", "a")}
