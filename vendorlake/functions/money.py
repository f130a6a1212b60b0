"""Exact money arithmetic.

Sums are taken in decimal at the amounts' own scale and rounded, if at all,
only once, at the end: exact, and the same at every partitioning (double sums
depend on the order partial aggregates combine).  Amounts beyond the decimal's
range, and NaN, turn the sum into the plain double sum, so they show.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
WIDE = "decimal(38,12)"
RATE = "decimal(10,4)"
AMOUNT_IN = "decimal(38,10)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_total(c: Column | str) -> Column:
    """Aggregate: the sum in decimal; NULL where an amount does not fit it."""
    c = _col(c)
    wide = c.try_cast(WIDE)
    return F.when(F.count_if(c.isNotNull() & wide.isNull()) == 0, F.try_sum(wide))


def money_sum(c: Column | str, scale: int | None = None) -> Column:
    """Aggregate: the sum as double, rounded half up to ``scale`` if given."""
    total, plain = exact_total(c), F.sum(_col(c).cast("double"))
    if scale is not None:
        total, plain = F.round(total, scale), F.round(plain, scale)
    return F.coalesce(total.cast("double"), plain)


def money_difference(a: Column | str, b: Column | str, scale: int) -> Column:
    """Aggregate: sum(a) - sum(b) as double, rounded once."""
    exact = F.round(exact_total(a) - exact_total(b), scale).cast("double")
    return F.coalesce(exact, F.round(F.sum(_col(a).cast("double")) - F.sum(_col(b).cast("double")), scale))
