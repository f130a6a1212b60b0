"""Marts: the reference's mart SQL as DataFrame plans.

Money is summed exactly in decimal (see ``functions.money``) and returned as
double.  Every aggregation is a plain ``groupBy().agg()``, so Spark does a
map-side partial aggregate before the shuffle - a hot key costs one row per
map task, not a skewed reducer.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlake.functions.money import exact_total, money_difference, money_sum


def daily_revenue(stg_orders: DataFrame) -> DataFrame:
    return (
        stg_orders.filter(F.col("status") == "completed")
        .groupBy("order_date")
        .agg(F.count(F.lit(1)).alias("order_count"),
             money_sum("amount").alias("total_revenue"))
        .orderBy("order_date")
    )


def dim_customers(stg_customers: DataFrame) -> DataFrame:
    return stg_customers.select("customer", "segment", "region")


def fct_payments(stg_payments: DataFrame) -> DataFrame:
    return stg_payments.select("payment_id", "order_id", "paid_amount", "paid_date")


def paid_per_order(fct: DataFrame) -> DataFrame:
    """Payments pre-aggregated to one row per order (no fan-out in joins)."""
    return fct.groupBy("order_id").agg(
        F.coalesce(exact_total("paid_amount").cast("double"), F.sum("paid_amount")).alias("paid_amount"))


def completed_with_segment(stg_orders: DataFrame, dim: DataFrame) -> DataFrame:
    """Inner equi-join ``using (customer)``: keys as delivered."""
    completed = stg_orders.filter(F.col("status") == "completed")
    return completed.join(dim, "customer", "inner")


def orders_with_payments(orders: DataFrame, fct: DataFrame) -> DataFrame:
    """Left outer join of orders to their pre-aggregated payments."""
    return orders.join(paid_per_order(fct), "order_id", "left")


def executive_summary(stg_orders: DataFrame, dim: DataFrame, fct: DataFrame) -> DataFrame:
    j = orders_with_payments(completed_with_segment(stg_orders, dim), fct)
    revenue, collected = money_sum("amount"), F.coalesce(money_sum("paid_amount"), F.lit(0.0))
    exact_rate = F.try_divide(F.coalesce(exact_total("paid_amount"), F.lit(0)).cast("decimal(28,10)"),
                              exact_total("amount").cast("decimal(28,10)")).cast("double")
    return (
        j.groupBy("segment")
        .agg(F.countDistinct("order_id").alias("orders_count"),
             money_sum("amount", 2).alias("revenue"),
             F.coalesce(money_sum("paid_amount", 2), F.lit(0.0)).alias("collected"),
             F.round(F.coalesce(exact_rate, F.try_divide(collected, revenue)), 3).alias("collection_rate"))
        .orderBy("segment")
    )


def pricing_summary(stg_settlements: DataFrame) -> DataFrame:
    def n(outcome):
        return F.sum(F.when(F.col("outcome") == outcome, 1).otherwise(0)).cast("bigint")
    return (
        stg_settlements.groupBy("vendor")
        .agg(F.count(F.lit(1)).alias("orders_count"),
             n("settled").alias("settled_count"),
             n("denied").alias("denied_count"),
             n("escalated").alias("escalated_count"),
             money_sum("submitted_amount", 2).alias("submitted_total"),
             money_sum("payable_amount", 2).alias("payable_total"),
             money_difference("submitted_amount", "payable_amount", 2).alias("savings"))
        .orderBy("vendor")
    )


def invoice_summary(stg_orders: DataFrame) -> DataFrame:
    """Per customer: order lines, total, and the rendered invoice line."""
    g = stg_orders.groupBy("customer").agg(
        F.count(F.lit(1)).alias("lines"), money_sum("amount").alias("_total"))
    return g.select(
        "customer", "lines", F.col("_total").alias("total"),
        F.format_string("invoice.pdf for %s: %d lines, $%.2f",
                        "customer", "lines", "_total").alias("invoice"))
