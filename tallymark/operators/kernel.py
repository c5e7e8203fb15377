"""The trusted check: every explanation is derived again from source rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def proofs(members: DataFrame, orders: DataFrame, payouts: DataFrame, by: tuple[str, ...] = ("settlement_id",)) -> DataFrame:
    """Totals of explanations given as rows (settlement_id, order_id): gross, fee, net, residual, tolerance.

    ``by`` names the columns that tell explanations apart, the settlement among them.
    """
    joined = members.join(orders.select("order_id", "gross_paise", "net_paise"), "order_id", "left").groupBy(*by).agg(
        F.count("*").alias("k"), F.count_distinct("order_id").alias("distinct_orders"), F.count("gross_paise").alias("known_orders"),
        F.sum("gross_paise").alias("gross_paise"), F.sum("net_paise").alias("net_paise"),
    )
    credit = payouts.select("settlement_id", F.col("net_paise").alias("credit_paise"))
    return joined.join(credit, "settlement_id").select("*", (F.col("gross_paise") - F.col("net_paise")).alias("fee_paise"), (F.col("credit_paise") - F.col("net_paise")).alias("residual_paise"), F.col("k").alias("tolerance_paise"))


def check(totals: DataFrame) -> DataFrame:
    """Adds ok and the first reason against: repeated ids, unknown ids, residual over tolerance."""
    reason = (
        F.when(F.col("distinct_orders") < F.col("k"), "DUPLICATE_ORDER")
        .when(F.col("known_orders") < F.col("k"), "UNKNOWN_ORDER")
        .when(F.abs("residual_paise") > F.col("tolerance_paise"), "RESIDUAL_OVER_TOLERANCE")
    )
    return totals.withColumn("reason", F.coalesce(reason, F.lit("OK"))).withColumn("ok", F.col("reason") == "OK")
