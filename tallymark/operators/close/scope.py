"""What a period's scope, its proofs and their search spaces say against closing it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import money


def measured_integrity(found: DataFrame, pool: DataFrame, members: DataFrame) -> DataFrame:
    """found with integrity COMPROMISED where the pool lost an order that the payout is made of."""
    return compromised(found, members.join(pool.select("settlement_id", "order_id"), ["settlement_id", "order_id"], "left_anti"))


def compromised(found: DataFrame, lost: DataFrame) -> DataFrame:
    """found with integrity COMPROMISED for the payouts that ``lost`` names, once or more."""
    lost = lost.select("settlement_id").distinct().withColumn("_lost", F.lit(True))
    return found.join(lost, "settlement_id", "left").withColumn("integrity", F.when(F.col("_lost"), "COMPROMISED").otherwise(F.col("integrity"))).drop("_lost")


def monthly(payouts: DataFrame, late_days: int = 0) -> DataFrame:
    """A closing calendar: each payout belongs to the month it stood in ``late_days`` before it settled.

    (period_id, settlement_id, settled_on, net_paise, starts_on, ends_on)."""
    day = F.date_sub("settled_on", late_days)
    return payouts.select(F.date_format(day, "yyyy-MM").alias("period_id"), "settlement_id", "settled_on", "net_paise", F.trunc(day, "month").alias("starts_on"), F.last_day(day).alias("ends_on"))


def blockers(scope: DataFrame, found: DataFrame, table: dict[str, int] | None = None) -> DataFrame:
    """(period_id, rule_no, kind, ref_id, exposure_paise): rules 2, 3, 5, 6 and 9 of the close.

    Several findings of a payout may come in; a payout of the scope without one is missing.
    ``table`` has the fee schedule that proofs are computed again with. Findings of payouts
    outside the scope don't count, and an empty table gives no blockers.
    """
    own = found.join(scope.select("settlement_id", "period_id"), "settlement_id")
    proven = own.where("verdict = 'PROVEN'")
    off = F.abs(money.net(F.col("fit_gross"), F.col("method"), table) - F.col("net_paise"))
    unpostable = F.col("order_id").isNull() | (F.col("candidates") <= 0) | (F.col("integrity") == "COMPROMISED")
    told = own.groupBy("period_id", "settlement_id").agg(F.count_distinct("verdict").alias("verdicts"), F.count_distinct("order_id").alias("proofs"))

    def rule(no: int, kind: str, rows: DataFrame, exposure: Column = F.lit(0)) -> DataFrame:
        return rows.select("period_id", F.lit(no).alias("rule_no"), F.lit(kind).alias("kind"), F.col("settlement_id").alias("ref_id"), exposure.cast("long").alias("exposure_paise"))

    rules = (
        rule(2, "IMPOSSIBLE_STATE_TRANSITION", scope.where("settled_on < starts_on or settled_on > ends_on"), F.abs("net_paise")),
        rule(3, "CONTRADICTORY_EVIDENCE", told.where("verdicts > 1 or proofs > 1")),
        rule(5, "FAILED_INVARIANT", proven.where(unpostable | (off > 1)), F.when(unpostable, 0).otherwise(off)),
        rule(6, "COMPROMISED_INTEGRITY", own.where("integrity = 'COMPROMISED'")),
        rule(9, "MISSING_SETTLEMENT", scope.join(found.select("settlement_id"), "settlement_id", "left_anti")),
    )
    every = rules[0]
    for more in rules[1:]:
        every = every.unionByName(more)
    return first_of(every)


def first_of(raised: DataFrame) -> DataFrame:
    """Each kind and reference of a period once, by the first rule that gives it."""
    return raised.groupBy("period_id", "kind", "ref_id").agg(F.min(F.struct("rule_no", "exposure_paise")).alias("first")).select("period_id", "kind", "ref_id", "first.rule_no", "first.exposure_paise")


def breakdown(stops: DataFrame) -> DataFrame:
    """(period_id, kind, instances, settlements): blockers by kind, and the payouts that they name."""
    named = F.when(F.col("ref_id").startswith("setl_"), F.substring_index("ref_id", ":", 1))
    return stops.groupBy("period_id", "kind").agg(F.count("*").alias("instances"), F.count_distinct(named).alias("settlements"))
