"""Blockers, period verdicts and what is carried forward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators.close.exposure import Bound, totals

_COLUMNS = ("period_id", "rule_no", "kind", "ref_id", "exposure_paise")


def blockers(own: DataFrame, found: DataFrame, bound: Bound = Bound()) -> DataFrame:
    """(period_id, kind, ref_id, rule_no, exposure_paise): each kind and reference once, the
    first rule that gives it."""
    sums = totals(own, bound).select("period_id", "allowed_paise", "net_unresolved_paise", "material")

    def rule(no: int, kind: str, rows: DataFrame, ref: str = "settlement_id", exposure: str = "exposure_paise") -> DataFrame:
        return rows.select("period_id", F.lit(no).alias("rule_no"), F.lit(kind).alias("kind"), F.col(ref).alias("ref_id"), F.col(exposure).alias("exposure_paise"))

    at = own.join(sums, "period_id")
    claims = found.where("verdict = 'PROVEN'").select("settlement_id", "order_id")
    twice = claims.groupBy("order_id").agg(F.count_distinct("settlement_id").alias("n")).where("n > 1")
    doubled = own.join(claims.join(twice, "order_id").select("settlement_id", F.concat_ws(":", "settlement_id", "order_id").alias("claim")), "settlement_id")
    unresolved = sums.where("material").select("period_id", F.concat(F.lit("material_exposure:"), "period_id").alias("ref"), "net_unresolved_paise")
    rules = [
        rule(3, "CONTRADICTORY_EVIDENCE", own.where("verdict = 'CONTRADICTED' and unexplained_paise = value_paise and value_paise > 0")),
        rule(4, "DUPLICATE_LEDGER_IMPACT", doubled, "claim", "value_paise"),
        rule(7, "POLICY_BLOCKED", own.where("decision = 'BLOCK'")),
        rule(8, "HIGH_SEVERITY_EXCEPTION", own.where("severity = 'HIGH'")),
        rule(10, "AMBIGUOUS_MATERIAL_SETTLEMENT", at.where("kind = 'AMBIGUOUS' and value_paise > allowed_paise")),
        rule(10, "UNRESOLVED_MATERIAL_AMOUNT", unresolved, "ref", "net_unresolved_paise"),
        rule(10, "UNRESOLVED_MATERIAL_AMOUNT", at.where("material and kind is not null")),
    ]
    every = rules[0]
    for more in rules[1:]:
        every = every.unionByName(more)
    return every.groupBy("period_id", "kind", "ref_id").agg(F.min(F.struct("rule_no", "exposure_paise")).alias("first")).select("period_id", "kind", "ref_id", "first.rule_no", "first.exposure_paise")


def verdicts(own: DataFrame, found: DataFrame, bound: Bound = Bound(), raised: DataFrame | None = None) -> DataFrame:
    """Per period: BLOCKED, READY_WITH_CARRY_FORWARD or READY_TO_CLOSE, with counts.

    ``raised`` has all blockers that count, where more are known than ``blockers`` gives.
    """
    stops = (blockers(own, found, bound) if raised is None else raised).groupBy("period_id").agg(F.count("*").alias("n_blockers"), F.count_distinct("kind").alias("n_kinds"), F.sum(F.when(F.col("exposure_paise") > 0, F.col("exposure_paise")).otherwise(0)).alias("blocked_paise"))
    sums = totals(own, bound).join(stops, "period_id", "left")
    n = F.coalesce("n_blockers", F.lit(0))
    verdict = F.when(n > 0, "BLOCKED").when((F.col("net_unresolved_paise") > 0) | (F.col("n_exceptions") > 0), "READY_WITH_CARRY_FORWARD").otherwise("READY_TO_CLOSE")
    stake = F.when(F.col("material"), F.col("net_unresolved_paise")).otherwise(F.coalesce("blocked_paise", F.lit(0)))
    return sums.select("period_id", verdict.alias("verdict"), n.alias("n_blockers"), F.coalesce("n_kinds", F.lit(0)).alias("n_kinds"), "total_paise", "net_unresolved_paise", stake.alias("material_exposure_paise"))


def carry_forward(own: DataFrame) -> DataFrame:
    """Open items of each period with their age at its end."""
    age = F.datediff(F.last_day("settled_on"), F.col("settled_on"))
    return own.where("kind is not null or reason is not null").select("period_id", "settlement_id", "reason", "severity", "exposure_paise", age.cast("long").alias("age_days"))
