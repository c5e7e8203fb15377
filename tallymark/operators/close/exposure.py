"""What a period's payouts still put at risk, and whether that matters."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import money


@dataclass(frozen=True)
class Bound:
    """A share of the period's value, held between a floor and a ceiling."""

    #: A hundredth of the period's value, at least 100 and at most 100,000 rupees.
    bps: int = 100
    floor: int = 10_000
    ceiling: int = 10_000_000

    def allowed(self, total: Column) -> Column:
        share = money.floor_div(total * self.bps, 10_000)
        return F.when(total <= 0, F.lit(self.floor)).otherwise(F.greatest(F.lit(self.floor), F.least(share, F.lit(self.ceiling)))).cast("long")

    def version(self) -> str:
        """A fingerprint of the three numbers."""
        named = {"ceiling_paise": self.ceiling, "floor_paise": self.floor, "threshold_bps": self.bps}
        return "materiality_" + hashlib.sha256(json.dumps(named, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]

    def governing(self, total: Column) -> Column:
        share = money.floor_div(total * self.bps, 10_000)
        return F.when((total <= 0) | (share <= self.floor), "FLOOR").when(share >= self.ceiling, "CEILING").otherwise("PERCENTAGE")


def period(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def items(excepted: DataFrame, judged: DataFrame) -> DataFrame:
    """Per payout: value, verified part, kind and exposure (kind null where nothing is at risk)."""
    own = excepted.join(judged.select("settlement_id", "decision"), "settlement_id", "left")
    value, left, v = F.abs("amount_paise"), F.abs("unexplained_paise"), F.col("verdict")
    blocked = F.col("decision") == "BLOCK"
    kind = (
        F.when((v == "PROVEN") & blocked, "POLICY_BLOCKED").when((v == "PROVEN") & (left > 0), "PARTIAL").when(v == "PROVEN", F.lit(None).cast("string"))
        .when(v == "AMBIGUOUS", "AMBIGUOUS").when(v == "INSUFFICIENT", "INSUFFICIENT").when((left > 0) & (left < value), "PARTIAL").otherwise("UNVERIFIED")
    )
    exposure = (
        F.when((v == "PROVEN") & blocked, value).when(v == "PROVEN", F.least(value, left)).when(v == "AMBIGUOUS", F.when(left > 0, left).otherwise(value))
        .when(v == "INSUFFICIENT", value).otherwise(F.when(left > 0, left).otherwise(value))
    )
    verified = F.when((v == "PROVEN") & ~F.coalesce(blocked, F.lit(False)), value - F.least(value, left)).otherwise(0)
    return own.select(
        "settlement_id", period(F.col("settled_on")).alias("period_id"), "settled_on", "verdict", "reason", "severity", "decision", "unexplained_paise",
        value.alias("value_paise"), verified.cast("long").alias("verified_paise"), kind.alias("kind"), exposure.cast("long").alias("exposure_paise"),
    )


def totals(own: DataFrame, bound: Bound = Bound()) -> DataFrame:
    """Per period: values, exposures by kind, the bound and whether what is unresolved is material."""

    def part(*kinds: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("exposure_paise"))), F.lit(0))

    sums = own.groupBy("period_id").agg(
        F.count("*").alias("n_settlements"), F.count("reason").alias("n_exceptions"), F.sum("value_paise").alias("total_paise"), F.sum("verified_paise").alias("verified_paise"),
        F.sum(F.when(F.col("kind").isNotNull(), F.col("exposure_paise")).otherwise(0)).alias("contested_paise"),
        part("AMBIGUOUS").alias("ambiguous_paise"), part("PARTIAL", "UNVERIFIED").alias("contradicted_paise"), part("INSUFFICIENT").alias("insufficient_paise"),
    )
    total, net = F.col("total_paise"), F.col("total_paise") - F.col("verified_paise")
    return sums.select("*", net.alias("net_unresolved_paise"), bound.allowed(total).alias("allowed_paise"), bound.governing(total).alias("governing"), (net > bound.allowed(total)).alias("material"))


def merged(findings: DataFrame, exceptions: DataFrame, payouts: DataFrame | None, judged: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(settlement_id, rule, value_paise, verified_paise, kind, reason, severity, exposure_paise) of every payout that counts.

    Findings (settlement_id, seq, verdict, postable, n_proofs, proof_net, proofs_gross), exceptions (settlement_id,
    exception_id, seq, reason, severity, amount_paise, unexplained_paise, disputed_paise) and payouts (settlement_id,
    net_paise) meet in full: a payout may lack any of them. Of several findings the first counts, but one that isn't
    proven before any that is; of several exceptions the one that leaves most unexplained, the first of equal
    ones, and an exception id only once. ``targets`` says which payouts count; without it all payouts do, and
    without payouts all that have a finding or an exception. The first rule of A to G that holds decides.
    """
    order = F.struct((F.col("verdict") == "PROVEN").alias("proven"), "seq")
    one = findings.groupBy("settlement_id").agg(*[F.min_by(c, order).alias(c) for c in ("verdict", "postable", "n_proofs", "proof_net", "proofs_gross")])
    first = exceptions.groupBy("exception_id").agg(F.min_by(F.struct(*exceptions.columns), "seq").alias("e")).select("e.*")
    most = F.struct((-F.abs("unexplained_paise")).alias("minus"), "seq")
    left = first.groupBy("settlement_id").agg(*[F.min_by(c, most).alias(c) for c in ("reason", "severity", "amount_paise", "unexplained_paise", "disputed_paise")], F.lit(True).alias("excepted"))
    if targets is not None:
        ids = targets.select("settlement_id").distinct()
    elif payouts is not None and payouts.limit(1).count():
        ids = payouts.select("settlement_id").distinct()
    else:
        ids = findings.select("settlement_id").union(exceptions.select("settlement_id")).distinct()
    own = ids.join(one, "settlement_id", "left").join(left, "settlement_id", "left")
    if payouts is not None:
        own = own.join(payouts.groupBy("settlement_id").agg(F.max("net_paise").alias("net_paise")), "settlement_id", "left")
    else:
        own = own.withColumn("net_paise", F.lit(None).cast("long"))
    stopped = F.lit(False)
    if judged is not None:
        own = own.join(judged.select("settlement_id", "decision"), "settlement_id", "left")
        stopped = F.coalesce(F.col("decision") == "BLOCK", F.lit(False))
    excepted = F.coalesce("excepted", F.lit(False))
    value = F.coalesce(F.abs("net_paise"), F.when(F.col("n_proofs") > 0, F.abs("proof_net")), F.abs("amount_paise"), F.lit(0))
    open_part = F.coalesce(F.abs("unexplained_paise"), F.lit(0))
    proven, postable = F.col("verdict") == "PROVEN", F.coalesce("postable", F.lit(False))
    rule = (
        F.when(proven & postable & ~stopped & (~excepted | (open_part == 0)), "A").when(proven & postable & stopped, "A1").when(proven & postable, "A2")
        .when(F.col("verdict") == "AMBIGUOUS", "B").when(F.col("verdict") == "INSUFFICIENT", "C").when(F.col("verdict") == "CONTRADICTED", "D").when(proven, "E").when(excepted, "F").otherwise("G")
    )
    own = own.select("settlement_id", rule.alias("rule"), value.cast("long").alias("value_paise"), open_part.alias("u"), excepted.alias("excepted"), "reason", "severity", "n_proofs", "proofs_gross", F.coalesce("disputed_paise", F.lit(0)).alias("disputed"))
    r, v, u = F.col("rule"), F.col("value_paise"), F.col("u")
    claimed = F.when(F.col("disputed") > 0, F.col("disputed")).when(F.coalesce("n_proofs", F.lit(0)) > 1, F.col("proofs_gross")).when(u != 0, u).otherwise(v)
    contradicted = F.when(F.col("excepted"), u).otherwise(v)
    exposure = F.when(r.isin("A", "E"), 0).when(r.isin("A1", "C", "G"), v).when(r == "A2", F.least(v, u)).when(r == "B", claimed).when(r == "D", contradicted).otherwise(u)
    own = own.withColumn("exposure_paise", exposure.cast("long"))
    e = F.col("exposure_paise")
    kind = (
        F.when(r == "A1", "POLICY_BLOCKED").when(r == "A2", "PARTIAL").when(r.isin("B", "E"), "AMBIGUOUS").when(r == "C", "INSUFFICIENT").when(r == "D", F.when(e < v, "PARTIAL").otherwise("UNVERIFIED"))
        .when(r == "F", F.when(e == v, "UNVERIFIED").otherwise("PARTIAL")).when(r == "G", "UNVERIFIED")
    )
    why = F.when(r == "A", F.lit(None).cast("string")).otherwise(F.coalesce("reason", F.when(r == "B", "MULTIPLE_VALID_ASSIGNMENTS").when(r == "D", "NO_VALID_ASSIGNMENT").when(r == "E", "SEARCH_SPACE_UNCERTAIN").otherwise("INSUFFICIENT_EVIDENCE")))
    grade = F.when(r == "A", F.lit(None).cast("string")).when(r.isin("A1", "C", "G"), "HIGH").otherwise(F.coalesce("severity", F.when(r == "B", "MEDIUM").when(r == "E", "LOW").otherwise("HIGH")))
    verified = F.when(r == "A", v).when(r == "A2", v - e).otherwise(0)
    return own.select("settlement_id", "rule", "value_paise", verified.cast("long").alias("verified_paise"), kind.alias("kind"), why.alias("reason"), grade.alias("severity"), "exposure_paise")


def merged_totals(own: DataFrame) -> DataFrame:
    """One row: what ``merged`` adds up to; verified and unresolved value are the whole."""

    def part(*kinds: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("exposure_paise"))), F.lit(0))

    total, verified = F.coalesce(F.sum("value_paise"), F.lit(0)), F.coalesce(F.sum("verified_paise"), F.lit(0))
    return own.agg(
        F.count("*").alias("n_settlements"), F.count("kind").alias("n_items"), F.count_if(F.col("rule") == "A").alias("n_verified"), total.alias("total_paise"), verified.alias("verified_paise"), (total - verified).alias("net_unresolved_paise"),
        F.coalesce(F.sum("exposure_paise"), F.lit(0)).alias("contested_paise"), part("AMBIGUOUS").alias("ambiguous_paise"), part("PARTIAL", "UNVERIFIED").alias("contradicted_paise"), part("INSUFFICIENT").alias("insufficient_paise"),
    )
