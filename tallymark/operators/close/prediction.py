"""How likely open items resolve themselves, and in which order people should look at them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import money

#: Share of items of each reason that resolve, and days that takes (fixed values).
PRIORS = {
    "TIMING_MISMATCH": (0.88, 3),
    "REFUND_MISMATCH": (0.72, 5),
    "UNKNOWN_ADJUSTMENT": (0.45, 7),
    "MULTIPLE_VALID_ASSIGNMENTS": (0.25, 14),
    "DUPLICATE_AMOUNT": (0.30, 10),
    "PARTIAL_SETTLEMENT": (0.65, 5),
    "MISSING_TRANSACTION": (0.40, 7),
    "SEARCH_SPACE_UNCERTAIN": (0.55, 3),
    "CHARGEBACK": (0.18, 30),
    "DATA_QUALITY": (0.05, 14),
    "NO_VALID_ASSIGNMENT": (0.20, 14),
    "INSUFFICIENT_EVIDENCE": (0.35, 7),
}
DEFAULT_PRIOR = (0.30, 7)


def _pick(column: Column, cases: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for name, value in cases.items():
        out = F.when(column == name, F.lit(value)).otherwise(out)
    return out


def _steps(column: Column, steps: list[tuple[int, float]], other: float, strict: bool = False) -> Column:
    out = F.lit(other)
    for limit, value in reversed(steps):
        out = F.when(column < limit if strict else column <= limit, F.lit(value)).otherwise(out)
    return out


def features(carried: DataFrame, own: DataFrame, found: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """carried with what the prediction rests on: the payout's value and the open share of it, whether orders are established
    or explain a part, whether it is known what is missing, how many explanations compete, and earlier attempts
    (settlement_id, prior_attempts) to resolve it.

    A reason that isn't known names nothing that is missing; a payout without a finding has nothing established.
    """
    facts = found.select("settlement_id", F.col("verdict").alias("_verdict"), F.col("candidates").alias("_candidates"), F.col("n_fits").alias("_fits"))
    rows = carried.join(own.select("settlement_id", "value_paise"), "settlement_id", "left").join(facts, "settlement_id", "left")
    tried = F.lit(0)
    if attempts is not None:
        rows = rows.join(attempts.select("settlement_id", "prior_attempts"), "settlement_id", "left")
        tried = F.greatest(F.coalesce("prior_attempts", F.lit(0)), F.lit(0))
    value = F.when(F.coalesce("value_paise", F.lit(0)) > 0, F.col("value_paise")).otherwise(F.greatest("exposure_paise", F.lit(1)))
    return rows.select(
        *carried.columns, value.cast("long").alias("settlement_value_paise"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("exposure_paise") / value)).alias("exposure_ratio"),
        F.coalesce((F.col("_verdict") == "CONTRADICTED") & (F.col("_candidates") > 0), F.lit(False)).alias("has_partial_match"), F.coalesce(F.col("_verdict").isin("PROVEN", "AMBIGUOUS"), F.lit(False)).alias("has_established_orders"),
        F.coalesce(F.col("reason").isin(*PRIORS), F.lit(False)).alias("has_missing_evidence_ref"), F.coalesce(F.when(F.col("_verdict") == "AMBIGUOUS", F.col("_fits")), F.lit(0)).cast("long").alias("ambiguity_count"), tried.cast("long").alias("prior_attempts"),
    )


def predict(carried: DataFrame) -> DataFrame:
    """(settlement_id, probability, horizon_days, confidence, routing) of carried items, by what ``features`` says of them.

    Features that a table lacks count as absent.
    """

    def has(name: str) -> Column:
        return F.col(name) if name in carried.columns else F.lit(False)

    named, partly, sure_orders = has("has_missing_evidence_ref"), has("has_partial_match"), has("has_established_orders")
    attempts = F.least(F.col("prior_attempts"), F.lit(4)) if "prior_attempts" in carried.columns else F.lit(0)
    p0, days = _pick(F.col("reason"), {k: v[0] for k, v in PRIORS.items()}, DEFAULT_PRIOR[0]), _pick(F.col("reason"), {k: v[1] for k, v in PRIORS.items()}, DEFAULT_PRIOR[1]).cast("long")
    age, exposure = F.col("age_days"), F.col("exposure_paise")
    logit = (
        F.ln(F.greatest(F.lit(1e-4), p0) / F.greatest(F.lit(1e-4), 1 - p0))
        + _steps(age, [(2, 0.35), (5, 0.05), (10, -0.40), (30, -1.10)], -2.20)
        + _steps(exposure, [(1, 1.0), (5_000, 0.40), (50_000, 0.10), (500_000, -0.30)], -0.80, strict=True)
        + F.when(named, 0.35).otherwise(0.0) + F.when(partly | sure_orders, 0.25).otherwise(0.0)
        + _pick(F.col("severity"), {"HIGH": -1.20, "MEDIUM": -0.30}, 0.0) - 0.40 * attempts
    )
    p = F.bround(F.greatest(F.lit(0.01), F.least(F.lit(0.99), 1 / (1 + F.exp(-logit)))), 4)
    own = carried.withColumn("probability", p).withColumn("base_days", days)
    p = F.col("probability")
    horizon = F.when(F.col("reason") == "TIMING_MISMATCH", F.greatest(F.lit(1), F.least(F.col("base_days"), 4 - age))).when(p >= 0.75, F.greatest(F.lit(1), F.col("base_days"))).when(p >= 0.40, F.col("base_days") + 3).otherwise(F.greatest(F.lit(14), F.col("base_days") + 10))
    sure = F.lit(50) + F.when(F.abs(p - 0.5) >= 0.30, 25).otherwise(0) + F.when(named | sure_orders, 15).otherwise(0) + F.when(age > 20, 10).otherwise(0)
    routing = F.when((F.col("severity") == "HIGH") | (exposure >= 1_000_000), "MANUAL_AUDIT").when(F.col("reason") == "CHARGEBACK", "ESCALATE_FINANCE_DISPUTE").when(F.col("reason") == "DATA_QUALITY", "DATA_OPS_CORRECTION").when((p >= 0.75) & (age <= 3), "AUTO_RESOLVE_NEXT_CYCLE").when(p >= 0.50, "HOLD_FOR_SETTLEMENT_WINDOW").otherwise("INVESTIGATE_OPERATIONAL")
    return own.select("settlement_id", "probability", horizon.cast("long").alias("horizon_days"), F.when(sure >= 75, "HIGH").when(sure >= 45, "MEDIUM").otherwise("LOW").alias("confidence"), routing.alias("routing"))


def review_queue(own: DataFrame, carried: DataFrame, stops: DataFrame, allowed: DataFrame) -> DataFrame:
    """Open items with their priority and what they do to the close; rank by the columns
    priority, exposure and id."""
    blocking = stops.select(F.col("ref_id").alias("settlement_id")).distinct().withColumn("is_blocker", F.lit(True))
    rows = carried.join(predict(carried), "settlement_id").join(own.select("settlement_id", "verdict"), "settlement_id").join(blocking, "settlement_id", "left").join(allowed.select("period_id", "allowed_paise"), "period_id")
    blocker, material, ambiguous = F.coalesce("is_blocker", F.lit(False)), F.col("exposure_paise") > F.col("allowed_paise"), F.col("verdict") == "AMBIGUOUS"

    def points(condition: Column, n: int) -> Column:
        return F.when(condition, F.lit(n)).otherwise(0)

    score = (
        points(blocker, 1_000_000) + points(material, 700_000) + points(F.col("severity") == "HIGH", 300_000) + points(F.col("severity") == "MEDIUM", 100_000) + points(ambiguous, 200_000)
        + F.least(money.floor_div(F.col("exposure_paise"), 1000), F.lit(10_000_000)) + F.least(F.col("age_days") * 1000, F.lit(50_000)) + F.floor((1 - F.col("probability")) * 100_000 + 1e-6)
    )
    impact = F.when(blocker, "BLOCKER").when(material, "MATERIAL").when(ambiguous, "AMBIGUOUS").otherwise("CARRY_FORWARD")
    return rows.select("period_id", "settlement_id", "reason", score.cast("long").alias("priority"), "exposure_paise", impact.alias("close_impact"))


def scenario_items(own: DataFrame) -> DataFrame:
    """Items once for each scenario, (scenario, item columns): those that a scenario resolves are proven, verified and open nothing."""
    scenarios = {
        "BASELINE": F.lit(False), "RESOLVE_AMBIGUOUS": F.col("verdict") == "AMBIGUOUS", "RESOLVE_HIGH": F.col("severity") == "HIGH",
        "CLEAR_POLICY_BLOCKS": F.coalesce(F.col("decision") == "BLOCK", F.lit(False)), "RESOLVE_ALL": F.lit(True),
    }
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")

    def under(name: str, done: Column) -> Column:
        resolved = {"verdict": F.lit("PROVEN"), "reason": none, "severity": F.lit("LOW"), "decision": F.lit("AUTO_POST"), "unexplained_paise": zero, "verified_paise": F.col("value_paise"), "kind": none, "exposure_paise": zero}
        return F.struct(F.lit(name).alias("scenario"), *[F.when(done, v).otherwise(F.col(c)).alias(c) for c, v in resolved.items()])

    return own.select("settlement_id", "period_id", "settled_on", "value_paise", F.inline(F.array(*[under(*x) for x in scenarios.items()])))


def simulate(own: DataFrame, found: DataFrame, verdicts) -> DataFrame:
    """Period verdicts under each scenario: what if the items of a kind were resolved?

    A scenario's periods are periods of their own, so all scenarios go through one plan.
    """
    own = scenario_items(own).withColumn("period_id", F.concat_ws("|", "scenario", "period_id")).drop("scenario")
    out = verdicts(own, found)
    return out.select(F.substring_index("period_id", "|", -1).alias("period_id"), *[c for c in out.columns if c != "period_id"], F.substring_index("period_id", "|", 1).alias("scenario"))
