"""Certificates of a period's close that anyone can check again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.operators.close.exposure import Bound

#: What the certificate says it was made by.
POLICY, ENGINE = "policy_v1", "tallymark_v1"
BLOCKER = ("kind", "ref_id", "rule_no", "exposure_paise")
CARRIED = ("settlement_id", "reason", "severity", "exposure_paise", "age_days")


def list_digest(rows: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
    """(period_id, n_<name>, <name>_digest) of a list of any length, whatever its order.

    A period may have any number of items, so they aren't gathered: the digest is the sum of
    the items' SHA-256 in four lanes of 60 bits, which tasks add up in parts.
    """
    item = F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in columns])), 256)
    lanes = [F.conv(F.substring(item, 1 + 15 * k, 15), 16, 10).cast("decimal(19,0)") for k in range(4)]
    sums = rows.groupBy("period_id").agg(F.count("*").alias(f"n_{name}"), *[F.sum(lane).cast("string").alias(f"_{k}") for k, lane in enumerate(lanes)])
    return sums.select("period_id", f"n_{name}", F.concat_ws("-", *[f"_{k}" for k in range(4)]).alias(f"{name}_digest"))


def _evidence() -> Column:
    """All that decides, as JSON without spaces whose keys stand in order."""

    def listed(name: str) -> Column:
        return F.struct(F.col(f"n_{name}").alias("count"), F.col(f"{name}_digest").alias("digest")).alias(name)

    materiality = F.struct(F.col("ceiling_paise"), F.col("threshold_paise").alias("effective_threshold_paise"), "floor_paise", F.col("materiality_version").alias("policy_version"), "threshold_bps")
    period = F.struct(F.col("period_end").alias("end"), "period_id", F.col("period_start").alias("start"))
    values = F.struct("material_exposure_paise", "period_value_paise", "reconciled_value_paise", "unresolved_paise")
    return F.to_json(
        F.struct(listed("blockers"), listed("carry_forward"), "invariants", materiality.alias("materiality"), period.alias("period"), F.struct("engine_version", "policy_version").alias("provenance"), values.alias("values"), "verdict"),
        {"ignoreNullFields": "false"},
    )


def issue(verdicts: DataFrame, totals: DataFrame, stops: DataFrame, carried: DataFrame, issued_at: str, bound: Bound = Bound()) -> DataFrame:
    """One certificate for each period of ``totals`` with a verdict.

    Blockers and items carried forward stay in their own tables; the certificate has their number
    and digest. ``issued_at``, the explanation and the contested amount aren't part of the hash.
    """
    own = totals.join(verdicts.select("period_id", "verdict", "material_exposure_paise"), "period_id")
    for rows, columns, name in ((stops, BLOCKER, "blockers"), (carried, CARRIED, "carry_forward")):
        own = own.join(list_digest(rows, columns, name), "period_id", "left").withColumns({f"n_{name}": F.coalesce(f"n_{name}", F.lit(0)), f"{name}_digest": F.coalesce(f"{name}_digest", F.lit("0-0-0-0"))})
    start = F.to_date("period_id", "yyyy-MM")
    why = F.when(F.col("verdict") == "BLOCKED", F.concat(F.lit("blockers: "), "n_blockers")).when(F.col("verdict") == "READY_WITH_CARRY_FORWARD", F.concat(F.lit("carried forward: "), "n_carry_forward")).otherwise(F.lit("nothing open"))
    conserved = F.concat_ws(" ", F.lit("verified"), "verified_paise", F.lit("+ unresolved"), "net_unresolved_paise", F.lit("= total"), "total_paise")
    own = own.select(
        "period_id", start.cast("string").alias("period_start"), F.last_day(start).cast("string").alias("period_end"), "verdict", why.alias("explanation"),
        F.col("total_paise").alias("period_value_paise"), F.col("verified_paise").alias("reconciled_value_paise"), F.col("net_unresolved_paise").alias("unresolved_paise"), "material_exposure_paise",
        F.col("allowed_paise").alias("threshold_paise"), F.lit(bound.version()).alias("materiality_version"), F.lit(bound.bps).alias("threshold_bps"), F.lit(bound.floor).alias("floor_paise"), F.lit(bound.ceiling).alias("ceiling_paise"),
        "n_blockers", "blockers_digest", "n_carry_forward", "carry_forward_digest", F.array(conserved, F.concat_ws(" ", F.lit("decision"), "verdict")).alias("invariants"),
        F.lit(POLICY).alias("policy_version"), F.lit(ENGINE).alias("engine_version"), F.col("contested_paise").alias("gross_contested_paise"), F.lit(issued_at).alias("issued_at"),
    )
    sealed = own.withColumn("evidence_hash", F.sha2(_evidence(), 256))
    return sealed.withColumn("certificate_id", F.concat_ws("-", F.lit("CERT"), "period_id", F.substring("evidence_hash", 1, 8)))


def verified(certificates: DataFrame, stops: DataFrame, carried: DataFrame) -> DataFrame:
    """(period_id, seal_holds, blockers_hold, carry_forward_holds): certificates against the tables as they are now."""
    own = certificates.withColumn("seal_holds", F.col("evidence_hash") == F.sha2(_evidence(), 256))
    for rows, columns, name, said in ((stops, BLOCKER, "blockers", "blockers_hold"), (carried, CARRIED, "carry_forward", "carry_forward_holds")):
        now = list_digest(rows, columns, name).select("period_id", F.struct(f"n_{name}", f"{name}_digest").alias("_now"))
        was = F.struct(F.col(f"n_{name}"), F.col(f"{name}_digest"))
        none = F.struct(F.lit(0).cast("long").alias(f"n_{name}"), F.lit("0-0-0-0").alias(f"{name}_digest"))
        own = own.join(now, "period_id", "left").withColumn(said, F.coalesce("_now", none) == was).drop("_now")
    return own.select("period_id", "seal_holds", "blockers_hold", "carry_forward_holds")
