"""What people decide on open items, and what agents may ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of reviewers' actions (fixed values).
ACTIONS = (
    "APPROVE_MANUAL_ADJUSTMENT", "SUBMIT_GATEWAY_DISPUTE", "APPROVE_CARRY_FORWARD", "REQUEST_DATA_OPS_CORRECTION",
    "DEFER_REVIEW", "REJECT_AND_ESCALATE", "ASSIGN_REVIEWER",
)
#: Capabilities that no agent holds (fixed values).
NEVER_GRANTED = ("post_accounting_entry", "mark_reconciled", "trigger_refund", "modify_record")


def recorded(actions: DataFrame) -> DataFrame:
    """Actions (item_id, seq, action, reviewer, justification) with status, error and a hash of the record.

    Blank reviewers or justifications and unknown actions are refused; what is refused changes nothing.
    """
    error = (
        F.when(F.trim(F.coalesce("reviewer", F.lit(""))) == "", "BLANK_REVIEWER").when(F.trim(F.coalesce("justification", F.lit(""))) == "", "BLANK_JUSTIFICATION")
        .when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "UNKNOWN_ACTION")
    )
    status = F.when(F.col("action") == "DEFER_REVIEW", "DEFERRED").when(F.col("action") == "ASSIGN_REVIEWER", "IN_REVIEW").otherwise("ACTIONED")
    digest = F.sha2(F.concat_ws("|", "item_id", F.col("seq").cast("string"), "action", "reviewer", "justification"), 256)
    return actions.select("item_id", "seq", "action", error.alias("error"), F.when(error.isNull(), status).alias("status"), F.when(error.isNull(), digest).alias("record_hash"))


def latest(items: DataFrame, log: DataFrame) -> DataFrame:
    """(item_id, status, n_actions): each item's status after its last recorded action; PENDING without one."""
    last = log.where("error is null").groupBy("item_id").agg(F.max_by("status", "seq").alias("status"), F.count("*").alias("n_actions"))
    return items.select("item_id").join(last, "item_id", "left").select("item_id", F.coalesce("status", F.lit("PENDING")).alias("status"), F.coalesce("n_actions", F.lit(0)).alias("n_actions"))


def requested(requests: DataFrame, roster: DataFrame) -> DataFrame:
    """Requests (request_id, agent, capability, evidence, verdict, postable, decision) with the stage that
    refuses each, or ACTION: capability, evidence, verification and policy are asked in this order.

    ``roster`` has (agent, capabilities: array); it is a handful of rows."""
    own = requests.join(F.broadcast(roster.select("agent", "capabilities")), "agent", "left")  # a handful of agents
    holds = F.coalesce(F.array_contains("capabilities", F.col("capability")), F.lit(False)) & ~F.col("capability").isin(*NEVER_GRANTED)
    stage = (
        F.when(~holds, "CAPABILITY").when(F.col("evidence").isNull(), "EVIDENCE")
        .when(F.col("verdict").isNull() | (F.col("verdict") != "PROVEN") | ~F.coalesce("postable", F.lit(False)), "VERIFICATION")
        .when(F.col("decision").isNull() | (F.col("decision") != "AUTO_POST"), "POLICY").otherwise("ACTION")
    )
    return own.select("request_id", "agent", "capability", stage.alias("stage"), (stage == "ACTION").alias("eligible"))
