"""Findings of the single-order layer, exceptions and the plan of action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import money
from tallymark.operators import blocking, cascade, evidence, matching

#: Reasons that are worked item by item; the others take one step for all (fixed values).
PER_ITEM = ("UNKNOWN_ADJUSTMENT", "REFUND_MISMATCH", "CHARGEBACK", "PARTIAL_SETTLEMENT", "NO_VALID_ASSIGNMENT")


def single_order_findings(payouts: DataFrame, orders: DataFrame) -> DataFrame:
    """One finding for each payout from its single-order fits and its pool.

    One fit is PROVEN, several are AMBIGUOUS; a pool that can't reach the credit is
    CONTRADICTED; what is left needs the subset solver and is INSUFFICIENT here.
    """
    fits = blocking.credit_fits(payouts, orders).groupBy("settlement_id").agg(
        F.count("*").alias("n_fits"), F.min("order_id").alias("order_id"), F.sum("net_paise").alias("fit_net"), F.sum("gross_paise").alias("fit_gross"), F.min("method").alias("method"),
    )
    sizes = blocking.pool_sizes(payouts, orders).select("settlement_id", "candidates", "pool_net")
    own = payouts.join(sizes, "settlement_id", "left").join(fits, "settlement_id", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0))).withColumn("pool_net", F.coalesce("pool_net", F.lit(0)).cast("long"))
    n = F.coalesce("n_fits", F.lit(0))
    verdict = F.when(n == 1, "PROVEN").when(n > 1, "AMBIGUOUS").when(F.col("pool_net") < F.col("net_paise") - 1, "CONTRADICTED").otherwise("INSUFFICIENT")
    return own.select(
        "settlement_id", "settled_on", "net_paise", verdict.alias("verdict"), n.alias("n_fits"), F.when(n == 1, F.col("order_id")).alias("order_id"),
        F.col("fit_net"), F.col("fit_gross"), F.when(n == 1, F.col("method")).alias("method"), "candidates", "pool_net", F.lit("HEURISTIC").alias("integrity"), F.lit(None).cast("double").alias("density"),
    )


def cascade_findings(decided: DataFrame, payouts: DataFrame, orders: DataFrame) -> DataFrame:
    """Findings of the cascade, with the columns of ``single_order_findings`` and more.

    A proof may hold several orders: ``order_ids`` has them, ``fit_gross``, ``fit_net`` and ``fit_tax`` their
    amounts, ``order_id`` and ``method`` those of a single one. Of an ambiguous payout ``fit_net`` is what its
    explanations differ over; of a contradicted one ``left_paise`` is what its closest partial leaves open.
    """
    space = cascade.spaces(decided, payouts, orders).select("settlement_id", "candidates", "pool_net", "integrity", "universe", (F.col("universe") - F.col("candidates")).alias("removed"))
    tax = money.tax(money.fee(F.col("gross_paise"), F.col("method")))
    priced = orders.select("order_id", "net_paise", "gross_paise", "method", tax.alias("tax_paise"))
    cited = decided.select("settlement_id", F.posexplode("explanations").alias("explanation", "own")).select("settlement_id", "explanation", F.explode("own").alias("order_id"))
    cited = cited.join(cascade.cited_of(priced, cited), "order_id")
    sums = [F.sum(c).alias(a) for c, a in (("net_paise", "proof_net"), ("gross_paise", "proof_gross"), ("tax_paise", "fit_tax"))]
    proof = cited.join(decided.where("verdict = 'PROVEN'").select("settlement_id"), "settlement_id", "left_semi").groupBy("settlement_id").agg(*sums, F.min("method").alias("least_method"))
    disputed = evidence.settled_disputed(cited).select("settlement_id", "disputed_paise", "settled_paise")
    partial = matching.baseline_greedy(cascade.open_pools(decided, payouts, orders, "CONTRADICTED")).select("settlement_id", "filled_paise")  # pools that were solved: MAX_POOL orders at most
    own = payouts.select("settlement_id", "settled_on", "net_paise").join(decided, "settlement_id")
    for more in (space, proof, disputed, partial):
        own = own.join(more, "settlement_id", "left")
    alone, verdict = F.size("order_ids") == 1, F.col("verdict")
    return own.select(
        "settlement_id", "settled_on", "net_paise", "verdict", F.size("explanations").cast("long").alias("n_fits"), F.when(alone, F.col("order_ids")[0]).alias("order_id"),
        F.when(verdict == "PROVEN", F.col("proof_net")).when(verdict == "AMBIGUOUS", F.col("disputed_paise")).alias("fit_net"), F.when(verdict == "PROVEN", F.col("proof_gross")).alias("fit_gross"),
        F.when(alone, F.col("least_method")).alias("method"), "candidates", "pool_net", "integrity", "density",
        "order_ids", F.when(verdict == "PROVEN", F.col("fit_tax")).alias("fit_tax"), F.when(verdict == "CONTRADICTED", F.col("net_paise") - F.coalesce("filled_paise", F.lit(0))).alias("left_paise"),
        "universe", "removed", "layer", F.array_join("order_ids", " ").alias("proof"), "settled_paise",
    )


def severity(reason: Column, unexplained: Column, amount: Column) -> Column:
    high = (reason == "MISSING_TRANSACTION") | (unexplained >= amount) | (unexplained >= 100_000) | (unexplained * 4 > amount)
    return F.when(high, "HIGH").when((unexplained >= 5_000) | (unexplained * 50 > amount), "MEDIUM").otherwise("LOW")


def exceptions(found: DataFrame) -> DataFrame:
    """(settlement_id, reason, amount_paise, unexplained_paise, severity) of every finding that needs one.

    What a contradicted one leaves open is ``left_paise`` where findings have it, else what the whole pool leaves;
    a pool that doesn't reach the credit leaves the difference in either case.
    """
    net, short_of = F.col("net_paise"), F.col("net_paise") - F.col("pool_net")
    short = F.col("pool_net") < net - F.greatest(F.col("candidates"), F.lit(1))
    left = F.when(short, short_of).otherwise(F.col("left_paise")) if "left_paise" in found.columns else short_of
    small = (left > 0) & (left < money.floor_div(net, 4))
    reason = (
        F.when(F.col("verdict") == "PROVEN", "SEARCH_SPACE_UNCERTAIN")
        .when(F.col("verdict") == "INSUFFICIENT", "INSUFFICIENT_EVIDENCE")
        .when(F.col("verdict") == "AMBIGUOUS", "MULTIPLE_VALID_ASSIGNMENTS")
        .when(short, "MISSING_TRANSACTION").when(small, "UNKNOWN_ADJUSTMENT").otherwise("NO_VALID_ASSIGNMENT")
    )
    unexplained = F.when(F.col("verdict") == "PROVEN", F.lit(0)).when(F.col("verdict") == "INSUFFICIENT", net).when(F.col("verdict") == "AMBIGUOUS", F.col("fit_net")).otherwise(left)
    own = found.select("settlement_id", "settled_on", "verdict", net.alias("amount_paise"), reason.alias("reason"), unexplained.cast("long").alias("unexplained_paise"))
    graded = F.when(F.col("verdict") == "PROVEN", F.when(F.col("amount_paise") < 100_000, "LOW").otherwise("MEDIUM")).otherwise(severity(F.col("reason"), F.col("unexplained_paise"), F.col("amount_paise")))
    return own.withColumn("severity", graded)


def action_plan(found: DataFrame) -> DataFrame:
    """Per reason: items, amounts, steps and leverage (value for a step), best first by rank columns."""
    grouped = exceptions(found).groupBy("reason").agg(F.count("*").alias("items"), F.sum("amount_paise").alias("value_paise"), F.sum("unexplained_paise").alias("unexplained_paise"), F.min("settlement_id").alias("example"))
    steps = F.when(F.col("reason").isin(*PER_ITEM), F.col("items")).otherwise(1)
    return grouped.withColumn("steps", steps.cast("long")).withColumn("leverage", money.floor_div_columns(F.col("value_paise"), F.col("steps")))
