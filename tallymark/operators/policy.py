"""Risk strata, decisions, what policies would cost, and the journal they lead to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import money

Z95 = 1.959963985
MIN_OBSERVATIONS = 30


@dataclass(frozen=True)
class Costs:
    review: int = 25_000
    wrong_fixed: int = 250_000
    wrong_rate_bps: int = 3_000
    max_exposure: int = 10_000_000


def wilson_upper(wrong: Column, total: Column, z: float = Z95) -> Column:
    """Upper end of the 95 % interval of a share; 1 without observations."""
    n = total.cast("double")
    p = wrong / n
    upper = (p + z * z / (2 * n) + z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return F.when(total <= 0, F.lit(1.0)).otherwise(F.least(upper, F.lit(1.0)))


def cheapness(density: Column) -> Column:
    """How easily a pool explains a sum by chance, by the share of sums near it that it reaches;
    unmeasured where the solver didn't run."""
    return F.when(density.isNull(), "unmeasured").when(density < 0.02, "sparse").when(density < 0.25, "moderate").otherwise("dense")


def strata(found: DataFrame, members: DataFrame) -> DataFrame:
    """(integrity, cheapness, wrong, total, p_error) of PROVEN findings against the truth;
    p_error is null under MIN_OBSERVATIONS. A proof is right if its orders are just those of the truth."""
    true = members.groupBy("settlement_id").agg(F.count("*").alias("k"), F.min("order_id").alias("true_order"))
    proven = found.where("verdict = 'PROVEN'").join(true, "settlement_id", "left")
    if "order_ids" in found.columns:
        cited = found.where("verdict = 'PROVEN'").select("settlement_id", F.explode("order_ids").alias("order_id"))
        met = cited.join(members.select("settlement_id", "order_id"), ["settlement_id", "order_id"]).groupBy("settlement_id").agg(F.count("*").alias("n_met"))
        proven = proven.join(met, "settlement_id", "left")
        right = (F.coalesce("k", F.lit(0)) == F.size("order_ids")) & (F.coalesce("n_met", F.lit(0)) == F.size("order_ids"))
    else:
        right = (F.coalesce("k", F.lit(0)) == 1) & (F.col("true_order") == F.col("order_id"))
    grouped = proven.groupBy("integrity", cheapness(F.col("density")).alias("cheapness")).agg(F.sum(F.when(right, 0).otherwise(1)).alias("wrong"), F.count("*").alias("total"))
    return grouped.withColumn("p_error", F.when(F.col("total") >= MIN_OBSERVATIONS, wilson_upper(F.col("wrong"), F.col("total"))))


def decide(found: DataFrame, risk: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """(settlement_id, verdict, net_paise, p_error, expected_loss, decision)."""
    own = found.withColumn("cheapness", cheapness(F.col("density"))).join(F.broadcast(risk.select("integrity", "cheapness", "p_error")), ["integrity", "cheapness"], "left")  # three strata at most
    wrong_post = F.lit(costs.wrong_fixed) + money.floor_div(F.col("net_paise") * costs.wrong_rate_bps, 10_000)
    loss = F.when(F.col("verdict") == "PROVEN", F.ceil(F.col("p_error") * wrong_post).cast("long"))
    decision = (
        F.when(F.col("verdict") != "PROVEN", "REVIEW").when(F.col("integrity") == "COMPROMISED", "BLOCK").when(F.col("p_error").isNull(), "BLOCK")
        .when(F.col("net_paise") > costs.max_exposure, "REVIEW").when(loss < costs.review, "AUTO_POST").otherwise("REVIEW")
    )
    return own.select("settlement_id", "verdict", "net_paise", F.when(F.col("verdict") == "PROVEN", F.col("p_error")).alias("p_error"), loss.alias("expected_loss"), decision.alias("decision"))


def frontier(judged: DataFrame, review_costs: tuple[int, ...]) -> DataFrame:
    """Posted and reviewed amounts at each review cost."""
    prices = judged.sparkSession.createDataFrame([(c,) for c in review_costs], "review_cost long")
    rows = judged.where("verdict = 'PROVEN'").crossJoin(F.broadcast(prices))  # a fixed list of costs
    posts = (F.col("expected_loss") < F.col("review_cost")) & (F.col("net_paise") <= Costs().max_exposure)
    return rows.groupBy("review_cost").agg(
        F.count_if(posts).alias("posted"), F.coalesce(F.sum(F.when(posts, F.col("net_paise"))), F.lit(0)).alias("posted_paise"),
        F.coalesce(F.sum(F.when(posts, F.col("expected_loss"))), F.lit(0)).alias("expected_loss"),
    )


def journal(found: DataFrame, judged: DataFrame) -> DataFrame:
    """Four lines for every finding that posts; debits and credits balance by construction."""
    rows = found.join(judged.where("decision = 'AUTO_POST'").select("settlement_id"), "settlement_id")
    own_tax = F.col("fit_tax") if "fit_tax" in found.columns else money.tax(money.fee(F.col("fit_gross"), F.col("method")))
    zero = F.lit(0).cast("long")

    def line(no: int, account: str, debit: Column, credit: Column) -> Column:
        return F.struct(F.lit(no).alias("line_no"), F.lit(account).alias("account"), debit.cast("long").alias("debit_paise"), credit.cast("long").alias("credit_paise"))

    lines = F.array(
        line(1, "Bank", F.col("net_paise"), zero), line(2, "Gateway fees", F.col("fit_gross") - F.col("net_paise") - own_tax, zero),
        line(3, "GST on fees", own_tax, zero), line(4, "Receivables", zero, F.col("fit_gross")),
    )
    return rows.select("settlement_id", F.inline(lines))


def refusals(judged: DataFrame) -> DataFrame:
    """Why findings aren't posted: groups with count, amount and the largest example."""
    why = F.when(F.col("verdict") != "PROVEN", F.concat(F.lit("VERDICT_"), F.col("verdict"))).otherwise(F.concat(F.lit("POLICY_"), F.col("decision")))
    rows = judged.where("decision <> 'AUTO_POST'").withColumn("refusal", why)
    largest = F.min(F.struct((-F.col("net_paise")).alias("minus"), "settlement_id"))
    return rows.groupBy("refusal").agg(F.count("*").alias("n"), F.sum("net_paise").alias("amount_paise"), largest.alias("top")).select("refusal", "n", "amount_paise", F.col("top.settlement_id").alias("largest"))
