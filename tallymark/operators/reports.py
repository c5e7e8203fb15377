"""Reports over findings: metrics, funnels, queues to work on, exports, certificates, components."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymark.functions import money
from tallymark.sources import shared

#: An ambiguous payout of this amount or more asks for attention first.
HIGH_VALUE = 5_000_000


def metrics(found: DataFrame, members: DataFrame) -> DataFrame:
    """One row of counts and rates against the truth."""
    true = members.groupBy("settlement_id").agg(F.count("*").alias("k"), F.min("order_id").alias("true_order"))
    own = found.join(true, "settlement_id", "left")
    proven = F.col("verdict") == "PROVEN"
    exact = proven & (F.col("k") == 1) & (F.col("true_order") == F.col("order_id"))
    sums = own.agg(F.count("*").alias("total"), F.count_if(proven).alias("proven"), F.count_if(F.col("verdict") == "AMBIGUOUS").alias("ambiguous"), F.count_if(F.col("verdict") == "CONTRADICTED").alias("contradicted"), F.count_if(exact).alias("exact"), F.count_if(proven & ~F.coalesce(exact, F.lit(False))).alias("false_proofs"))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return sums.select("*", share(F.col("exact"), F.col("total")).alias("exact_rate"), share(F.col("proven"), F.col("total")).alias("coverage"), share(F.col("exact"), F.col("proven")).alias("proof_precision"))


def blocking_recall(members: DataFrame) -> DataFrame:
    """(n_true, n_inside): true members (``blocking.membership``), and how many of them their payout's pool holds."""
    return members.agg(F.count("*").alias("n_true"), F.count_if(F.col("inside") & F.col("settlement_id").isNotNull()).alias("n_inside"))


def rule_sensitivity(orders: DataFrame, payouts: DataFrame, tables: dict[str, dict[str, int]]) -> DataFrame:
    """(rules, balanced): true bundles that still balance under other fee schedules."""
    out = None
    for name, table in tables.items():
        nets = orders.groupBy("truth_key").agg(F.sum(money.net(F.col("gross_paise"), F.col("method"), table)).alias("net"), F.count("*").alias("k"))
        row = payouts.join(nets, "truth_key").agg(F.count_if(F.abs(F.col("net_paise") - F.col("net")) <= F.col("k")).alias("balanced")).withColumn("rules", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def attention(excepted: DataFrame, top: int = 5) -> DataFrame:
    """The largest items of each group, ranked: (group, rank, settlement_id, amount_paise)."""
    group = (
        F.when((F.col("verdict") == "AMBIGUOUS") & (F.col("amount_paise") >= HIGH_VALUE), "HIGH_VALUE_AMBIGUITY").when(F.col("verdict") == "CONTRADICTED", "CONTRADICTED")
        .when(F.col("verdict") == "INSUFFICIENT", "INSUFFICIENT").when(F.col("verdict") == "AMBIGUOUS", "AMBIGUOUS")
    )
    rows = excepted.withColumn("attention_group", group).where("attention_group is not null")
    by = Window.partitionBy("attention_group").orderBy(F.desc("amount_paise"), "settlement_id")  # a limit on the rank: Spark keeps only the first rows of each task before the shuffle
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).select("attention_group", "rank", "settlement_id", "amount_paise")


def spine(found: DataFrame, judged: DataFrame) -> DataFrame:
    """Value that goes on and value that is held at each stage."""
    own = found.join(judged.select("settlement_id", "decision"), "settlement_id")
    stages = {"1_ingested": F.lit(True), "2_has_candidates": F.col("candidates") > 0, "3_explained": F.col("n_fits") > 0, "4_proven": F.col("verdict") == "PROVEN", "5_posted": F.col("decision") == "AUTO_POST"}
    sums = own.agg(F.sum("net_paise").alias("total"), *[F.coalesce(F.sum(F.when(c, F.col("net_paise"))), F.lit(0)).alias(name) for name, c in stages.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("stage"), F.col(name).alias("continues_paise"), (F.col("total") - F.col(name)).alias("held_paise")) for name in stages])
    return sums.select(F.inline(rows))


def export_queue(excepted: DataFrame) -> DataFrame:
    """Unresolved items for people to work on, as flat rows."""
    question = F.when(F.col("verdict") == "AMBIGUOUS", "Which of the equal explanations is right?").when(F.col("verdict") == "CONTRADICTED", "Which transaction is missing?").otherwise("What other evidence is there?")
    return excepted.where("verdict <> 'PROVEN'").select("settlement_id", "verdict", "reason", "severity", money.rupees(F.col("amount_paise")).alias("amount"), "unexplained_paise", question.alias("question"))


def certificates(verdicts: DataFrame) -> DataFrame:
    """(period_id, evidence_hash, certificate_id): SHA-256 of each verdict as canonical JSON.

    Keys stand in order, without spaces, so that any reader can hash the row again.
    """
    names = sorted(verdicts.columns)
    kinds = dict(verdicts.dtypes)
    parts = []
    for k, name in enumerate(names):
        value = F.concat(F.lit('"'), F.col(name), F.lit('"')) if kinds[name] == "string" else F.col(name).cast("string")
        parts += [F.lit(f'{"," if k else ""}"{name}":'), F.coalesce(value, F.lit("null"))]
    digest = F.sha2(F.concat(F.lit("{"), *parts, F.lit("}")), 256)
    return verdicts.select("period_id", digest.alias("evidence_hash")).withColumn("certificate_id", F.concat(F.lit("CERT-"), "period_id", F.lit("-"), F.substring("evidence_hash", 1, 8)))


def evidence_hash(row: dict) -> str:
    """What ``certificates`` gives for one row of plain values."""
    return hashlib.sha256(json.dumps(row, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def conflict_components(fits: DataFrame) -> DataFrame:
    """(settlement_id, component): payouts that are joined by orders that several could hold.

    Smallest labels spread over orders, and then to the label's own label, so that chains halve,
    until none changes; each round is written out.
    """
    edges = shared.stored(fits.select("settlement_id", "order_id").distinct(), "claims")
    labels = edges.select("settlement_id").distinct().withColumn("component", F.col("settlement_id"))
    while True:
        by_order = edges.join(labels, "settlement_id").groupBy("order_id").agg(F.min("component").alias("low"))
        lowest = edges.join(by_order, "order_id").groupBy("settlement_id").agg(F.min("low").alias("low"))
        near = labels.join(lowest, "settlement_id").select("settlement_id", F.col("component").alias("was"), F.least("component", "low").alias("component"))
        heads = labels.select(F.col("settlement_id").alias("component"), F.col("component").alias("head"))
        stepped = shared.stored(near.join(heads, "component").select("settlement_id", "was", F.least("component", "head").alias("component")), "labels")
        labels = stepped.select("settlement_id", "component")
        if not stepped.where("was <> component").limit(1).count():
            return labels


def harness(found: DataFrame, members: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case and over all: exact, declined and wrong findings, and pairs found, wrong and missed.

    ``found`` has (settlement_id, verdict, proof: order ids joined by spaces)."""
    cited = found.where("proof is not null").select("settlement_id", F.explode(F.split("proof", " ")).alias("order_id"), F.lit(1).alias("cited"))
    met = cited.join(members.distinct().withColumn("true", F.lit(1)), ["settlement_id", "order_id"], "full_outer").groupBy("settlement_id").agg(
        F.count_if(F.col("cited").isNotNull() & F.col("true").isNotNull()).alias("tp"), F.count_if(F.col("true").isNull()).alias("fp"), F.count_if(F.col("cited").isNull()).alias("fn")
    )
    said, right = F.col("verdict") == "PROVEN", (F.col("fp") == 0) & (F.col("fn") == 0)
    own = found.select("settlement_id", "verdict").join(cases, "settlement_id").join(met, "settlement_id")
    sums = own.rollup("hazard").agg(
        F.count("*").alias("n"), F.count_if(said & right).alias("exact"), F.count_if(~said).alias("declined"), F.count_if(said & ~right).alias("wrong"),
        F.sum(F.when(said, F.col("tp")).otherwise(0)).alias("tp"), F.sum(F.when(said, F.col("fp")).otherwise(0)).alias("fp"), F.sum("fn").alias("fn"),
    )
    return sums.withColumn("hazard", F.coalesce("hazard", F.lit("all")))
