"""How a proof's value flows: from orders through the payout to fees, the bank and what is left over.

Edges carry paise: each order's gross into the payout, fee and tax out of it, the credit to the bank, and the
rounding between them as a drift, out of the payout or into it. What flows into a payout flows out again. Beyond
a number of lanes the smallest orders flow as one remainder.

Defined results: payouts without a proof have no flow; a drift of nothing has no edge; equal nets are in order of id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Orders that flow one by one (fixed value).
LANES = 18


def edges(members: DataFrame, payouts: DataFrame, lanes: int = LANES) -> DataFrame:
    """(settlement_id, source, target, kind, paise) of proofs given as rows (settlement_id, order_id, gross_paise, net_paise).

    ``payouts`` has (settlement_id, net_paise, utr); node names are an order's id, the payout's id, ``fee``, ``bank``,
    ``drift`` and ``remainder``.
    """
    by = Window.partitionBy("settlement_id").orderBy(F.desc("net_paise"), "order_id")
    placed = members.withColumn("lane", F.row_number().over(by))
    one = placed.where(F.col("lane") <= lanes).select("settlement_id", F.col("order_id").alias("source"), F.col("settlement_id").alias("target"), F.lit("ORDER").alias("kind"), F.col("gross_paise").alias("paise"))
    rest = placed.where(F.col("lane") > lanes).groupBy("settlement_id").agg(F.sum("gross_paise").alias("paise"))
    sums = members.groupBy("settlement_id").agg(F.sum("gross_paise").alias("gross"), F.sum("net_paise").alias("net")).join(payouts.select("settlement_id", F.col("net_paise").alias("credit"), "utr"), "settlement_id")

    def edge(rows: DataFrame, source: Column, target: Column, kind: Column, paise: Column) -> DataFrame:
        return rows.select("settlement_id", source.alias("source"), target.alias("target"), kind.alias("kind"), paise.cast("long").alias("paise"))

    own, drift = F.col("settlement_id"), F.col("net") - F.col("credit")
    out = [
        edge(rest, F.lit("remainder"), own, F.lit("ORDER"), F.col("paise")), edge(sums.where("gross <> net"), own, F.lit("fee"), F.lit("FEE_RULE"), F.col("gross") - F.col("net")),
        edge(sums, own, F.lit("bank"), F.when(F.col("utr").isNotNull(), "EXACT_UTR").otherwise("AMOUNT_MATCH"), F.col("credit")),
        edge(sums.where(drift > 0), own, F.lit("drift"), F.lit("ROUNDING"), drift), edge(sums.where(drift < 0), F.lit("drift"), own, F.lit("ROUNDING"), -drift),
    ]
    every = one
    for more in out:
        every = every.unionByName(more)
    return every


def nodes(flow: DataFrame) -> DataFrame:
    """(settlement_id, node, inflow, outflow, conserved): conserved is null for sources and sinks."""
    both = flow.select("settlement_id", F.col("source").alias("node"), F.lit(0).cast("long").alias("inflow"), F.col("paise").alias("outflow")).unionByName(
        flow.select("settlement_id", F.col("target").alias("node"), F.col("paise").alias("inflow"), F.lit(0).cast("long").alias("outflow"))
    )
    sums = both.groupBy("settlement_id", "node").agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"))
    return sums.withColumn("conserved", F.when(F.col("node") == F.col("settlement_id"), F.col("inflow") == F.col("outflow")))
