"""A synthetic portfolio with known truth, made from row numbers alone.

Payouts are rows of ``spark.range``; every choice is arithmetic on (payout, place, seed), so any
part can be made anywhere and again, at any size. Orders come first and payouts from them; then the
payout's case distorts its amount, its day or its reference, as real ones are distorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import calendar as cal
from tallymark.functions import money

#: Shares of the cases, in hundredths (fixed values).
MIX = {
    "clean": 30, "missing_ref": 9, "bundle_large": 14, "split_order": 5, "refund_offset": 8, "chargeback_reversal": 3, "duplicate_amount": 5, "timing_gap": 6,
    "month_boundary": 3, "orphan_order": 4, "orphan_settlement": 2, "narration_garble": 4, "name_variant": 3, "mixed_method": 2, "ambiguous_subset": 2,
}
#: Smallest and first too large gross of an order, in paise; days that captures spread over (fixed values).
GROSS, DAYS, START = (9_900, 450_000), 90, "2026-05-01"


def turn(*parts: Column | int, of: int) -> Column:
    """A number from 0 to below ``of`` that looks random in its parts: products modulo a prime, in 64 bits throughout."""
    out = F.lit(7).cast("long")
    for p in parts:
        p = F.lit(p) if isinstance(p, int) else p
        out = F.pmod((out * 48_271 + p.cast("long") * 69_621 + 12_345) * 1_103, F.lit(2_147_483_647))
    return F.pmod(out, F.lit(of))


def payouts_of(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(payout, case, captured_on, n_orders) of n payouts."""
    k, roll = F.col("payout"), turn(F.col("payout"), seed, 1, of=100)
    case, upto = F.lit(None).cast("string"), 100
    for name, share in reversed(MIX.items()):
        upto -= share
        case = F.when(roll < upto + share, name).otherwise(case) if upto + share == 100 else F.when(roll < upto + share, F.lit(name)).otherwise(case)
    own = spark.range(n).withColumnRenamed("id", "payout").withColumn("case", case)
    size = F.when(F.col("case") == "clean", 1 + turn(k, seed, 2, of=6)).when(F.col("case") == "bundle_large", 20 + turn(k, seed, 2, of=21)).when(F.col("case") == "ambiguous_subset", 3 + turn(k, seed, 2, of=3)).otherwise(3 + turn(k, seed, 2, of=10))
    day = F.when(F.col("case") == "month_boundary", 27 + turn(k, seed, 3, of=4)).otherwise(turn(k, seed, 3, of=DAYS))
    return own.withColumn("captured_on", F.date_add(F.lit(START).cast("date"), day.cast("int"))).withColumn("n_orders", size.cast("long"))


def orders_of(payouts: DataFrame, seed: int) -> DataFrame:
    """(order_id, payout, captured_on, gross_paise, method, payment_id, net_paise): the truth of each payout."""
    rows = payouts.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_orders") - 1)))
    k, j, case = F.col("payout"), F.col("place"), F.col("case")
    pick = turn(k, j, seed, 4, of=100)
    cycle = F.element_at(F.array(F.lit("upi"), F.lit("card"), F.lit("wallet")), (F.pmod(j, F.lit(3)) + 1).cast("int"))
    drawn = F.when(pick < 55, "upi").when(pick < 80, "card").when(pick < 92, "netbanking").otherwise("wallet")
    gross = GROSS[0] + turn(k, F.when((case == "duplicate_amount") & (j == 1), 0).otherwise(j), seed, 5, of=GROSS[1] - GROSS[0])
    method = F.when(case == "mixed_method", cycle).when((case == "duplicate_amount") & (j < 2), "upi").otherwise(drawn)
    lost = (case == "missing_ref") & (turn(k, j, seed, 6, of=100) < 60)
    number = k * 64 + j
    own = rows.select(
        F.concat(F.lit("ord_"), F.lpad(number.cast("string"), 9, "0")).alias("order_id"), "payout", "place", "captured_on", gross.cast("long").alias("gross_paise"), method.alias("method"),
        F.when(~lost, F.concat(F.lit("pay_"), number.cast("string"))).alias("payment_id"),
    )
    return own.withColumn("net_paise", money.net(F.col("gross_paise"), F.col("method")))


def settled(payouts: DataFrame, orders: DataFrame, seed: int) -> DataFrame:
    """(settlement_id, case, settled_on, net_paise, utr, narration) of each payout."""
    sums = orders.groupBy("payout").agg(F.sum("net_paise").alias("clean"), F.max_by("net_paise", "place").alias("last_net"))
    k, case = F.col("payout"), F.col("case")
    refund = 5_000 + turn(k, seed, 7, of=145_000)
    off = (
        F.when(case == "split_order", -money.floor_div(F.col("last_net"), 2)).when(case == "refund_offset", -F.least(refund, F.greatest(F.lit(5_000), money.floor_div(F.col("clean"), 3))))
        .when(case == "chargeback_reversal", -(GROSS[0] + turn(k, seed, 8, of=GROSS[1] - GROSS[0]))).when(case == "orphan_settlement", GROSS[0] + turn(k, seed, 9, of=GROSS[1] - GROSS[0])).otherwise(0)
    )
    utr = F.lpad((100_000_000_000 + turn(k, seed, 10, of=899_999_999)).cast("string"), 12, "0")
    whole = F.concat(F.lit("NEFT-"), utr, F.lit("-GATEWAY PVT LTD-SETTLEMENT"))
    style = turn(k, seed, 11, of=3)
    garbled = F.when(style == 0, F.substring(whole, 1, 14)).when(style == 1, F.lower(whole)).otherwise(F.concat(F.lit("NEFT-"), F.substring(utr, 1, 6), F.lit("XXXXXX-GATEWAY")))
    return payouts.join(sums, "payout").select(
        F.concat(F.lit("setl_"), F.lpad(k.cast("string"), 6, "0")).alias("settlement_id"), "case", cal.business_days_after(F.col("captured_on"), F.when(case == "timing_gap", 4).otherwise(2)).alias("settled_on"),
        (F.col("clean") + off).cast("long").alias("net_paise"), utr.alias("utr"), F.when(case == "narration_garble", garbled).otherwise(whole).alias("narration"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """A table as CSV files with a header; arrays are joined by spaces, null is empty."""
    flat = [F.concat_ws(" ", c).alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes]
    df.select(flat).write.option("header", True).csv(path)
