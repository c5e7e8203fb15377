"""Matching: bank credits to payouts by reference, payouts to single orders, simple baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymark.functions import money
from tallymark.operators import blocking

#: A reference in a narration: 9 to 14 digits (fixed pattern).
REFERENCE = r"\b(\d{9,14})\b"


def credit_to_payout(bank: DataFrame, payouts: DataFrame) -> DataFrame:
    """(txn_id, settlement_id, via): first known reference in the narration, else the only
    payout of that amount and day."""
    tokens = bank.select("txn_id", F.posexplode(F.regexp_extract_all("narration", F.lit(REFERENCE), F.lit(1))).alias("pos", "utr"))
    known = payouts.where("utr is not null").groupBy("utr").agg(F.max("settlement_id").alias("settlement_id"))
    by_ref = tokens.join(known, "utr").groupBy("txn_id").agg(F.min_by("settlement_id", "pos").alias("by_ref"))
    alone = payouts.groupBy(F.col("net_paise").alias("credit_paise"), F.col("settled_on").alias("value_date")).agg(F.min("settlement_id").alias("by_amount"), F.count("*").alias("n")).where("n = 1").drop("n")
    joined = bank.join(by_ref, "txn_id", "left").join(alone, ["credit_paise", "value_date"], "left")
    return joined.select("txn_id", F.coalesce("by_ref", "by_amount").alias("settlement_id"), F.when(F.col("by_ref").isNotNull(), "reference").when(F.col("by_amount").isNotNull(), "amount").otherwise("none").alias("via"))


def single_fits(pool: DataFrame, slack: int = 1) -> DataFrame:
    """Pool rows whose one order explains the credit within ``slack``."""
    return pool.where(F.abs(F.col("net_paise") - F.col("credit_paise")) <= slack)


def single_match(pool: DataFrame) -> DataFrame:
    """(settlement_id, order_id, n_fits): the order where exactly one fits."""
    fits = single_fits(pool).groupBy("settlement_id").agg(F.count("*").alias("n_fits"), F.min("order_id").alias("order_id"))
    return fits.where("n_fits = 1").select("settlement_id", "order_id")


def pair_subsets(payouts: DataFrame, orders: DataFrame) -> DataFrame:
    """Pairs of pool orders whose nets come within a paisa for each of the credit, from below."""
    return blocking.credit_pairs(payouts, orders).select("settlement_id", "first_order", "second_order", "residual")


def baseline_exact(pool: DataFrame) -> DataFrame:
    fits = pool.where("net_paise = credit_paise").groupBy("settlement_id").agg(F.count("*").alias("n"), F.min("order_id").alias("order_id"))
    return fits.where("n = 1").select("settlement_id", "order_id")


def baseline_fuzzy(pool: DataFrame) -> DataFrame:
    """The first order, by day and id, within one percent of the credit."""
    near = pool.where(F.abs(F.col("net_paise") - F.col("credit_paise")) * 100 <= F.col("credit_paise"))
    first = near.groupBy("settlement_id").agg(F.min(F.struct("captured_on", "order_id")).alias("first"))
    return first.select("settlement_id", F.col("first.order_id").alias("order_id"))


def baseline_greedy(pool: DataFrame) -> DataFrame:
    """Largest first while it fits; kept if at most one percent is left.

    The pool of a payout is bounded by its capture days; it is folded as one sorted array.
    """
    rows = pool.groupBy("settlement_id", "credit_paise").agg(F.sort_array(F.collect_list(F.struct((-F.col("net_paise")).alias("minus"), "order_id"))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<string>").alias("orders"))
    filled = rows.withColumn("fill", F.aggregate("rows", start, lambda a, x: F.when(a.total - x.minus <= F.col("credit_paise"), F.struct((a.total - x.minus).alias("total"), F.concat(a.orders, F.array(x.order_id)).alias("orders"))).otherwise(a)))
    return filled.select("settlement_id", F.size("fill.orders").alias("n_orders"), F.col("fill.total").alias("filled_paise"), ((F.col("credit_paise") - F.col("fill.total")) * 100 <= F.col("credit_paise")).alias("accepted"))


def greedy_fills(payouts: DataFrame, orders: DataFrame) -> DataFrame:
    """(settlement_id, credit_paise, n_orders, filled_paise): each payout's whole pool, largest first while it fits.

    Equal amounts of a day are one entry of that day's list, so that a payout folds a day's different amounts,
    not its orders; of an entry it takes as many as fit.
    """
    own = blocking.dated(orders.where("net_paise > 0").select("captured_on", "net_paise"), (2,))
    days = own.groupBy("pool_day", "net_paise").agg(F.count("*").alias("n"))  # one lag: a row for each order, shuffled once
    lists = days.groupBy("pool_day").agg(F.sort_array(F.collect_list(F.struct((-F.col("net_paise")).alias("minus"), "n"))).alias("amounts"))  # a day's different amounts
    own = payouts.where("net_paise > 0").select("settlement_id", F.col("settled_on").alias("pool_day"), F.col("net_paise").alias("credit_paise")).join(lists, "pool_day")
    none = F.lit(0).cast("long")

    def take(a: Column, x: Column) -> Column:
        k = F.least(x.n, money.floor_div_columns(F.col("credit_paise") - a.total, -x.minus))
        return F.struct((a.total - k * x.minus).alias("total"), (a.n + k).alias("n"))

    fill = F.aggregate("amounts", F.struct(none.alias("total"), none.alias("n")), take)
    own = own.select("settlement_id", "credit_paise", fill.alias("fill")).where("fill.n > 0")
    return own.select("settlement_id", "credit_paise", F.col("fill.n").cast("int").alias("n_orders"), F.col("fill.total").alias("filled_paise"))


def conflicts(payouts: DataFrame, orders: DataFrame) -> DataFrame:
    """(order_id, first, last, n): orders that several payouts could hold.

    A day's payouts are summed up once by falling credit; an order reads the entry of the least credit that holds it.
    """
    by = Window.partitionBy("pool_day").orderBy(F.desc("credit_paise"))  # payouts of a day; equal credits are one entry
    own = payouts.select("settlement_id", F.col("settled_on").alias("pool_day"), F.col("net_paise").alias("credit_paise")).where("credit_paise > 0")
    steps = own.select("pool_day", "credit_paise", F.min("settlement_id").over(by).alias("first"), F.max("settlement_id").over(by).alias("last"), F.count("*").over(by).alias("n")).distinct()
    days = steps.groupBy("pool_day").agg(F.sort_array(F.collect_list(F.struct("credit_paise", "first", "last", "n"))).alias("steps"))
    every = blocking.dated(orders.where("net_paise > 0").select("order_id", "captured_on", "net_paise"), (2,)).join(days, "pool_day")
    least = every.select("order_id", F.get(F.filter("steps", lambda s: s.credit_paise >= F.col("net_paise")), F.lit(0)).alias("s")).where("s is not null")
    grouped = least.groupBy("order_id").agg(F.min("s.first").alias("first_settlement"), F.max("s.last").alias("last_settlement"), F.sum("s.n").alias("n_settlements"))
    return grouped.where("n_settlements > 1")


def ranked_by_pool(space: DataFrame) -> DataFrame:
    """Work order, easiest first: by pool size, then id. Ranks are counted within size groups."""
    sizes = space.groupBy("candidates").agg(F.count("*").alias("n"))
    before = sizes.select("candidates", (F.sum("n").over(Window.orderBy("candidates").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))  # one row for each pool size
    own = F.row_number().over(Window.partitionBy("candidates").orderBy("settlement_id"))
    return space.join(before, "candidates").select("settlement_id", "candidates", (own + F.coalesce("before", F.lit(0))).cast("long").alias("work_order"))
