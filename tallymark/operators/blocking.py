"""Blocking: which captures may belong to a payout, by inverted calendar and amount.

A payout of a day can only hold captures of the days that settle on it, so candidates come
from an equi-join on the settlement day, which is reckoned from the capture day for each lag; the
amount ceiling is a condition of that join. Sizes and single fits have ways of their own,
which don't form the pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import calendar as cal
from tallymark.sources.shared import stored

#: Ids of several orders up to which their hashes are broadcast.
MOST_REPEATED = 500_000


def dated(orders: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """Orders with each day they may settle on (column pool_day), once for each such day."""
    days = F.array_distinct(F.array(*[cal.business_days_after(F.col("captured_on"), n) for n in lags]))
    return orders.where("captured_on is not null").withColumn("pool_day", F.explode(days))


def near(wanted: DataFrame, orders: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """Orders as ``dated`` has them, where ``wanted`` (pool_day, low, high) asks their day for amounts around theirs.

    Only these are shuffled: days are broadcast with their least and largest amount, a row for each day of the calendar.
    """
    days = wanted.where("pool_day is not null").groupBy("pool_day").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return dated(orders, lags).join(F.broadcast(days), "pool_day").where(F.col("net_paise").between(F.col("low"), F.col("high"))).drop("low", "high")


def laddered(orders: DataFrame, ladder: tuple[tuple[int, ...], ...]) -> DataFrame:
    """Orders with each day they may settle on (pool_day) and the first rung of the ladder that looks there.

    Different lags give different days, since n business days on is a later day for a larger n.
    """
    first = {lag: rung for rung in reversed(range(len(ladder))) for lag in ladder[rung]}
    days = [F.struct(cal.business_days_after(F.col("captured_on"), lag).alias("pool_day"), F.lit(rung).alias("rung")) for lag, rung in sorted(first.items())]
    return orders.where("captured_on is not null").select("*", F.inline(F.array(*days)))


def pools(payouts: DataFrame, orders: DataFrame, lags: tuple[int, ...] = (2,)) -> DataFrame:
    """(settlement_id, credit_paise, order columns): candidates with 0 < net <= credit."""
    own = payouts.select("settlement_id", F.col("settled_on").alias("pool_day"), F.col("net_paise").alias("credit_paise"))
    every = near(own.select("pool_day", F.lit(1).cast("long").alias("low"), F.col("credit_paise").alias("high")), orders.where("net_paise > 0"), lags)
    return own.join(every, "pool_day").where(F.col("net_paise") <= F.col("credit_paise")).drop("pool_day")


def credit_fits(payouts: DataFrame, orders: DataFrame, lags: tuple[int, ...] = (2,), slack: int = 1) -> DataFrame:
    """The rows of ``pools`` whose one order comes within ``slack`` of the credit, from below.

    An equi-join on day and amount: the rest of the pool isn't formed.
    """
    own = payouts.select("settlement_id", F.col("settled_on").alias("pool_day"), F.col("net_paise").alias("credit_paise"))
    wanted = own.withColumn("net_paise", F.explode(F.array(*[F.col("credit_paise") - n for n in range(slack + 1)])))
    every = near(own.select("pool_day", (F.col("credit_paise") - slack).alias("low"), F.col("credit_paise").alias("high")), orders.where("net_paise > 0"), lags)
    return wanted.join(every, ["pool_day", "net_paise"]).drop("pool_day")


def credit_pairs(payouts: DataFrame, orders: DataFrame, lags: tuple[int, ...] = (2,), slack: int = 2) -> DataFrame:
    """(settlement_id, credit_paise, residual, first_* and second_* of order, net, gross): pairs of a pool's orders that
    come within ``slack`` of the credit, from below; first_order is the smaller id.

    The pool isn't formed: a pair's larger half is at least half of what is wanted, so a payout meets only the
    bands from there to its credit, and the other half is an equi-join on day and amount.
    """
    credit, least = F.col("credit_paise"), F.greatest(F.floor((F.col("credit_paise") - slack + 1) / 2).cast("long"), F.lit(1).cast("long"))
    own = payouts.where("settlement_id is not null and net_paise > 1").select("settlement_id", F.col("settled_on").alias("pool_day"), F.col("net_paise").alias("credit_paise"))
    lean = orders.where("net_paise > 0").select("order_id", "captured_on", "net_paise", "gross_paise")
    large = near(own.select("pool_day", least.alias("low"), (credit - 1).alias("high")), lean, lags).drop("captured_on")
    bands = own.withColumn("band", F.explode(F.sequence(band(least), band(credit))))
    half = bands.join(large.withColumn("band", band(F.col("net_paise"))), ["pool_day", "band"]).where((F.col("net_paise") >= least) & (F.col("net_paise") < credit))
    half = stored(half.select("settlement_id", "pool_day", "credit_paise", F.struct("order_id", "net_paise", "gross_paise").alias("one")), "halves")
    wanted = half.withColumn("residual", F.explode(F.array(*[F.lit(n).cast("long") for n in range(slack + 1)]))).withColumn("net_paise", credit - F.col("one.net_paise") - F.col("residual"))
    wanted = wanted.where((F.col("net_paise") > 0) & (F.col("net_paise") <= F.col("one.net_paise")))
    small = near(wanted.select("pool_day", F.col("net_paise").alias("low"), F.col("net_paise").alias("high")), lean, lags).drop("captured_on")
    met = wanted.join(small, ["pool_day", "net_paise"]).withColumn("two", F.struct("order_id", "net_paise", "gross_paise"))
    ahead = F.col("one.order_id") < F.col("two.order_id")
    met = met.where(ahead | ((F.col("two.net_paise") < F.col("one.net_paise")) & (F.col("one.order_id") > F.col("two.order_id"))))  # equal halves meet both ways
    first, second = F.when(ahead, F.col("one")).otherwise(F.col("two")), F.when(ahead, F.col("two")).otherwise(F.col("one"))
    met = met.select("settlement_id", "credit_paise", "residual", first.alias("a"), second.alias("b"))
    return met.select("settlement_id", "credit_paise", "residual", *[F.col(f"{s}.{c}").alias(f"{n}_{c.removesuffix('_paise').removesuffix('_id')}") for s, n in (("a", "first"), ("b", "second")) for c in ("order_id", "net_paise", "gross_paise")])


def held(cited: DataFrame, payouts: DataFrame, orders: DataFrame, lags: tuple[int, ...] = (2,)) -> DataFrame:
    """(settlement_id, order_id, captured_on): the rows of ``cited`` (settlement_id, order_id) that lie in their payout's pool, once or more."""
    own = cited.select("settlement_id", "order_id").join(payouts.select("settlement_id", F.col("settled_on").alias("pool_day"), F.col("net_paise").alias("credit_paise")), "settlement_id")
    every = near(own.select("pool_day", F.lit(1).cast("long").alias("low"), F.col("credit_paise").alias("high")), orders.where("net_paise > 0").select("order_id", "captured_on", "net_paise"), lags)
    return own.join(every, ["order_id", "pool_day"]).where(F.col("net_paise") <= F.col("credit_paise")).select("settlement_id", "order_id", "captured_on")


def membership(members: DataFrame, payouts: DataFrame, orders: DataFrame, lags: tuple[int, ...] = (2,)) -> DataFrame:
    """(settlement_id, order_id, inside): each different row of ``members``, and whether it lies in its payout's pool.

    Members meet their own order instead of the pools; join and grouping are both spread by order.
    """
    credits = payouts.select("settlement_id", F.col("settled_on").alias("own_day"), F.col("net_paise").alias("credit_paise"))
    every = dated(orders.where("net_paise > 0").select("order_id", "captured_on", "net_paise"), lags).drop("captured_on")
    met = members.select("settlement_id", "order_id").join(every, "order_id", "left").join(credits, "settlement_id", "left")
    inside = F.coalesce((F.col("pool_day") == F.col("own_day")) & (F.col("net_paise") <= F.col("credit_paise")), F.lit(False))
    return met.groupBy("settlement_id", "order_id").agg(F.max(inside).alias("inside"))


def own_membership(told: DataFrame, payouts: DataFrame, lags: tuple[int, ...] = (2,)) -> DataFrame:
    """``membership`` of every order in the payout it is said to be of; ``told`` has settlement_id, order_id, captured_on and net_paise.

    An id that no other order has needs its own row alone, so that only hashes of ids are shuffled, to find those that
    repeat; orders of such an id meet each other as ``membership`` has it.
    """
    key = F.xxhash64("order_id")
    told = told.select("settlement_id", "order_id", "captured_on", "net_paise")
    repeated = stored(told.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated")
    n = repeated.count()
    if n > MOST_REPEATED:
        return membership(told, payouts, told, lags)
    credits = payouts.groupBy("settlement_id").agg(F.collect_set(F.struct(F.col("settled_on").alias("day"), F.col("net_paise").alias("credit"))).alias("credits"))
    days = F.array(*[cal.business_days_after(F.col("captured_on"), n) for n in lags])
    inside = F.exists("credits", lambda c: F.array_contains(days, c.day) & (F.col("net_paise") <= c.credit)) & (F.col("net_paise") > 0)
    met = told.join(F.broadcast(credits), "settlement_id", "left").withColumn("inside", F.coalesce(inside, F.lit(False)))  # credits: a row for each day and desk
    if not n:
        return met.select("settlement_id", "order_id", "inside")
    few = F.broadcast(repeated)
    again = told.join(few, key == few["key"], "left_semi")
    return met.join(few, key == few["key"], "left_anti").select("settlement_id", "order_id", "inside").unionByName(membership(again, payouts, again, lags))


def band(net: Column) -> Column:
    """A number that never falls as an amount grows: four to each doubling; null unless positive."""
    return F.when(net > 0, F.floor(F.log2(net) * 4)).cast("int")


def pool_sizes(payouts: DataFrame, orders: DataFrame, lags: tuple[int, ...] = (2,)) -> DataFrame:
    """(settlement_id, in_window, candidates, pool_net): the size of each window and pool that holds an order.

    Exact, but a payout meets the day's bands (aggregated before the join) instead of the day's
    orders; only the different amounts of the credit's own band are compared one by one, and no others are
    shuffled. Rows grow with payouts times bands, not with payouts times orders of a day.
    """
    return _counted(payouts, orders, lags).groupBy("settlement_id").agg(*[F.sum(c).alias(c) for c in ("in_window", "candidates", "pool_net")])


def pool_days(payouts: DataFrame, orders: DataFrame, lags: tuple[int, ...] = (2,)) -> DataFrame:
    """(settlement_id, captured_on, n): how many orders of a pool each of its capture days gives, counted as ``pool_sizes`` does."""
    return _counted(payouts, orders, lags).groupBy("settlement_id", "captured_on").agg(F.sum("candidates").alias("n")).where("n > 0")


def _counted(payouts: DataFrame, orders: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    own = payouts.select("settlement_id", F.col("settled_on").alias("pool_day"), F.col("net_paise").alias("credit_paise"), band(F.col("net_paise")).alias("own_band"))
    rows = orders.where("captured_on is not null").select("captured_on", "net_paise", band(F.col("net_paise")).alias("band"))
    whole = rows.groupBy("captured_on", "band").agg(F.count("*").alias("n"), F.sum("net_paise").alias("net"))
    under = F.col("band") < F.col("own_band")
    none = F.lit(0).cast("long")
    below = own.join(dated(whole, lags), "pool_day").select("settlement_id", "captured_on", F.col("n").alias("in_window"), F.when(under, F.col("n")).otherwise(none).alias("candidates"), F.when(under, F.col("net")).otherwise(none).alias("pool_net"))
    asked = own.where("pool_day is not null and own_band is not null").select("pool_day", F.col("own_band").alias("band")).distinct()  # bands of a day's credits
    same = dated(rows.where("band is not null"), lags).join(F.broadcast(asked), ["pool_day", "band"], "left_semi")
    same = same.groupBy("pool_day", "band", "captured_on", "net_paise").agg(F.count("*").alias("n")).withColumn("net", F.col("net_paise") * F.col("n"))
    edge = own.join(same, (own["pool_day"] == same["pool_day"]) & (own["own_band"] == same["band"]) & (same["net_paise"] <= own["credit_paise"]))
    edge = edge.select("settlement_id", "captured_on", none.alias("in_window"), F.col("n").alias("candidates"), F.col("net").alias("pool_net"))
    return below.unionByName(edge)


def search_space(payouts: DataFrame, orders: DataFrame, lags: tuple[int, ...] = (2,)) -> DataFrame:
    """Per payout: universe, what each reduction removed, candidates and integrity.

    The date window is a heuristic, the amount ceiling is certain; a space with a heuristic
    reduction is HEURISTIC at best.
    """
    universe = orders.agg(F.count("*").alias("universe"))
    own = payouts.select("settlement_id").join(pool_sizes(payouts, orders, lags), "settlement_id", "left").crossJoin(F.broadcast(universe))  # one row
    in_window, candidates = F.coalesce("in_window", F.lit(0)), F.coalesce("candidates", F.lit(0))
    return own.select(
        "settlement_id", "universe", (F.col("universe") - in_window).alias("removed_by_date"), (in_window - candidates).alias("removed_by_amount"),
        candidates.alias("candidates"), F.coalesce("pool_net", F.lit(0)).cast("long").alias("pool_net"), F.lit("HEURISTIC").alias("integrity"),
    )
