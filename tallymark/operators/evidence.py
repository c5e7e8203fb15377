"""What explanations have in common, what they dispute, and whether a finding may be posted.

Explanations are rows (settlement_id, explanation, order_id, net_paise, gross_paise), one for each
order of each. Sets are compared by counting, so that no payout's explanations are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymark.functions import money
from tallymark.operators import blocking, matching
from tallymark.sources.shared import stored

#: Orders that a picture of the evidence shows one by one (fixed value).
MAX_LANES = 18


def small_explanations(payouts: DataFrame, orders: DataFrame) -> DataFrame:
    """(settlement_id, explanation, order_id, net_paise, gross_paise, k): all explanations of one or two orders.

    k orders may miss the credit by up to k paise, from below; a pair that holds an order which
    explains the credit alone isn't another explanation.
    """
    ones = blocking.credit_fits(payouts, orders).select("settlement_id", F.col("order_id").alias("explanation"), "order_id", "net_paise", "gross_paise", F.lit(1).alias("k"))
    alone = ones.select("settlement_id", "order_id")
    pairs = blocking.credit_pairs(payouts, orders)
    for name in ("first_order", "second_order"):
        pairs = pairs.join(alone.withColumnRenamed("order_id", name), ["settlement_id", name], "left_anti")
    both = F.inline(F.array(*[F.struct(F.col(f"{n}_order").alias("order_id"), F.col(f"{n}_net").alias("net_paise"), F.col(f"{n}_gross").alias("gross_paise")) for n in ("first", "second")]))
    return ones.unionByName(pairs.select("settlement_id", F.concat_ws(" ", "first_order", "second_order").alias("explanation"), both, F.lit(2).alias("k")))


def agreement(explained: DataFrame) -> DataFrame:
    """(settlement_id, order_id, net_paise, n_with, n_explanations, forced): how many explanations hold each order."""
    sizes = explained.groupBy("settlement_id").agg(F.count_distinct("explanation").alias("n_explanations"))
    each = explained.groupBy("settlement_id", "order_id", "net_paise").agg(F.count("*").alias("n_with"))
    return each.join(sizes, "settlement_id").withColumn("forced", F.col("n_with") == F.col("n_explanations"))


def settled_disputed(explained: DataFrame) -> DataFrame:
    """Per payout: explanations, orders in all of them and in some only, with their amounts."""
    forced = F.col("forced")
    return agreement(explained).groupBy("settlement_id", "n_explanations").agg(
        F.count_if(forced).alias("n_forced"), F.count_if(~forced).alias("n_contested"), F.coalesce(F.sum(F.when(forced, F.col("net_paise"))), F.lit(0)).alias("settled_paise"),
        F.coalesce(F.sum(F.when(~forced, F.col("net_paise"))), F.lit(0)).alias("disputed_paise"), F.min(F.when(forced, F.col("order_id"))).alias("first_forced"), F.min(F.when(~forced, F.col("order_id"))).alias("first_contested"),
    )


def findings(explained: DataFrame, space: DataFrame) -> DataFrame:
    """One finding for each payout of the space by its small explanations, with the facts that posting asks for."""
    counts = explained.groupBy("settlement_id").agg(F.count_distinct("explanation").alias("n_explanations"), F.min("explanation").alias("proof"), F.max("k").alias("k"))
    n = F.coalesce("n_explanations", F.lit(0))
    verdict = F.when(n == 1, "PROVEN").when(n > 1, "AMBIGUOUS").otherwise("CONTRADICTED")
    return space.join(counts, "settlement_id", "left").select(
        "settlement_id", verdict.alias("verdict"), n.alias("n_explanations"), F.when(n == 1, F.col("proof")).alias("proof"), "universe", "candidates", "integrity",
        (F.col("removed_by_date") + F.col("removed_by_amount")).alias("removed"), F.when(n > 0, F.when(F.col("k") == 1, "L2").otherwise("L3")).otherwise("").alias("layer"),
    )


def why_not_postable(found: DataFrame, members: DataFrame) -> DataFrame:
    """(settlement_id, verdict, postable, why): the first condition against posting, in their order.

    ``members`` has the pool's rows (settlement_id, order_id); a proof has to lie inside it.
    """
    cited = found.where("proof is not null").select("settlement_id", F.explode(F.split("proof", " ")).alias("order_id"))
    outside = cited.join(members.select("settlement_id", "order_id"), ["settlement_id", "order_id"], "left_anti").select("settlement_id").distinct().withColumn("outside", F.lit(True))
    own = found.join(outside, "settlement_id", "left")
    why = (
        F.when(F.col("verdict") != "PROVEN", "NOT_PROVEN").when(F.col("universe").isNull(), "NO_SPACE").when(F.col("universe") <= 0, "EMPTY_UNIVERSE").when(F.col("removed") <= 0, "NO_REDUCTIONS")
        .when(F.col("layer") == "", "NO_LAYER").when(F.col("proof").isNull(), "NO_PROOF").when(F.col("candidates") <= 0, "NO_MEMBERS").when(F.coalesce("outside", F.lit(False)), "PROOF_OUTSIDE_MEMBERS").when(F.col("integrity") == "COMPROMISED", "COMPROMISED")
    )
    return own.select("settlement_id", "verdict", why.isNull().alias("postable"), F.coalesce(why, F.lit("")).alias("why"))


def closest_partial(payouts: DataFrame, orders: DataFrame) -> DataFrame:
    """(settlement_id, n_orders, filled_paise, unexplained_paise): largest orders first while they fit."""
    return matching.greedy_fills(payouts, orders).select("settlement_id", "n_orders", "filled_paise", (F.col("credit_paise") - F.col("filled_paise")).alias("unexplained_paise"))


def certificate_lines(found: DataFrame, explained: DataFrame, payouts: DataFrame) -> DataFrame:
    """(settlement_id, line_no, statement, ok) of each proven finding: what its proof rests on."""
    totals = explained.groupBy("settlement_id", "explanation").agg(F.count("*").alias("k"), F.count_distinct("order_id").alias("distinct"), F.sum("net_paise").alias("net"), F.sum("gross_paise").alias("gross"))
    own = found.where("verdict = 'PROVEN'").join(totals, "settlement_id").join(payouts.select("settlement_id", F.col("net_paise").alias("credit")), "settlement_id")

    def line(no: int, statement: str, ok: Column) -> Column:
        return F.struct(F.lit(no).alias("line_no"), F.lit(statement).alias("statement"), ok.alias("ok"))

    left = F.col("credit") - F.col("net")
    lines = F.array(
        line(1, "residual within tolerance", F.abs(left) <= F.col("k")), line(2, "no order twice", F.col("k") == F.col("distinct")), line(3, "fees not negative", F.col("gross") >= F.col("net")),
        line(4, "only explanation found", F.col("n_explanations") == 1), line(5, "space reduced without guesses", F.when(F.col("integrity") == "VALIDATED", F.lit(True)).when(F.col("integrity") == "COMPROMISED", F.lit(False))),
    )
    return own.select("settlement_id", F.inline(lines))


def lanes(pool: DataFrame, most: int = MAX_LANES) -> DataFrame:
    """(settlement_id, lane, order_id, net_paise, above_paise): largest orders with what stands above
    each, and one lane for the rest with its count as id."""
    by = Window.partitionBy("settlement_id").orderBy(F.desc("net_paise"), "order_id")
    top = pool.withColumn("lane", F.row_number().over(by)).where(F.col("lane") <= most)
    top = top.withColumn("above_paise", F.coalesce(F.sum("net_paise").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    shown = top.groupBy("settlement_id").agg(F.count("*").alias("n_top"), F.sum("net_paise").alias("top_paise"))
    every = pool.groupBy("settlement_id").agg(F.count("*").alias("n"), F.sum("net_paise").alias("paise"))
    tail = every.join(shown, "settlement_id").where("n > n_top").select("settlement_id", F.lit(most + 1).alias("lane"), F.concat(F.lit("+"), (F.col("n") - F.col("n_top")).cast("string")).alias("order_id"), (F.col("paise") - F.col("top_paise")).alias("net_paise"), F.col("top_paise").alias("above_paise"))
    return top.select("settlement_id", "lane", "order_id", "net_paise", "above_paise").unionByName(tail)


def pool_lanes(payouts: DataFrame, orders: DataFrame, most: int = MAX_LANES) -> DataFrame:
    """The lanes of every payout's pool, without forming the pools.

    A day's orders are numbered by amount once; a pool's largest are those that follow the day's orders above the
    credit, and what is left of them comes from the pool's size and sum.
    """
    every = blocking.dated(orders.where("net_paise > 0").select("order_id", "captured_on", "net_paise"), (2,)).drop("captured_on")
    placed = every.withColumn("place", F.row_number().over(Window.partitionBy("pool_day").orderBy(F.desc("net_paise"), "order_id")))
    days = orders.where("net_paise > 0").groupBy("captured_on").agg(F.count("*").alias("n"))
    days = blocking.dated(days, (2,)).groupBy("pool_day").agg(F.sum("n").alias("of_day"))
    sizes = blocking.pool_sizes(payouts, orders).where("candidates > 0").select("settlement_id", "candidates", "pool_net")
    own = payouts.select("settlement_id", F.col("settled_on").alias("pool_day"))
    own = own.join(sizes, own["settlement_id"].eqNullSafe(sizes["settlement_id"])).drop(sizes["settlement_id"]).join(days, "pool_day").withColumn("over", F.col("of_day") - F.col("candidates"))
    own = stored(own, "spans")
    met = own.join(placed, "pool_day").where((F.col("place") > F.col("over")) & (F.col("place") <= F.col("over") + most))
    by = Window.partitionBy("settlement_id").orderBy("lane")
    top = met.withColumn("lane", (F.col("place") - F.col("over")).cast("int")).select("settlement_id", "lane", "order_id", "net_paise")
    top = top.withColumn("above_paise", F.coalesce(F.sum("net_paise").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    shown = met.where(F.col("candidates") > most).groupBy("settlement_id", "candidates", "pool_net").agg(F.sum("net_paise").alias("top_paise"))
    tail = shown.select("settlement_id", F.lit(most + 1).alias("lane"), F.concat(F.lit("+"), (F.col("candidates") - most).cast("string")).alias("order_id"), (F.col("pool_net") - F.col("top_paise")).alias("net_paise"), F.col("top_paise").alias("above_paise"))
    return top.unionByName(tail)


def densest_days(days: DataFrame, most: int = 3) -> DataFrame:
    """(settlement_id, place, captured_on, n): a pool's capture days, as ``blocking.pool_days`` counts them, by how many orders they give."""
    by = Window.partitionBy("settlement_id").orderBy(F.desc("n"), "captured_on")  # days of one pool: a few
    return days.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most).select("settlement_id", "place", "captured_on", "n")


def nearest_rank(sizes: DataFrame, value: str, shares: tuple[float, ...]) -> DataFrame:
    """(share, value): percentiles by nearest rank, from counts of equal values."""
    counts = sizes.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    upto = counts.select("value", F.sum("n").over(Window.orderBy("value")).alias("upto"))  # a row for each different value
    total = sizes.agg(F.count("*").alias("total"))
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    asked = total.where("total > 0").select("total", wanted.alias("share")).withColumn("rank", F.floor(F.col("share") * (F.col("total") - 1) + 0.5).cast("long"))
    return upto.join(F.broadcast(asked), F.col("upto") > F.col("rank")).groupBy("share").agg(F.min("value").alias("value"))  # asked: one row for each share


def size_histogram(parts: DataFrame) -> DataFrame:
    """(bucket, components) of components by how many payouts they join."""
    n = F.col("n")
    bucket = F.when(n == 1, "1").when(n == 2, "2").when(n <= 5, "3-5").when(n <= 10, "6-10").when(n <= 50, "11-50").when(n <= 200, "51-200").otherwise("200+")
    return parts.groupBy("component").agg(F.count("*").alias("n")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("components"))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds rank within the period, in the given order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("period_id").orderBy(*order)))


def recommended(scenarios: DataFrame) -> DataFrame:
    """(period_id, scenario): the baseline if it closes; else the least intrusive scenario that does;
    else the one with least at stake."""
    place = F.create_map(*[F.lit(x) for pair in zip(("BASELINE", "CLEAR_POLICY_BLOCKS", "RESOLVE_AMBIGUOUS", "RESOLVE_HIGH", "RESOLVE_ALL"), range(5), strict=True) for x in pair])[F.col("scenario")]
    closes = F.col("verdict") != "BLOCKED"
    key = F.struct(F.when(closes, 0).otherwise(1).alias("open"), F.when(closes, place).otherwise(0).alias("place"), F.when(closes, 0).otherwise(F.col("material_exposure_paise")).alias("stake"), F.col("net_unresolved_paise").alias("left"), place.alias("tie"))
    return scenarios.groupBy("period_id").agg(F.min_by("scenario", key).alias("scenario"), F.max(closes).alias("closeable"))


def checksums(payouts: DataFrame) -> DataFrame:
    """(period_id, checksum): SHA-256 over the days' SHA-256 over rows in order of id; groups are days, then a month's days."""
    rows = payouts.select(F.date_format("settled_on", "yyyy-MM").alias("period_id"), "settled_on", F.concat_ws("|", "settlement_id", F.col("net_paise").cast("string"), F.coalesce("utr", F.lit("-"))).alias("row"))
    days = rows.groupBy("period_id", "settled_on").agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("row"))), 256).alias("day"))
    return days.groupBy("period_id").agg(F.sort_array(F.collect_list(F.struct("settled_on", "day"))).alias("days")).select("period_id", F.sha2(F.concat_ws("\n", F.transform("days", lambda d: d.day)), 256).alias("checksum"))


def policy_simulation(judged: DataFrame, wrong: DataFrame) -> DataFrame:
    """One row: what is posted and protected, expected and realised loss. ``wrong`` has the settlement_ids of false proofs."""
    own = judged.join(wrong.select("settlement_id").distinct().withColumn("is_wrong", F.lit(True)), "settlement_id", "left")
    posts, bad = F.col("decision") == "AUTO_POST", F.coalesce("is_wrong", F.lit(False))
    cost = F.lit(250_000) + money.floor_div(F.col("net_paise") * 3_000, 10_000)

    def total(condition: Column, what: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, what)), F.lit(0)).cast("long")

    return own.agg(
        F.count_if(posts).alias("posted"), F.count_if(F.col("decision") == "REVIEW").alias("reviewed"), F.count_if(F.col("decision") == "BLOCK").alias("blocked"), total(posts, F.col("net_paise")).alias("posted_paise"),
        total(~posts & bad, F.col("net_paise")).alias("protected_paise"), total(posts, F.col("expected_loss")).alias("expected_loss"), total(posts & bad, cost).alias("realised_loss"),
    )


def landscape(space: DataFrame) -> DataFrame:
    """(reduction, deterministic, payouts, removed): what each reduction took from all search spaces."""
    rows = F.array(*[F.struct(F.lit(name).alias("reduction"), F.lit(sure).alias("deterministic"), F.col(c).alias("removed")) for name, sure, c in (("date_window", False, "removed_by_date"), ("amount_ceiling", True, "removed_by_amount"))])
    return space.select(F.inline(rows)).groupBy("reduction", "deterministic").agg(F.count_if(F.col("removed") > 0).alias("payouts"), F.sum("removed").alias("removed"))


def gates(judged: DataFrame, postable: DataFrame) -> DataFrame:
    """(settlement_id, gate_no, gate, passed) of every payout: the gates between a finding and its posting."""
    own = judged.join(postable.select("settlement_id", "postable"), "settlement_id")

    def gate(no: int, name: str, passed: Column) -> Column:
        return F.struct(F.lit(no).alias("gate_no"), F.lit(name).alias("gate"), F.coalesce(passed, F.lit(False)).alias("passed"))

    rows = F.array(
        gate(1, "proven", F.col("verdict") == "PROVEN"), gate(2, "postable", F.col("postable")), gate(3, "measured", F.col("p_error").isNotNull()),
        gate(4, "under the ceiling", F.col("net_paise") <= 10_000_000), gate(5, "cheaper than review", F.col("expected_loss") < 25_000),
    )
    return own.select("settlement_id", F.inline(rows))


def reason_shapes(rows: DataFrame, reason: str, amount: str, key: str) -> DataFrame:
    """(shape, n, amount_paise, largest): texts grouped by what is left without amounts and asides."""
    shape = F.trim(F.regexp_replace(F.regexp_replace(F.split(F.col(reason), "[—;]")[0], r"[₹\d,.]+", ""), r"\s+", " "))
    top = F.min(F.struct((-F.col(amount)).alias("minus"), F.col(key).alias("key")))
    return rows.groupBy(shape.alias("shape")).agg(F.count("*").alias("n"), F.sum(amount).alias("amount_paise"), top.alias("top")).select("shape", "n", "amount_paise", F.col("top.key").alias("largest"))
