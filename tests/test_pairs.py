"""Pairs and small explanations against the pools themselves, and what they shuffle."""

from __future__ import annotations

import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from tallymark.operators import blocking, cascade, evidence, matching

ORDERS = "order_id string, captured_on date, net_paise long, gross_paise long, method string"
PAYOUTS = "settlement_id string, settled_on date, net_paise long"


def _tables(spark):
    draw = random.Random(11)
    monday = dt.date(2024, 3, 4)
    orders = [(f"o{i % 290}", None if i % 31 == 0 else monday + dt.timedelta(draw.randrange(7)), draw.choice([None, -3, 0, 1, 2, 3, 60, 61, 127, 128, 254, 255, 256, 5_000, 2**40]), i, "upi") for i in range(300)]
    payouts = [(None if i == 5 else f"s{i}", None if i == 3 else monday + dt.timedelta(draw.randrange(12)), draw.choice([None, -1, 0, 1, 2, 3, 4, 120, 121, 255, 256, 257, 510, 10_001, 2**41])) for i in range(60)]
    return spark.createDataFrame(payouts, PAYOUTS), spark.createDataFrame(orders, ORDERS)


def _pools(payouts, orders):
    rows = {}
    for r in blocking.pools(payouts, orders).where("settlement_id is not null").collect():
        rows.setdefault((r.settlement_id, r.credit_paise), []).append(r)
    return rows


def _pairs(rows, credit):
    return [(a, b) for a, b in itertools.permutations(rows, 2) if a.order_id < b.order_id and 0 <= credit - a.net_paise - b.net_paise <= 2]


def test_pairs_are_those_of_the_pools(spark):
    payouts, orders = _tables(spark)
    want = sorted((s, a.order_id, b.order_id, c - a.net_paise - b.net_paise) for (s, c), rows in _pools(payouts, orders).items() for a, b in _pairs(rows, c))
    got = sorted(map(tuple, matching.pair_subsets(payouts, orders).select("settlement_id", "first_order", "second_order", "residual").collect()))
    assert len(want) > 100 and got == want


def test_small_explanations_hold_each_order_once(spark):
    # one id may stand in several rows: each pair of rows is explained by its own amounts
    payouts, orders = _tables(spark)
    want = []
    for (s, c), rows in _pools(payouts, orders).items():
        alone = {r.order_id for r in rows if c - r.net_paise <= 1}
        want += [(s, r.order_id, r.order_id, r.net_paise, r.gross_paise, 1) for r in rows if c - r.net_paise <= 1]
        want += [(s, f"{a.order_id} {b.order_id}", x.order_id, x.net_paise, x.gross_paise, 2) for a, b in _pairs([r for r in rows if r.order_id not in alone], c) for x in (a, b)]
    got = evidence.small_explanations(payouts.where("settlement_id is not null"), orders)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_pairs_shuffle_no_pool(spark):
    # 40 payouts of a day that holds 20,000 orders, none near half of a credit: 800,000 rows of pools
    orders = spark.range(20_000).selectExpr("concat('o', id) as order_id", "date'2024-03-04' as captured_on", "id % 900 + 1 as net_paise", "1L as gross_paise")
    payouts = spark.range(40).selectExpr("concat('s', id) as settlement_id", "date'2024-03-06' as settled_on", "1000000 + id as net_paise")
    store = spark.sparkContext._jsc.sc().statusStore()

    def written() -> int:
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    assert matching.pair_subsets(payouts, orders).agg(F.count("*")).first()[0] == 0
    assert written() - before < 60_000


def test_days_are_those_of_the_pools(spark):
    payouts, orders = _tables(spark)
    for lags in ((2,), (2, 3, 4)):
        want = blocking.pools(payouts, orders, lags).groupBy("settlement_id", "captured_on").agg(F.count("*").alias("n"))
        key = lambda r: (r[0] or "", r[1], r[2])
        assert sorted(map(tuple, blocking.pool_days(payouts, orders, lags).collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_held_rows_are_those_of_the_pools(spark):
    payouts, orders = _tables(spark)
    pool = blocking.pools(payouts, orders).where("settlement_id is not null").select("settlement_id", "order_id").distinct()
    cited = payouts.where("settlement_id is not null").select("settlement_id").crossJoin(orders.select("order_id").distinct())
    assert sorted(map(tuple, blocking.held(cited, payouts, orders).select("settlement_id", "order_id").distinct().collect())) == sorted(map(tuple, pool.collect()))


def test_fills_are_folds_of_the_pools(spark):
    payouts, orders = _tables(spark)
    want = {(r.settlement_id, r.filled_paise, r.n_orders) for r in matching.baseline_greedy(blocking.pools(payouts, orders)).collect()}
    assert {(r.settlement_id, r.filled_paise, r.n_orders) for r in matching.greedy_fills(payouts, orders).collect()} == want


def test_lanes_are_those_of_the_pools(spark):
    payouts, orders = _tables(spark)
    orders = orders.withColumn("order_id", F.concat("order_id", F.lit("-"), F.col("gross_paise").cast("string")))  # rows of one id and amount tie
    payouts = payouts.where("settlement_id is not null")
    for most in (3, 18):
        assert sorted(map(tuple, evidence.pool_lanes(payouts, orders, most).collect())) == sorted(map(tuple, evidence.lanes(blocking.pools(payouts, orders), most).collect()))


def test_conflicts_are_those_of_the_pools(spark):
    payouts, orders = _tables(spark)
    want = blocking.pools(payouts, orders).groupBy("order_id").agg(F.min("settlement_id"), F.max("settlement_id"), F.count("*").alias("n")).where("n > 1")
    assert sorted(map(tuple, matching.conflicts(payouts, orders).collect())) == sorted(map(tuple, want.collect()))


def test_members_inside_are_those_of_the_pools(spark):
    payouts, orders = _tables(spark)
    pool = {(r.settlement_id, r.order_id) for r in blocking.pools(payouts, orders).collect()}
    members = orders.select(F.when(F.col("gross_paise") % 17 > 0, F.concat(F.lit("s"), (F.col("gross_paise") % 60).cast("string"))).alias("settlement_id"), "order_id").union(orders.select(F.lit("s9"), "order_id"))
    got = {(r.settlement_id, r.order_id): r.inside for r in blocking.membership(members, payouts, orders).collect()}
    assert got == {k: k[0] is not None and k in pool for k in set(map(tuple, members.collect()))}


def test_the_cascade_shuffles_only_orders_that_a_payout_of_their_day_may_hold(spark):
    orders = spark.range(20_000).selectExpr("concat('o', id) as order_id", "date'2024-03-04' as captured_on", "id + 100 as net_paise")
    payouts = spark.createDataFrame([("a", dt.date(2024, 3, 6), 109), ("b", dt.date(2024, 3, 20), 10**6)], PAYOUTS)
    store, at = spark.sparkContext._jsc.sc().statusStore(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def written() -> int:
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        assert cascade._meets(payouts, orders, cascade.LADDER).count() == 10
        assert written() - before < 1_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", at)


def test_small_explanations_shuffle_only_orders_near_what_their_day_asks_for(spark):
    # 20,000 orders of a day whose payouts lie far above them, and two that make up another day's
    orders = spark.range(20_000).selectExpr("concat('o', id) as order_id", "date'2024-03-04' as captured_on", "id % 900 + 1 as net_paise", "1L as gross_paise", "'upi' as method")
    orders = orders.unionByName(spark.createDataFrame([("x", dt.date(2024, 3, 11), 60, 60, "upi"), ("y", dt.date(2024, 3, 11), 40, 40, "upi")], ORDERS))
    payouts = spark.range(40).selectExpr("concat('s', id) as settlement_id", "date'2024-03-06' as settled_on", "1000000 + id as net_paise")
    payouts = payouts.unionByName(spark.createDataFrame([("t", dt.date(2024, 3, 13), 100), (None, None, 5), ("u", None, None)], PAYOUTS))
    store, at = spark.sparkContext._jsc.sc().statusStore(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def written() -> int:
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        got = sorted(map(tuple, evidence.small_explanations(payouts, orders).collect()))
        assert got == [("t", "x y", "x", 60, 60, 2), ("t", "x y", "y", 40, 40, 2)]
        cited = spark.createDataFrame([("t", "x"), ("t", "o1")], "settlement_id string, order_id string")
        assert [tuple(r)[:2] for r in blocking.held(cited, payouts, orders).collect()] == [("t", "x")]
        assert blocking.pools(payouts.where("settlement_id = 't'"), orders).count() == 2
        assert written() - before < 2_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", at)
