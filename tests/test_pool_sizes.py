"""Sizes and single fits of pools against the pools themselves."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tallymark.operators import blocking

ORDERS = "order_id string, captured_on date, net_paise long, gross_paise long, method string"
PAYOUTS = "settlement_id string, settled_on date, net_paise long"


def _tables(spark):
    draw = random.Random(7)
    monday = dt.date(2024, 3, 4)
    amounts = [-5, 0, 1, 2, 3, 127, 128, 129, 1_000, 1_023, 1_024, 1_025, 1_218, 1_219, 99_999, 2**40, None]
    orders = [(f"o{i}", None if i % 29 == 0 else monday + dt.timedelta(draw.randrange(9)), draw.choice(amounts), 1, "upi") for i in range(400)]
    payouts = [(f"s{i}", None if i == 3 else monday + dt.timedelta(draw.randrange(16)), draw.choice(amounts)) for i in range(60)]
    return spark.createDataFrame(payouts, PAYOUTS), spark.createDataFrame(orders, ORDERS)


def test_sizes_are_those_of_the_pools(spark):
    payouts, orders = _tables(spark)
    for lags in ((2,), (2, 3, 4)):
        met = blocking.pools(payouts, orders, lags).groupBy("settlement_id").agg(F.count("*").alias("n"), F.sum("net_paise").alias("net"))
        sizes = blocking.pool_sizes(payouts, orders, lags)
        assert {tuple(r) for r in sizes.where("candidates > 0").select("settlement_id", "candidates", "pool_net").collect()} == {tuple(r) for r in met.collect()}
        days = blocking.dated(orders, lags).groupBy("pool_day").agg(F.count("*").alias("n"))
        window = payouts.join(days, payouts["settled_on"] == days["pool_day"]).select("settlement_id", "n")
        assert {tuple(r) for r in sizes.select("settlement_id", "in_window").collect()} == {tuple(r) for r in window.collect()}


def test_fits_are_rows_of_the_pools(spark):
    payouts, orders = _tables(spark)
    for slack in (0, 1, 2):
        want = blocking.pools(payouts, orders).where(F.col("credit_paise") - F.col("net_paise") <= slack).select("settlement_id", "order_id")
        assert sorted(map(tuple, blocking.credit_fits(payouts, orders, slack=slack).select("settlement_id", "order_id").collect())) == sorted(map(tuple, want.collect()))


def test_an_order_stands_once_on_each_day(spark):
    day = dt.date(2024, 3, 8)  # a Friday
    orders = spark.createDataFrame([("a", day, 5, 5, "upi"), ("b", None, 5, 5, "upi")], ORDERS)
    got = sorted((r.order_id, r.pool_day) for r in blocking.dated(orders, (2, 2, 3)).collect())
    assert got == [("a", dt.date(2024, 3, 12)), ("a", dt.date(2024, 3, 13))]


def test_bands_never_fall(spark):
    rows = spark.range(1, 5000).select("id", blocking.band(F.col("id")).alias("b")).orderBy("id").collect()
    assert all(x.b <= y.b for x, y in zip(rows, rows[1:], strict=False))
