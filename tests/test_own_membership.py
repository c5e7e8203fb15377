"""Orders in the payout they are said to be of: row by row, against the join of members with orders."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest

import __spark_entry__
from tallymark.operators import blocking

TOLD = "settlement_id string, order_id string, captured_on date, net_paise long"
PAYOUTS = "settlement_id string, settled_on date, net_paise long"


@pytest.mark.parametrize("ids", [5_000, 60])
@pytest.mark.parametrize("most", [blocking.MOST_REPEATED, 3])
def test_as_by_join(spark, monkeypatch, ids, most):
    monkeypatch.setattr(blocking, "MOST_REPEATED", most)
    draw, monday = random.Random(ids), dt.date(2024, 3, 4)
    told = [
        (draw.choice([None, *[f"s{k}" for k in range(12)]]), f"o{draw.randrange(ids)}", None if i % 17 == 0 else monday + dt.timedelta(draw.randrange(4)), draw.choice([None, -5, 0, 1, 50, 99, 100, 101]))
        for i in range(300)
    ]
    payouts = [(f"s{k}", None if k == 3 else monday + dt.timedelta(2 + draw.randrange(4)), draw.choice([None, 0, 50, 100, 100])) for k in range(10)] + [("s1", monday + dt.timedelta(3), 100), (None, monday, 100)]
    told, payouts = spark.createDataFrame(told, TOLD), spark.createDataFrame(payouts, PAYOUTS)
    for lags in ((2,), (2, 3)):
        want = blocking.membership(told, payouts, told, lags)
        got = blocking.own_membership(told, payouts, lags)
        assert got.dtypes == want.dtypes
        rows = sorted(map(repr, got.collect()))
        assert rows == sorted(map(repr, want.collect()))
        assert any("inside=True" in r for r in rows) and any("inside=False" in r for r in rows)


def test_ids_are_not_shuffled(spark):
    made = __spark_entry__.queries()["blocking_recall"](spark, "/root/testdata/sf0.001")
    assert not re.search(r"hashpartitioning\([^)]*order_id#", made._jdf.queryExecution().executedPlan().toString())
