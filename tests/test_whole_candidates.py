"""All explanations of every payout, whatever the pool and the credit."""

from __future__ import annotations

import math
import random
from datetime import date, datetime

import pytest
from test_cascade_order import ORDERS, PAYOUTS, pool_of, portfolio

from tallymark.operators import cascade, solver
from tallymark.plans import registry

MONDAY, WEDNESDAY = date(2026, 5, 4), date(2026, 5, 6)


def frames(spark, payouts, orders):
    return spark.createDataFrame(payouts, PAYOUTS), spark.createDataFrame([(*o, o[2], "upi") for o in orders], ORDERS)


def by_payout(rows):
    got = {}
    for r in sorted(rows, key=lambda r: r.no):
        assert r.no == len(got.setdefault(r.settlement_id, []))
        got[r.settlement_id].append(r.order_ids)
    return got


def reached(nets):
    sums = {0}
    for n in nets:
        sums |= {s + n for s in sums}
    return sums


@pytest.mark.parametrize("held", [solver.HELD_BYTES, 40, 0])
def test_sums_against_every_subset(held):
    rng = random.Random(5)
    cases = [[1] * 30, [2] * 9 + [9], [5, 5, 5, 5, 400, 400, 401], [1, 2, 3, 4, 5, 6, 7, 8, 900, 901, 5_000], [1_000 * k for k in range(1, 12)], [*range(3, 40), 3_000]]
    cases += [sorted(rng.randint(1, rng.choice([4, 40, 900])) for _ in range(rng.randint(1, 16))) for _ in range(60)]
    for nets in cases:
        for limit in (sum(nets) + 5, sum(nets) // 2, max(nets)):
            sums = solver.Sums(nets, limit, held)
            for i in {rng.randint(0, len(nets)) for _ in range(8)} | {len(nets)}:
                want = reached(nets[:i])
                for _ in range(25):
                    low = rng.randint(0, limit)
                    high = rng.choice([low, min(limit, low + rng.randint(0, 30))])
                    assert sums.within(i, low, high) == any(low <= s <= high for s in want), (nets, limit, i, low, high)


def test_sums_fill_up_in_little_space():
    rng = random.Random(2)
    sums = solver.Sums(sorted(rng.randint(900, 105_000) for _ in range(20_000)), 60_000_000)
    assert len(sums.changes) < 1_000 and sum(len(b) for b, _ in sums.marks.values()) < 20e6
    assert sums.within(20_000, 59_999_999, 59_999_999) and not sums.within(20_000, 1, 899)


def test_all_explanations_are_listed(spark):
    payouts, orders = portfolio(6)
    got = by_payout(rows := cascade.candidates(*frames(spark, payouts, orders), listed=None).collect())
    assert all(r.exhaustive for r in rows) and max(map(len, got.values())) == 14_603
    for p in payouts:
        want = []
        for lags in cascade.LADDER:
            pool = pool_of(p, orders, lags)
            want = [sorted(pool[i][0] for i in e) for e in solver.answer([o[2] for o in pool], p[2], listed=1_000_000).found]
            if want:
                break
        assert got.get(p[0], []) == want


def test_the_query_lists_all(spark, tmp_path):
    day = datetime(1995, 3, 6)
    lines = [(k, 1, k, k % 8, 400.0, "N", day) for k in range(16)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_returnflag string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = registry.queries()["cascade_candidates"](spark, str(tmp_path)).collect()
    listed = {}
    for r in rows:
        listed.setdefault(r.settlement_id, []).append(r.order_ids)
    assert max(map(len, listed.values())) > 4
    assert all(len(set(e)) == len(e) for e in listed.values()) and all(r.exhaustive for r in rows)


def test_no_pool_and_no_credit_is_too_large(spark):
    n, dear = solver.MAX_POOL + 50, solver.MAX_TARGET + 7
    orders = [(f"o{k:04d}", MONDAY, 10_000) for k in range(n)] + [("small", MONDAY, 3_000), ("dear", MONDAY, dear)]
    payouts = [("many", WEDNESDAY, 13_000), ("dear", WEDNESDAY, dear), ("one", WEDNESDAY, 3_000), ("none", WEDNESDAY, 7_000)]
    got = by_payout(cascade.candidates(*frames(spark, [p for p in payouts if p[0] != "dear"], orders), listed=None).collect())
    assert got == {"many": [[f"o{k:04d}", "small"] for k in range(n)], "one": [["small"]]}
    rows = cascade.candidates(*frames(spark, payouts, orders)).where("settlement_id = 'dear'").collect()
    assert [r.order_ids for r in rows][0] == ["dear"]
    assert {(r.settlement_id, r.exhaustive) for r in rows} == {("dear", True)}


def test_tolerance_grows_with_the_explanation(spark):
    """100 orders may miss by 100 paise, also by more than the solver's band."""
    orders = [(f"o{k:03d}", MONDAY, 1_000) for k in range(100)]
    rows = cascade.candidates(*frames(spark, [("s", WEDNESDAY, 100_090), ("t", WEDNESDAY, 100_101)], orders), listed=None).collect()
    assert [(r.settlement_id, len(r.order_ids)) for r in rows] == [("s", 100)]


def test_rows_come_while_the_search_goes_on(spark):
    orders = [(f"o{k:02d}", MONDAY, 500) for k in range(60)]
    assert math.comb(60, 30) > 10**17
    rows = cascade.candidates(*frames(spark, [("s", WEDNESDAY, 15_000)], orders), listed=None).limit(3).collect()
    assert [r.no for r in rows] == [0, 1, 2] and all(len(set(r.order_ids)) == 30 for r in rows)


def test_orders_that_the_kernel_does_not_find_once(spark):
    rows = [("a", MONDAY, 100, 100, "upi"), ("b", MONDAY, 100, None, "upi"), ("c", MONDAY, 100, 100, "upi"), ("c", date(2024, 1, 1), 5, 5, "upi"), (None, MONDAY, 100, 100, "upi")]
    got = cascade.candidates(spark.createDataFrame([("s", WEDNESDAY, 100), ("u", None, 100), ("v", WEDNESDAY, None)], PAYOUTS), spark.createDataFrame(rows, ORDERS), listed=None).collect()
    assert [(r.settlement_id, r.no, r.order_ids) for r in got] == [("s", 0, ["a"])]
