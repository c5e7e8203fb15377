"""The cascade's rounds against a loop over payouts, one after the other."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest

from tallymark.operators import cascade, solver

PAYOUTS = "settlement_id string, settled_on date, net_paise long"
ORDERS = "order_id string, captured_on date, net_paise long, gross_paise long, method string"


def business_days_after(day, n):
    while n:
        day += timedelta(1)
        n -= day.weekday() < 5
    return day


def pool_of(payout, orders, lags, taken=frozenset()):
    sid, settled, credit = payout
    days = [o for o in orders if settled in {business_days_after(o[1], n) for n in lags}]
    return sorted((o for o in days if o[0] not in taken and 0 < o[2] <= credit), key=lambda o: (-o[2], o[0]))


def one_by_one(payouts, orders):
    taken, out = set(), {}
    for p in sorted(payouts, key=lambda p: (len(pool_of(p, orders, cascade.LADDER[0])), p[0])):
        got = None
        for r, lags in enumerate(cascade.LADDER):
            pool = pool_of(p, orders, lags, taken)
            fits = [o for o in pool if abs(o[2] - p[2]) <= 1]
            if len(fits) == 1:
                got = ("PROVEN", f"L2-single/r{r}", [[fits[0][0]]], True, None, None)
                break
            if p[2] > solver.MAX_TARGET or len(pool) > solver.MAX_POOL:
                got = ("INSUFFICIENT", f"L3-skipped/r{r}", [], False, None, None)
                break
            a = solver.answer([o[2] for o in pool], p[2])
            if a.verdict != "CONTRADICTED":
                got = (a.verdict, f"L3-dp/r{r}", [sorted(pool[i][0] for i in e) for e in a.found], a.exhaustive, a.density, a.unique_share)
                break
            got = ("CONTRADICTED", "L3-dp/exhausted", [], True, a.density, a.unique_share)
        out[p[0]] = got
        if got[0] == "PROVEN":
            taken |= set(got[2][0])
    return out


def portfolio(seed):
    """Days of few orders with few amounts, so that payouts fight over them."""
    rng = random.Random(seed)
    start = date(2026, 5, 4)
    orders = [(f"o{i:03d}", start + timedelta(rng.randrange(9)), rng.choice([100, 100, 150, 250, 400, 655, rng.randint(90, 900)])) for i in range(60)]
    payouts = []
    for k in range(40):
        day = rng.choice(orders)[1]
        own = [o for o in orders if o[1] == day]
        part = rng.sample(own, min(len(own), rng.randint(1, 4)))
        payouts.append((f"s{k:02d}", business_days_after(day, rng.choice([2, 2, 2, 3, 4])), sum(o[2] for o in part) + rng.choice([0, 0, 1, 1, 37])))
    return payouts, orders


@pytest.mark.parametrize(("seed", "most_pool"), [(1, 900), (2, 900), (3, 900), (4, 9), (5, 6)])
def test_rounds_end_where_the_loop_ends(spark, monkeypatch, seed, most_pool):
    """With small pools allowed some payouts are refused until others have taken their orders."""
    monkeypatch.setattr(solver, "MAX_POOL", most_pool)
    payouts, orders = portfolio(seed)
    want = one_by_one(payouts, orders)
    got = cascade.cascade(spark.createDataFrame(payouts, PAYOUTS), spark.createDataFrame([(*o, o[2], "upi") for o in orders], ORDERS)).collect()
    assert len(got) == len(payouts)
    assert {r.settlement_id: (r.verdict, r.layer, r.explanations, r.exhaustive, r.density, r.unique_share) for r in got} == want
    used = [o for r in got if r.verdict == "PROVEN" for o in r.order_ids]
    assert used and len(used) == len(set(used))


def test_candidates_without_consumption(spark):
    payouts, orders = portfolio(6)
    rows = cascade.candidates(spark.createDataFrame(payouts, PAYOUTS), spark.createDataFrame([(*o, o[2], "upi") for o in orders], ORDERS)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.no):
        got.setdefault(r.settlement_id, []).append(r.order_ids)
    for p in payouts:
        want = []
        for lags in cascade.LADDER:
            pool = pool_of(p, orders, lags)
            fits = [[o[0]] for o in pool if abs(o[2] - p[2]) <= 1]
            want = fits if len(fits) == 1 else []
            want += [e for e in (sorted(pool[i][0] for i in x) for x in solver.answer([o[2] for o in pool], p[2]).found) if e not in want]
            if want:
                break
        assert got.get(p[0], []) == want


def test_empty_and_null(spark):
    no_orders = spark.createDataFrame([], ORDERS)
    assert cascade.cascade(spark.createDataFrame([], PAYOUTS), no_orders).count() == 0
    rows = cascade.cascade(spark.createDataFrame([("a", None, 5), ("b", date(2026, 5, 6), None), ("c", date(2026, 5, 6), 7)], PAYOUTS), no_orders).collect()
    assert {(r.settlement_id, r.verdict, tuple(r.order_ids)) for r in rows} == {("a", "CONTRADICTED", ()), ("b", "CONTRADICTED", ()), ("c", "CONTRADICTED", ())}
