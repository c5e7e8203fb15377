"""The loop over hypotheses against one payout after the other."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallymark.operators import hypothesis


def portfolio(seed):
    """Payouts with pools over a few days and explanations that share orders; some explanations miss the credit."""
    rng = random.Random(seed)
    findings, explained, pool, payouts, orders = [], [], [], [], {}
    for k in range(30):
        sid = f"s{k:02d}"
        own = [(f"o{k:02d}{i:02d}", date(2026, 5, 4) + timedelta(rng.randrange(6))) for i in range(rng.randint(1, 16))]
        for o, _ in own:
            orders[o] = rng.randint(100, 120)
        sets = []
        for _ in range(rng.randint(0, 4)):
            day = rng.choice(own)[1]
            batch = sorted(o for o, d in own if d == day)
            sets.append(frozenset(rng.sample([o for o, _ in own], min(len(own), rng.randint(1, 4)))) | frozenset(batch[: rng.choice([0, 2, 3, 3])]))
        sets = sorted(set(sets), key=sorted)
        credit = sum(orders[o] for o in sets[0]) if sets else 500
        findings.append((sid, "AMBIGUOUS" if len(sets) > 1 else rng.choice(["PROVEN", "CONTRADICTED"])))
        explained += [(sid, f"e{j}", o) for j, s in enumerate(sets) for o in s]
        pool += [(sid, o, d) for o, d in own]
        payouts.append((sid, credit + rng.choice([0, 0, 0, 1, 40])))
    return findings, explained, pool, payouts, orders


def by_batches(candidates):
    def propose(rejected, tried):
        if rejected:
            return []
        days = {}
        for o, d in candidates:
            days.setdefault(d, []).append(o)
        out = []
        for d in sorted(days, key=lambda d: (-len(days[d]), d)):
            anchor = sorted(days[d])[:3]
            if len(days[d]) > 1 and anchor not in tried and len(out) < 2:
                out.append((anchor, "capture-batch"))
        return out

    return propose


def by_list(hypotheses):
    """A proposer that repeats itself: the same list each round."""
    return lambda rejected, tried: hypotheses


def one_by_one(portfolio, proposers, rounds):
    findings, explained, pool, payouts, orders = portfolio
    outcomes, trail = [], []
    for sid, verdict in findings:
        say = lambda r, no, step, actor, act, why="", lens="": trail.append((sid, r, no, step, actor, act, why, lens))  # noqa: B023,E731
        if verdict != "AMBIGUOUS":
            say(0, 0, 0, "engine", "skip", verdict)
            outcomes.append((sid, verdict, None, None))
            continue
        sets, credit, done = {}, dict(payouts)[sid], None
        for s, e, o in explained:
            if s == sid:
                sets.setdefault(e, set()).add(o)
        mine, rejected, tried = {o for s, o, _ in pool if s == sid}, [], []
        for r in range(1, rounds + 1):
            offered = proposers[sid](rejected, tried)
            fresh = [(no, a, lens) for no, (a, lens) in enumerate(offered, 1) if a not in tried]
            if not fresh:
                say(r, 0, 0, "model", "exhausted")
                break
            refused = []
            for no, anchor, lens in fresh:
                say(r, no, 1, "model", "propose", "", lens)
                fits = [e for e in sorted(sets) if set(anchor) <= sets[e]]
                ghosts = sorted({o for o in anchor if o not in mine})
                why = "existence" if ghosts else "consistency" if not fits else "uniqueness" if len(fits) > 1 else ""
                if not why and abs(credit - sum(orders[o] for o in sets[fits[0]])) > len(sets[fits[0]]):
                    why = "kernel"
                if not why:
                    say(r, no, 2, "solver", "accept", "", lens)
                    say(r, no, 3, "kernel", "verify", "", lens)
                    done = (lens, fits[0])
                    break
                say(r, no, 2, "solver", "refute", why, lens)
                refused = ghosts if why == "existence" else sorted(set(anchor)) if why == "consistency" else []
            if done:
                break
            rejected, tried = rejected + refused, tried + [a for a, _ in offered]
        if not done:
            say(rounds + 1, 0, 0, "engine", "abstain")
        outcomes.append((sid, "PROVEN" if done else verdict, *(done or (None, None))))
    return sorted(outcomes), sorted(trail)


def tables(spark, portfolio):
    findings, explained, pool, payouts, orders = portfolio
    make = spark.createDataFrame
    return (
        make(findings, "settlement_id string, verdict string"), make(explained, "settlement_id string, explanation string, order_id string"), make(pool, "settlement_id string, order_id string, captured_on date"),
        make(payouts, "settlement_id string, net_paise long"), make([(o, n, n) for o, n in orders.items()], "order_id string, gross_paise long, net_paise long"),
    )


def result(spark, own, propose, rounds):
    outcomes, trail = hypothesis.investigate(*own, propose, rounds)
    return sorted(map(tuple, outcomes.collect())), sorted(map(tuple, trail.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_against_one_by_one(spark, seed):
    case = portfolio(seed)
    own = tables(spark, case)
    want = one_by_one(case, {s: by_batches([(o, d) for t, o, d in case[2] if t == s]) for s, _ in case[0]}, 3)
    assert result(spark, own, hypothesis.capture_batches(own[2]), 3) == want
    assert {"accept", "refute", "exhausted", "abstain", "skip"} <= {e[5] for e in want[1]}


def test_any_proposer_against_one_by_one(spark):
    """Anchors that don't exist, are empty, hold an order twice, or are offered again and again."""
    case = portfolio(3)
    rng = random.Random(9)
    offered = {}
    for sid, _ in case[0]:
        mine = [o for s, o, _ in case[2] if s == sid]
        offered[sid] = [(rng.choice([[], ["ghost", mine[0]], [mine[0]] * 2, rng.sample(mine, min(2, len(mine)))]), f"lens{k}") for k in range(rng.randint(0, 4))]
    rows = spark.createDataFrame([(s, no, a, lens) for s, own in offered.items() for no, (a, lens) in enumerate(own, 1)], "settlement_id string, no int, anchor array<string>, lens string")
    want = one_by_one(case, {s: by_list(own) for s, own in offered.items()}, 3)
    got = result(spark, tables(spark, case), lambda state: rows.join(state.select("settlement_id"), "settlement_id"), 3)
    assert got == want
    assert {"existence", "uniqueness", "consistency"} <= {e[6] for e in want[1]}


def test_the_proposer_sees_no_amount_but_what_was_rejected(spark):
    case = portfolio(2)
    own, seen = tables(spark, case), []
    batches = hypothesis.capture_batches(own[2])

    def propose(state):
        seen.append((state.columns, {r.settlement_id: (r.rejected, r.tried) for r in state.collect()}))
        return batches(state)

    result(spark, own, propose, 2)
    assert all(columns == ["settlement_id", "rejected", "tried", "unexplained"] for columns, _ in seen)
    assert all(r == [] and t == [] for r, t in seen[0][1].values()) and any(t for _, t in seen[1][1].values())


def test_empty(spark):
    own = [d.limit(0) for d in tables(spark, portfolio(1))]
    assert result(spark, own, hypothesis.capture_batches(own[2].where(F.lit(True))), 1) == ([], [])
