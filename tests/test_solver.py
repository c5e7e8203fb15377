"""The subset solver against every subset, with bit sets held and with marks only."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import pytest

from tallymark.operators import solver


def walked(nets, target, listed):
    """Explanations in the order of a plain search without any cut but the orders' end."""
    usable = sorted((i for i, n in enumerate(nets) if 0 < n <= target), key=lambda i: (-nets[i], i))
    out = []

    def go(at, left, chosen):
        if len(out) > listed:
            return
        if chosen and 0 <= left <= len(chosen):
            out.append(tuple(chosen))
            return
        if at == len(usable) or left < 0:
            return
        go(at + 1, left - nets[usable[at]], [*chosen, usable[at]])
        go(at + 1, left, chosen)

    go(0, target, [])
    return out


def ways(nets, target):
    """How many subsets reach each sum up to the target."""
    sums = Counter({0: 1})
    for n in nets:
        if n > 0:
            sums.update({s + n: c for s, c in list(sums.items()) if s + n <= target})
    return sums


def edges():
    yield from (([], 5), ([3], -1), ([5], 0), ([0, 0], 3), ([-4, 4], 4), ([7], 6), ([5], 6), ([5], 5), ([4], 6), ([1] * 12, 6), ([2] * 9, 7), ([2] * 9, 19))
    yield from (([10, 10, 10], 20), ([1, 2, 4, 8, 16, 32], 63), ([1, 2, 4, 8, 16, 32], 62), ([100] * 10, 350), ([100] * 10, 302), ([6, 6, 5, 5], 11), ([9, 1, 1, 1], 12), ([3, 3, 3], 11))
    yield from (([50, 49, 48, 2, 1], 51), ([1], 1), ([2], 1), ([20_000_001, 5], 5), ([8, 8, 8, 8], 35), ([13] * 5 + [7] * 5, 60), ([1, 1, 2, 3, 5, 8, 13], 20))


def instances():
    yield from edges()
    rng = random.Random(17)
    for k in range(1_000):
        top = rng.choice([6, 30, 200, 3_000])
        nets = [rng.randint(1, top) for _ in range(rng.randint(1, 11))]
        yield nets, rng.choice([rng.randint(1, sum(nets) + 3), sum(rng.sample(nets, rng.randint(1, len(nets)))) + rng.randint(0, 3)])
    for k in range(750):  # a day's captures: few amounts, often repeated, and a part of them paid out with something taken off
        prices = [rng.randint(900, 90_000) for _ in range(rng.randint(1, 6))]
        nets = [rng.choice(prices) - rng.randint(0, 2) for _ in range(rng.randint(2, 13))]
        yield nets, sum(rng.sample(nets, rng.randint(1, len(nets)))) - rng.choice([0, 0, 1, 500])


@pytest.mark.parametrize("held", [solver.HELD_BYTES, 0])
def test_answers_against_every_subset(held):
    n = 0
    for nets, target in instances():
        n += 1
        a = solver.answer(nets, target, listed=solver.MAX_LISTED, held_bytes=held)
        want = walked(nets, target, solver.MAX_LISTED) if target > 0 else []
        assert a.seen == want, (nets, target)
        assert a.found == want[:4] and a.exhaustive == (len(want) <= 4)
        assert a.verdict == ("AMBIGUOUS" if len(want) > 1 else "PROVEN" if want else "CONTRADICTED")
        usable = [x for x in nets if 0 < x <= target]
        if target > 0 and usable:
            sums, window = ways(usable, target), min(target, solver.WINDOW)
            near = [c for s, c in sums.items() if target - window <= s <= target]
            assert a.reachable == len(near) and a.density == len(near) / (window + 1)
            assert a.unique_share == (near.count(1) / len(near) if near else 0.0)
    assert n == 1_777


def test_all_explanations_of_repeated_amounts():
    for nets, target in [([7] * 6, 21), ([5, 5, 5, 3, 3, 3], 16), ([2] * 8, 9)]:
        assert solver.answer(nets, target, listed=10_000).seen == walked(nets, target, 10_000)


def test_dead_ends_are_searched_once():
    """Sums that come near the credit everywhere and meet its tolerance nowhere: the plain search has 2 to the 60 branches."""
    nets = [1_000 * k for k in range(1, 61)]
    assert solver.answer(nets, 900_000 + 64).verdict == "CONTRADICTED"
    assert solver.answer([60 * k for k in range(20, 320)], 399_999 // 60 * 60 + 55).verdict in ("CONTRADICTED", "AMBIGUOUS")


def test_the_largest_pool_in_bounded_memory():
    rng = random.Random(1)
    nets = [rng.randint(1_000, 100_000) for _ in range(solver.MAX_POOL)]
    tracemalloc.start()
    try:
        assert solver.answer(nets, solver.MAX_TARGET).verdict == "AMBIGUOUS"
        assert tracemalloc.get_traced_memory()[1] < 200e6
    finally:
        tracemalloc.stop()
