"""Contradictions among explanations against every subset of payouts."""

from __future__ import annotations

import random
from itertools import combinations, product

from tallymark.operators import setpacking

SETS = "settlement_id string, explanation long, net_paise long, order_ids array<string>"


def _holds(rows, payouts):
    lists = [[o for p, o in rows if p == want] for want in payouts]
    return any(sum(map(len, pick)) == len(frozenset().union(*pick)) for pick in product(*lists))


def test_cores_are_minimal_and_leave_nothing_behind():
    draw = random.Random(3)
    n_found = 0
    for _ in range(60):
        rows = [(f"s{draw.randrange(6)}", frozenset(draw.sample("abcdefg", draw.randint(1, 3)))) for _ in range(draw.randint(1, 10))]
        found = [core for core, state in setpacking.cores(rows) if state == "MINIMAL"]
        assert len(found) == len(setpacking.cores(rows))
        n_found += len(found)
        for core in found:
            assert not _holds(rows, core)
            assert all(_holds(rows, less) for less in combinations(core, len(core) - 1))
        taken = [p for core in found for p in core]
        assert len(taken) == len(set(taken))
        assert _holds(rows, sorted({p for p, _ in rows} - set(taken)))
    assert n_found > 10


def test_a_search_that_gives_up_is_told():
    draw = random.Random(4)
    seen = set()
    for _ in range(80):
        rows = [(f"s{draw.randrange(7)}", frozenset(draw.sample("abcdefg", draw.randint(1, 3)))) for _ in range(14)]
        names = sorted({p for p, _ in rows})
        for most in (0, 1, 2, 3):
            found = setpacking.cores(rows, most)
            seen |= {state for _, state in found}
            taken = [p for core, _ in found for p in core]
            assert len(taken) == len(set(taken))
            for core, state in found:
                assert state == "UNDECIDED" or not _holds(rows, core)
                assert state != "MINIMAL" or all(_holds(rows, less) for less in combinations(core, len(core) - 1))
            if "UNDECIDED" not in {state for _, state in found}:  # then nothing is left out
                assert _holds(rows, [p for p in names if p not in taken])
    assert seen == {"MINIMAL", "CONTRADICTORY", "UNDECIDED"}


def test_loosening_changes_no_answer():
    draw = random.Random(6)
    for _ in range(200):
        rows = [(f"s{draw.randrange(6)}", frozenset(draw.sample("abcdefgh", draw.randint(1, 3)))) for _ in range(draw.randint(1, 10))]
        names = sorted({p for p, _ in rows})
        assert setpacking.together([[o for p, o in rows if p == want] for want in names]) == _holds(rows, names)


def test_findings_of_packing(spark):
    rows = [("s1", 1, 5, ["a"]), ("s2", 1, 5, ["a"]), ("s3", 1, 9, ["b", "c"]), ("s4", 1, 4, ["d"]), ("s4", 2, 4, ["e"])]
    sets = spark.createDataFrame(rows, SETS)
    payouts = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s4",), ("s5",)], "settlement_id string")
    cores = {(r.core, r.settlement_id, r.contested) for r in setpacking.unsat_cores(sets).collect()}
    assert cores == {("s1", "s1", 1), ("s1", "s2", 1)}
    got = {r.settlement_id: (r.verdict, r.layer, r.strict, r.core) for r in setpacking.packed_findings(payouts, sets).collect()}
    assert got["s3"] == ("PROVEN", "PACKED_FORCED", 1, None)
    assert got["s4"] == ("AMBIGUOUS", "PACKED_UNFORCED", None, None)
    assert got["s5"] == ("CONTRADICTED", "NO_CANDIDATE", None, None)
    assert {got[s][:2] for s in ("s1", "s2")} == {("AMBIGUOUS", "PACKED_UNFORCED+CORE")}


def test_no_explanations(spark):
    sets = spark.createDataFrame([], SETS)
    assert setpacking.unsat_cores(sets).collect() == []
    assert [tuple(r) for r in setpacking.packed_findings(spark.createDataFrame([("s",)], "settlement_id string"), sets).collect()] == [("s", "CONTRADICTED", "NO_CANDIDATE", None, None, None)]
