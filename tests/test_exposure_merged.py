"""A case for each rule of exposure from three sources, and totals that keep the value."""

from __future__ import annotations

import random

import pytest

from tallymark.operators.close import exposure

FINDINGS = "settlement_id string, seq int, verdict string, postable boolean, n_proofs long, proof_net long, proofs_gross long"
EXCEPTIONS = "settlement_id string, exception_id string, seq int, reason string, severity string, amount_paise long, unexplained_paise long, disputed_paise long"

FOUND = [
    ("a", 1, "PROVEN", True, 1, 100, 110), ("a0", 1, "PROVEN", True, 1, 100, 110), ("a1", 1, "PROVEN", True, 1, 100, 110), ("a2", 1, "PROVEN", True, 1, 100, 110), ("a2b", 1, "PROVEN", True, 1, 100, 110),
    ("b1", 1, "AMBIGUOUS", False, 3, 100, 330), ("b2", 1, "AMBIGUOUS", False, 2, 100, 220), ("b3", 1, "AMBIGUOUS", False, 1, 100, 110), ("b4", 1, "AMBIGUOUS", False, 0, None, None),
    ("c", 1, "INSUFFICIENT", False, 0, None, None), ("d1", 1, "CONTRADICTED", False, 0, None, None), ("d2", 1, "CONTRADICTED", False, 0, None, None), ("d3", 1, "CONTRADICTED", False, 0, None, None),
    ("e", 1, "PROVEN", False, 1, 100, 110), ("twice", 1, "PROVEN", True, 1, 100, 110), ("twice", 2, "CONTRADICTED", False, 0, None, None), ("twice", 3, "AMBIGUOUS", False, 2, 100, 110),
    ("net", 1, "PROVEN", True, 1, -70, 80),
]
TOLD = [
    ("a0", "x0", 1, "R", "LOW", 100, 0, 0), ("a2", "x1", 1, "R", "LOW", 100, -30, 0), ("a2b", "x2", 1, "R", "LOW", 100, 400, 0), ("b1", "x3", 1, "R", "LOW", 100, 20, 60), ("b2", "x4", 1, "R", "LOW", 100, 20, 0), ("b3", "x5", 1, "R", "LOW", 100, 20, 0),
    ("d1", "x6", 1, "R", "LOW", 100, 40, 0), ("d2", "x7", 1, "R", "LOW", 100, 100, 0), ("f1", "x8", 1, "R", "LOW", 100, 100, 0), ("f2", "x9", 1, "R", "LOW", 100, 5, 0), ("f2", "x9", 2, "S", "HIGH", 100, 99, 0), ("f2", "xa", 3, "T", "MEDIUM", 100, -7, 0), ("f2", "xb", 4, "U", "HIGH", 100, 7, 0),
    ("amount", "xc", 1, "R", "LOW", 55, 1, 0),
]
WANT = {
    "a": ("A", 100, 100, None, None, None, 0), "a0": ("A", 100, 100, None, None, None, 0), "a1": ("A1", 100, 0, "POLICY_BLOCKED", "INSUFFICIENT_EVIDENCE", "HIGH", 100),
    "a2": ("A2", 100, 70, "PARTIAL", "R", "LOW", 30), "a2b": ("A2", 100, 0, "PARTIAL", "R", "LOW", 100), "b1": ("B", 100, 0, "AMBIGUOUS", "R", "LOW", 60), "b2": ("B", 100, 0, "AMBIGUOUS", "R", "LOW", 220),
    "b3": ("B", 100, 0, "AMBIGUOUS", "R", "LOW", 20), "b4": ("B", 100, 0, "AMBIGUOUS", "MULTIPLE_VALID_ASSIGNMENTS", "MEDIUM", 100), "c": ("C", 100, 0, "INSUFFICIENT", "INSUFFICIENT_EVIDENCE", "HIGH", 100),
    "d1": ("D", 100, 0, "PARTIAL", "R", "LOW", 40), "d2": ("D", 100, 0, "UNVERIFIED", "R", "LOW", 100), "d3": ("D", 100, 0, "UNVERIFIED", "NO_VALID_ASSIGNMENT", "HIGH", 100),
    "e": ("E", 100, 0, "AMBIGUOUS", "SEARCH_SPACE_UNCERTAIN", "LOW", 0), "twice": ("D", 100, 0, "UNVERIFIED", "NO_VALID_ASSIGNMENT", "HIGH", 100), "f1": ("F", 100, 0, "UNVERIFIED", "R", "LOW", 100),
    "f2": ("F", 100, 0, "PARTIAL", "T", "MEDIUM", 7), "g": ("G", 100, 0, "UNVERIFIED", "INSUFFICIENT_EVIDENCE", "HIGH", 100), "net": ("A", 70, 70, None, None, None, 0), "amount": ("F", 55, 0, "PARTIAL", "R", "LOW", 1), "none": ("G", 0, 0, "UNVERIFIED", "INSUFFICIENT_EVIDENCE", "HIGH", 0),
}


def run(spark, found, told, payouts, targets, seed=0):
    random.Random(seed).shuffle(found := list(found))
    random.Random(seed).shuffle(told := list(told))
    make = spark.createDataFrame
    judged = make([("a1", "BLOCK"), ("b1", "BLOCK"), ("a", "AUTO_POST"), ("a", None)][:3], "settlement_id string, decision string")
    rows = exposure.merged(make(found, FINDINGS), make(told, EXCEPTIONS), None if payouts is None else make(payouts, "settlement_id string, net_paise long"), judged, None if targets is None else make(targets, "settlement_id string"))
    return rows, {r.settlement_id: tuple(r)[1:] for r in rows.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_every_rule(spark, seed):
    known = [(s, 100) for s in WANT if s not in ("net", "amount", "none")]
    known[0] = (known[0][0], -100)
    rows, got = run(spark, FOUND, TOLD, known, [(s,) for s in WANT] + [("a",)], seed)
    assert got == WANT
    (total,) = exposure.merged_totals(rows).collect()
    assert total.total_paise == sum(w[1] for w in WANT.values()) == total.verified_paise + total.net_unresolved_paise
    assert total.verified_paise == sum(w[2] for w in WANT.values()) and total.contested_paise == sum(w[6] for w in WANT.values())
    assert total.n_settlements == len(WANT) and total.n_verified == 3 and total.n_items == len(WANT) - 3
    for column, kinds in (("ambiguous_paise", ("AMBIGUOUS",)), ("contradicted_paise", ("PARTIAL", "UNVERIFIED")), ("insufficient_paise", ("INSUFFICIENT",))):
        assert total[column] == sum(w[6] for w in WANT.values() if w[3] in kinds)


def test_which_payouts_count(spark):
    known = [("a", 100), ("g", 100)]
    assert set(run(spark, FOUND, TOLD, known, None)[1]) == {"a", "g"}
    for none in (None, []):
        assert set(run(spark, FOUND, TOLD, none, None)[1]) == {f[0] for f in FOUND} | {t[0] for t in TOLD}
    assert run(spark, [], [], [], None)[1] == {}
    (total,) = exposure.merged_totals(run(spark, [], [], [], None)[0]).collect()
    assert (total.total_paise, total.net_unresolved_paise, total.n_settlements) == (0, 0, 0)
