"""Predictions against the formula, term by term."""

from __future__ import annotations

import itertools
import math

from tallymark.operators.close import prediction

CARRIED = "period_id string, settlement_id string, reason string, severity string, exposure_paise long, age_days long"


def by_hand(reason, severity, exposure, age, verdict, candidates, attempts):
    p0, days = prediction.PRIORS.get(reason, prediction.DEFAULT_PRIOR)
    logit = math.log(p0 / (1 - p0)) + next((v for limit, v in ((2, 0.35), (5, 0.05), (10, -0.4), (30, -1.1)) if age <= limit), -2.2)
    logit += next((v for limit, v in ((1, 1.0), (5_000, 0.4), (50_000, 0.1), (500_000, -0.3)) if exposure < limit), -0.8)
    named, partly, orders = reason in prediction.PRIORS, verdict == "CONTRADICTED" and candidates > 0, verdict in ("PROVEN", "AMBIGUOUS")
    logit += 0.35 * named + 0.25 * (partly or orders) + {"HIGH": -1.2, "MEDIUM": -0.3}.get(severity, 0) - 0.4 * min(attempts, 4)
    p = round(max(0.01, min(0.99, 1 / (1 + math.exp(-logit)))), 4)
    horizon = max(1, min(days, 4 - age)) if reason == "TIMING_MISMATCH" else max(1, days) if p >= 0.75 else days + 3 if p >= 0.4 else max(14, days + 10)
    sure = 50 + 25 * (abs(p - 0.5) >= 0.3) + 15 * (named or orders) + 10 * (age > 20)
    return p, horizon, "HIGH" if sure >= 75 else "MEDIUM"


def test_every_term(spark):
    cases = list(itertools.product(["TIMING_MISMATCH", "CHARGEBACK", "NO_VALID_ASSIGNMENT", "SOMETHING_ELSE"], ["HIGH", "MEDIUM", "LOW"], [0, 4_999, 60_000, 900_000], [0, 9, 40], [("PROVEN", 3), ("CONTRADICTED", 0), ("CONTRADICTED", 2), ("INSUFFICIENT", 5), (None, None)], [0, 2, 9]))
    cases = cases[::7]
    make = spark.createDataFrame
    carried = make([("p", f"s{i}", r, s, e, a) for i, (r, s, e, a, _, _) in enumerate(cases)], CARRIED)
    own = make([(f"s{i}", 200_000 * (i % 3)) for i in range(len(cases)) if i % 5], "settlement_id string, value_paise long")
    found = make([(f"s{i}", v, n, 2) for i, (*_, (v, n), _) in enumerate(cases) if v], "settlement_id string, verdict string, candidates long, n_fits long")
    tried = make([(f"s{i}", k) for i, (*_, k) in enumerate(cases) if k], "settlement_id string, prior_attempts long")
    rows = prediction.features(carried, own, found, tried)
    facts = {r.settlement_id: r for r in rows.collect()}
    got = {r.settlement_id: r for r in prediction.predict(rows).collect()}
    assert len(got) == len(cases)
    for i, (reason, severity, exposure, age, (verdict, n), attempts) in enumerate(cases):
        r = got[f"s{i}"]
        p, horizon, confidence = by_hand(reason, severity, exposure, age, verdict, n or 0, attempts)
        assert abs(r.probability - p) <= 1.01e-4 and (abs(p - 0.75) < 2e-4 or abs(p - 0.4) < 2e-4 or r.horizon_days == horizon), cases[i]
        assert r.confidence == confidence or abs(abs(p - 0.5) - 0.3) < 2e-4
        f = facts[f"s{i}"]
        value = 200_000 * (i % 3) if i % 5 else 0
        assert f.settlement_value_paise == (value or max(exposure, 1)) and f.exposure_ratio == min(1.0, exposure / (value or max(exposure, 1)))
        assert f.prior_attempts == attempts and f.ambiguity_count == 0


def test_without_features_nothing_is_known(spark):
    carried = spark.createDataFrame([("p", "s", "CHARGEBACK", "LOW", 10, 0)], CARRIED)
    (r,) = prediction.predict(carried).collect()
    assert abs(r.probability - round(1 / (1 + math.exp(-(math.log(0.18 / 0.82) + 0.35 + 0.4))), 4)) < 1e-4 and r.confidence == "MEDIUM"
    empty = carried.limit(0)
    own, found = spark.createDataFrame([], "settlement_id string, value_paise long"), spark.createDataFrame([], "settlement_id string, verdict string, candidates long, n_fits long")
    assert prediction.predict(prediction.features(empty, own, found)).count() == 0
