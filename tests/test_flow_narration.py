"""References against every text, and flows that keep nothing."""

from __future__ import annotations

import random

import pytest

from tallymark.operators import flow, narration


@pytest.mark.parametrize("run", [1, 3, 6])
def test_references_against_every_text(spark, run):
    rng = random.Random(run)
    texts = [(f"t{i}", "".join(rng.choices("ab1é/ ", k=rng.randint(0, 30)))) for i in range(120)] + [("null", None), ("long", "ab" * 5_000 + "é1")]
    needles = [(f"n{i}", "".join(rng.choices("ab1é/", k=rng.randint(1, 8)))) for i in range(60)]
    needles += [(f"p{i}", t[5 : 5 + rng.randint(1, 20)]) for i, (_, t) in enumerate(texts[:40])] + [("empty", ""), ("null", None), ("same", needles[0][1])]
    got = narration.holding(spark.createDataFrame(texts, "text_id string, text string"), spark.createDataFrame(needles, "reference_id string, reference string"), run).collect()
    want = sorted((t, n) for t, text in texts for n, ref in needles if text is not None and ref and ref in text)
    assert sorted(map(tuple, got)) == want


def test_the_plan_has_no_nested_loop(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = spark.createDataFrame([("t", "a b")], "text_id string, text string")
        plan = narration.holding(texts, texts.selectExpr("text_id as reference_id", "text as reference"))._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_texts_or_references(spark):
    texts = spark.createDataFrame([("t", "a b")], "text_id string, text string")
    refs = texts.selectExpr("text_id as reference_id", "text as reference")
    assert narration.holding(texts.limit(0), refs).count() == narration.holding(texts, refs.limit(0)).count() == 0


@pytest.mark.parametrize("lanes", [1, 3, 18])
def test_payouts_keep_nothing(spark, lanes):
    rng = random.Random(2)
    members, payouts, want = [], [], {}
    for k in range(20):
        own = [(f"s{k}", f"o{k}-{i}", n + rng.randint(0, 3), n) for i, n in enumerate(rng.choices(range(50, 60), k=rng.randint(1, 6)))]
        drift = rng.choice([0, 0, 2, -1])
        members += own
        payouts.append((f"s{k}", sum(m[3] for m in own) - drift, rng.choice(["u", None])))
        want[f"s{k}"] = (own, drift)
    rows = flow.edges(spark.createDataFrame(members, "settlement_id string, order_id string, gross_paise long, net_paise long"), spark.createDataFrame(payouts, "settlement_id string, net_paise long, utr string"), lanes)
    edges = {}
    for r in rows.collect():
        edges.setdefault(r.settlement_id, []).append(r)
    for s, net, utr in payouts:
        own, drift = want[s]
        top = sorted(own, key=lambda m: (-m[3], m[1]))
        into = {(r.source, r.paise) for r in edges[s] if r.kind == "ORDER"}
        rest = sum(m[2] for m in top[lanes:])
        assert into == {(m[1], m[2]) for m in top[:lanes]} | ({("remainder", rest)} if len(top) > lanes else set())
        assert [(r.kind, r.paise) for r in edges[s] if r.target == "bank"] == [("EXACT_UTR" if utr else "AMOUNT_MATCH", net)]
        assert sum(r.paise * (1 if r.source == s else -1) for r in edges[s] if r.kind == "ROUNDING") == drift
    held = flow.nodes(rows).collect()
    assert all(r.conserved for r in held if r.node == r.settlement_id) and sum(r.node == r.settlement_id for r in held) == 20
    assert all(r.conserved is None for r in held if r.node != r.settlement_id)
