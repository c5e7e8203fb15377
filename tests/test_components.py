"""Components of payouts against union-find, and how many rounds a chain takes."""

from __future__ import annotations

import random

from tallymark.operators import reports


def test_components_against_union_find(spark):
    rng = random.Random(7)
    rows = [(f"s{rng.randrange(80):02d}", f"o{rng.randrange(90):02d}") for _ in range(110)] + [("s00", "o00")] * 2
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for s, o in rows:
        parent[root(s)] = root(o)
    low = {}
    for s, _ in rows:
        low[root(s)] = min(low.get(root(s), s), s)
    got = {r.settlement_id: r.component for r in reports.conflict_components(spark.createDataFrame(rows, "settlement_id string, order_id string")).collect()}
    assert got == {s: low[root(s)] for s, _ in rows}


def test_a_chain_halves(spark, monkeypatch):
    rounds, kept = [], reports.shared.stored
    monkeypatch.setattr(reports.shared, "stored", lambda df, name: rounds.append(name) or kept(df, name))
    chain = [(f"s{i + d:03d}", f"o{i:03d}") for i in range(64) for d in (0, 1)]
    got = reports.conflict_components(spark.createDataFrame(chain, "settlement_id string, order_id string"))
    assert {r.component for r in got.collect()} == {"s000"} and got.count() == 65
    assert rounds.count("labels") <= 10
