"""Causes and neighbours of a graph against a walk, and the relations of a close by hand."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallymark.operators import lineage

EDGES = "source string, target string, relationship string"


def head(node):
    parts = node.split(":")
    return ":".join(parts[:2]) if parts[0] in ("evt", "rec") else parts[0]


@pytest.mark.parametrize("backward", [True, False])
def test_causes_against_a_walk(spark, backward):
    """With circles, repeated edges and nodes that nothing leads to."""
    rng = random.Random(5)
    names = [f"{rng.choice(lineage.TYPES)}:{i}" for i in range(60)]
    edges = [(rng.choice(names), rng.choice(names), "X") for _ in range(90)] + [(names[0], names[1], "X"), (names[1], names[0], "X")] * 2
    near = {}
    for a, b, _ in edges:
        near.setdefault(b if backward else a, set()).add(a if backward else b)
    want = {}
    for root in names[:20]:
        seen, left = {root}, [root]
        while left:
            for n in near.get(left.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    left.append(n)
        for kind, n in Counter(head(x) for x in seen - {root}).items():
            want[root, kind] = n
    got = lineage.causes(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(n,) for n in names[:20]], "node_id string"), backward).collect()
    assert {(r.root, r.type): r.n for r in got} == want


def test_neighbours(spark):
    edges = [("setl:1", "exc:1", "A"), ("setl:1", "exc:1", "B"), ("find:1", "exc:1", "A"), ("exc:1", "exp:1", "A")]
    got = {r.node_id: tuple(r)[1:] for r in lineage.adjacent(spark.createDataFrame(edges, EDGES)).collect()}
    assert got == {"setl:1": (0, 1, 0, 2), "find:1": (0, 1, 0, 1), "exc:1": (2, 1, 3, 1), "exp:1": (1, 0, 1, 0)}


def test_neighbours_shuffle_their_edges_once(spark):
    graph = spark.range(10_000).selectExpr("concat('evt:', id) as source", "concat('rec:', id) as target", "'CAPTURED_AS' as relationship")
    graph = graph.unionByName(spark.createDataFrame([("evt:0", "rec:0", "PROVEN_BY"), ("evt:0", None, "x"), (None, "rec:0", "x")], EDGES))
    store = spark.sparkContext._jsc.sc().statusStore()

    def written() -> int:
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    got = {r.node_id: tuple(r)[1:] for r in lineage.adjacent(graph).collect() if r.node_id}
    assert len(got) == 20_000 and got["evt:0"] == (0, 1, 0, 3) and got["rec:0"] == (1, 0, 3, 0) and got["evt:7"] == (0, 1, 0, 1)
    assert written() - before < 35_000


def test_the_relations_of_a_close(spark):
    make = spark.createDataFrame
    orders = make([("o1",), ("o2",)], "order_id string")
    matched = make([("t1", "s1"), ("t2", None)], "txn_id string, settlement_id string")
    found = make([("s1", "o1"), ("s2", None)], "settlement_id string, order_id string")
    established = make([("s2", "o2"), ("s9", "o2")], "settlement_id string, order_id string")
    day = date(2026, 5, 4)
    own = make([("s1", "2026-05", day, None, None), ("s2", "2026-05", day, "MISSING_TRANSACTION", "UNVERIFIED")], "settlement_id string, period_id string, settled_on date, reason string, kind string")
    stops = make([("2026-05", "HIGH_SEVERITY_EXCEPTION", "s2"), ("2026-05", "UNRESOLVED_MATERIAL_AMOUNT", "material_exposure:2026-05"), ("2026-05", "DUPLICATE_LEDGER_IMPACT", "s1:o1")], "period_id string, kind string, ref_id string")
    carried = make([("2026-05", "s2", "MISSING_TRANSACTION")], "period_id string, settlement_id string, reason string")
    got = sorted(map(tuple, lineage.whole(orders, matched, found, established, own, stops, carried).collect()))
    high, amount, twice = "blk:2026-05:HIGH_SEVERITY_EXCEPTION:s2", "blk:2026-05:UNRESOLVED_MATERIAL_AMOUNT:material_exposure:2026-05", "blk:2026-05:DUPLICATE_LEDGER_IMPACT:s1:o1"
    vdt, mat = "vdt:2026-05", "mat:2026-05"
    assert got == sorted([
        *[(f"evt:pay:{o}", f"rec:order:{o}", "CAPTURED_AS") for o in ("o1", "o2")], *[(f"evt:bank:{t}", f"rec:bank:{t}", "CAPTURED_AS") for t in ("t1", "t2")], ("rec:bank:t1", "setl:s1", "CREDITED_IN_BANK"),
        ("rec:order:o1", "proof:s1", "BUNDLED_IN_SETTLEMENT"), ("proof:s1", "find:s1", "PROVEN_BY"), ("find:s1", "setl:s1", "PROVEN_BY"), ("find:s2", "setl:s2", "PROVEN_BY"), ("setl:s1", vdt, "DETERMINES_VERDICT"), ("setl:s2", vdt, "DETERMINES_VERDICT"),
        ("setl:s2", "exc:s2", "DISCREPANCY_RAISED"), ("rec:order:o2", "exc:s2", "ESTABLISHED_PARTIAL"), ("miss:s2", "exc:s2", "MISSING_EVIDENCE_LINK"), ("setl:s2", "exp:s2", "ASSESSED_EXPOSURE"), ("find:s2", "exp:s2", "ASSESSED_EXPOSURE"), ("exc:s2", "exp:s2", "ASSESSED_EXPOSURE"),
        ("exp:s2", mat, "EVALUATED_AGAINST_POLICY"), (mat, vdt, "DETERMINES_VERDICT"), *[(b, vdt, "CAUSES_BLOCKER") for b in (high, amount, twice)], ("exc:s2", high, "CAUSES_BLOCKER"), (mat, amount, "CAUSES_BLOCKER"), ("setl:s1", twice, "CAUSES_BLOCKER"),
        ("cf:s2", vdt, "CARRIED_FORWARD"), ("exc:s2", "cf:s2", "CARRIED_FORWARD"),
    ])
    assert len({r for *_, r in got}) == 12
    start = make([(vdt,)], "node_id string")
    behind = {r.type: r.n for r in lineage.causes(make(got, EDGES), start).collect()}
    assert behind["rec:order"] == 2 and behind["blk"] == 3 and behind["miss"] == 1 and set(behind) <= set(lineage.TYPES) and "vdt" not in behind
    assert lineage.causes(make(got, EDGES), start.where(F.lit(False))).count() == 0
