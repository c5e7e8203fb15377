import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from tallymark.operators import lineage
from tallymark.operators.close import certificate, exposure, readiness, scope

FOUND = "settlement_id string, verdict string, order_id string, fit_gross long, method string, net_paise long, candidates int, integrity string"


def _scope(spark, ids):
    day = dt.date(2024, 5, 3)
    rows = [("2024-05", i, day, 100, dt.date(2024, 5, 1), dt.date(2024, 5, 31)) for i in ids]
    return spark.createDataFrame(rows, "period_id string, settlement_id string, settled_on date, net_paise long, starts_on date, ends_on date")


def test_each_rule_raises_its_kind(spark):
    good = ("o1", 100, "upi", 100, 1, "HEURISTIC")
    found = spark.createDataFrame(
        [
            ("clean", "PROVEN", *good), ("two", "PROVEN", *good), ("two", "AMBIGUOUS", *good), ("other", "PROVEN", *good), ("other", "PROVEN", "o2", *good[1:]), ("again", "PROVEN", *good), ("again", "PROVEN", *good),
            ("off", "PROVEN", "o1", 103, "upi", 100, 1, "HEURISTIC"), ("near", "PROVEN", "o1", 101, "upi", 100, 1, "HEURISTIC"), ("bare", "PROVEN", None, 100, "upi", 100, 1, "HEURISTIC"),
            ("lost", "PROVEN", "o1", 190, "upi", 100, 1, "COMPROMISED"), ("hazy", "AMBIGUOUS", None, None, None, 100, 2, "COMPROMISED"), ("stranger", "PROVEN", None, 1, "upi", 100, 0, "COMPROMISED"),
        ],
        FOUND,
    )
    inside = _scope(spark, ["clean", "two", "other", "again", "off", "near", "bare", "lost", "hazy", "gone"])
    late = _scope(spark, ["clean2"]).withColumn("settled_on", F.lit(dt.date(2024, 6, 1))).withColumn("net_paise", F.lit(-7).cast("long"))
    got = {(r.kind, r.ref_id): r.exposure_paise for r in scope.blockers(inside.unionByName(late), found).collect()}
    assert got == {
        ("IMPOSSIBLE_STATE_TRANSITION", "clean2"): 7, ("CONTRADICTORY_EVIDENCE", "two"): 0, ("CONTRADICTORY_EVIDENCE", "other"): 0, ("FAILED_INVARIANT", "off"): 3, ("FAILED_INVARIANT", "bare"): 0,
        ("FAILED_INVARIANT", "lost"): 0, ("COMPROMISED_INTEGRITY", "lost"): 0, ("COMPROMISED_INTEGRITY", "hazy"): 0, ("MISSING_SETTLEMENT", "gone"): 0, ("MISSING_SETTLEMENT", "clean2"): 0,
    }
    assert scope.blockers(inside.limit(0), found).count() == 0
    assert scope.blockers(inside, found.limit(0)).select("kind").distinct().collect() == [("MISSING_SETTLEMENT",)]


def test_integrity_is_lost_with_a_true_member(spark):
    found = spark.createDataFrame([("a", "HEURISTIC"), ("b", "HEURISTIC"), ("c", "HEURISTIC")], "settlement_id string, integrity string")
    pool = spark.createDataFrame([("a", "o1"), ("a", "o2"), ("b", "o3")], "settlement_id string, order_id string")
    members = spark.createDataFrame([("a", "o1"), ("b", "o3"), ("b", "o4"), ("b", "o5")], pool.schema)
    assert {r.settlement_id: r.integrity for r in scope.measured_integrity(found, pool, members).collect()} == {"a": "HEURISTIC", "b": "COMPROMISED", "c": "HEURISTIC"}


def _certified(spark):
    item = ("2024-05", dt.date(2024, 5, 3), "REVIEW", None, "LOW")
    rows = [(f"s{k}", *item, "CONTRADICTED", 0, 10_000 * k, 0, "UNVERIFIED", 10_000 * k) for k in range(1, 5)] + [("t", "2024-06", dt.date(2024, 6, 3), "AUTO_POST", None, None, "PROVEN", 0, 5, 5, None, 0)]
    own = spark.createDataFrame(rows, "settlement_id string, period_id string, settled_on date, decision string, reason string, severity string, verdict string, unexplained_paise long, value_paise long, verified_paise long, kind string, exposure_paise long")
    found = spark.createDataFrame([], "settlement_id string, order_id string, verdict string")
    stops, carried = readiness.blockers(own, found), readiness.carry_forward(own)
    return certificate.issue(readiness.verdicts(own, found), exposure.totals(own), stops, carried, "now"), stops, carried


def test_certificates_can_be_made_again_by_hand(spark):
    issued, stops, carried = _certified(spark)
    own = {r.period_id: r.asDict() for r in issued.collect()}
    assert own["2024-05"]["verdict"] == "BLOCKED" and own["2024-06"]["verdict"] == "READY_TO_CLOSE" and own["2024-06"]["blockers_digest"] == "0-0-0-0"
    listed = [r for r in stops.collect() if r.period_id == "2024-05"]
    lanes = [0] * 4
    for r in listed:
        h = hashlib.sha256(json.dumps([r.kind, r.ref_id, str(r.rule_no), str(r.exposure_paise)], separators=(",", ":")).encode()).hexdigest()
        lanes = [lanes[k] + int(h[15 * k : 15 * k + 15], 16) for k in range(4)]
    c = own["2024-05"]
    assert c["n_blockers"] == len(listed) == 5 and c["blockers_digest"] == "-".join(map(str, lanes))
    payload = {
        "blockers": {"count": c["n_blockers"], "digest": c["blockers_digest"]}, "carry_forward": {"count": c["n_carry_forward"], "digest": c["carry_forward_digest"]}, "invariants": ["verified 0 + unresolved 100000 = total 100000", "decision BLOCKED"],
        "materiality": {"ceiling_paise": 10_000_000, "effective_threshold_paise": 10_000, "floor_paise": 10_000, "policy_version": c["materiality_version"], "threshold_bps": 100},
        "period": {"end": "2024-05-31", "period_id": "2024-05", "start": "2024-05-01"}, "provenance": {"engine_version": c["engine_version"], "policy_version": c["policy_version"]},
        "values": {"material_exposure_paise": 100_000, "period_value_paise": 100_000, "reconciled_value_paise": 0, "unresolved_paise": 100_000}, "verdict": "BLOCKED",
    }
    assert c["evidence_hash"] == hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert c["certificate_id"] == f"CERT-2024-05-{c['evidence_hash'][:8]}"


def test_tampering_shows(spark):
    issued, stops, carried = _certified(spark)
    assert all(r.seal_holds and r.blockers_hold and r.carry_forward_holds for r in certificate.verified(issued, stops, carried).collect())
    changed = issued.withColumn("unresolved_paise", F.col("unresolved_paise") - 1)
    assert not any(r.seal_holds for r in certificate.verified(changed, stops, carried).collect())
    other = issued.withColumn("issued_at", F.lit("later"))  # not part of the evidence
    assert all(r.seal_holds for r in certificate.verified(other, stops, carried).collect())
    less = {r.period_id: r for r in certificate.verified(issued, stops.where("ref_id <> 's2'"), carried.limit(0)).collect()}
    assert not less["2024-05"].blockers_hold and less["2024-06"].blockers_hold and not less["2024-05"].carry_forward_holds and less["2024-06"].carry_forward_holds


def test_walks_end_with_the_graph(spark):
    chain = [(f"n{k}", f"n{k + 1}", "X") for k in range(14)] + [("n14", "n13", "X")]  # longer than the stages, with a circle
    graph = spark.createDataFrame(chain, "source string, target string, relationship string")
    start = spark.createDataFrame([("n0",)], "node_id string")
    assert {r.node_id for r in lineage.closure(graph, start, backward=False).collect()} == {f"n{k}" for k in range(15)}
    assert [r.node_id for r in lineage.closure(graph, start).collect()] == ["n0"]
