import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from tallymark.operators import evidence, review, setpacking
from tallymark.sources import portfolio
from tallymark.streaming import boundary

SECRET = b"k" * 70  # longer than a block


def sent(body, arrival, secret=SECRET, provider="p"):
    return (provider, body, hmac.new(secret, body.encode(), hashlib.sha256).hexdigest() if secret else None, arrival)


def test_deliveries_pass_the_boundary(spark):
    a = json.dumps({"id": "e1", "event": "payment.captured", "payload": {"x": [{"order_id": "ord_1"}, {"deep": {"settlement_id": "setl_2", "amount": 3}}], "id": 7}})
    same = json.dumps(json.loads(a), sort_keys=True, indent=1)  # other bytes, the same content
    rows = [
        sent(a, 1), sent(same, 2), sent(a.replace("ord_1", "ord_9"), 3), sent(a, 4, b"other"), sent(a, 5, None), sent("not json", 6), sent("[1]", 7),
        sent('{"event": "odd.kind", "id": "e2"}', 8), sent('{"é": 1}', 9),
    ]
    df = spark.createDataFrame(rows, "provider string, body string, signature string, arrival long")
    got = {r.arrival: r for r in boundary.received(df, SECRET).collect()}
    assert [got[k].status for k in range(1, 10)] == ["accepted", "duplicate", "replay_mismatch", "bad_signature", "bad_signature", "bad_signature", "bad_signature", "unsupported", "unsupported"]
    assert got[9].event_id == hashlib.sha256('{"é": 1}'.encode()).hexdigest()[:24] and got[9].kind == "unknown"
    assert {r.status for r in boundary.received(df, None).collect()} == {"unverifiable"}
    assert boundary.named(a) == ["e1", "ord_1", "setl_2"] and boundary.named("{") == []
    owed = boundary.owed(boundary.received(df, SECRET), 0).collect()
    assert {r.entity for r in owed} == {"e1", "ord_1", "setl_2"}
    assert boundary.received(df.limit(0), SECRET).count() == 0


def test_reviews_are_recorded_or_refused(spark):
    rows = [("i", 1, "DEFER_REVIEW", "ann", "later"), ("i", 2, "ASSIGN_REVIEWER", " ", "x"), ("i", 3, "ASSIGN_REVIEWER", "ann", None), ("i", 4, "CLOSE", "ann", "x"), ("i", 5, "ASSIGN_REVIEWER", "bob", "x"), ("j", 6, "CLOSE", "ann", "x")]
    log = review.recorded(spark.createDataFrame(rows, "item_id string, seq long, action string, reviewer string, justification string"))
    assert [r.error for r in log.orderBy("seq").collect()] == [None, "BLANK_REVIEWER", "BLANK_JUSTIFICATION", "UNKNOWN_ACTION", None, "UNKNOWN_ACTION"]
    items = spark.createDataFrame([("i",), ("j",)], "item_id string")
    assert {r.item_id: (r.status, r.n_actions) for r in review.latest(items, log).collect()} == {"i": ("IN_REVIEW", 2), "j": ("PENDING", 0)}


def test_nobody_is_granted_what_no_agent_holds(spark):
    roster = spark.createDataFrame([("a", ["run_solver", "post_accounting_entry"])], "agent string, capabilities array<string>")
    rows = [(1, "a", "post_accounting_entry", "e", "PROVEN", True, "AUTO_POST"), (2, "b", "run_solver", "e", "PROVEN", True, "AUTO_POST"), (3, "a", "run_solver", None, "PROVEN", True, "AUTO_POST"), (4, "a", "run_solver", "e", None, None, "AUTO_POST"), (5, "a", "run_solver", "e", "PROVEN", True, None), (6, "a", "run_solver", "e", "PROVEN", True, "AUTO_POST")]
    df = spark.createDataFrame(rows, "request_id long, agent string, capability string, evidence string, verdict string, postable boolean, decision string")
    assert [r.stage for r in review.requested(df, roster).orderBy("request_id").collect()] == ["CAPABILITY", "CAPABILITY", "EVIDENCE", "VERIFICATION", "POLICY", "ACTION"]


def test_portfolio_is_its_own_truth(spark, tmp_path):
    own = portfolio.payouts_of(spark, 2_000, 11)
    orders = portfolio.orders_of(own, 11)
    paid = portfolio.settled(own, orders, 11)
    shares = {r["case"]: r["count"] / 2_000 for r in own.groupBy("case").count().collect()}
    assert set(shares) == set(portfolio.MIX) and all(abs(shares[c] - s / 100) < 0.025 for c, s in portfolio.MIX.items())
    assert orders.count() == orders.select("order_id").distinct().count()
    assert orders.where(~F.col("gross_paise").between(portfolio.GROSS[0], portfolio.GROSS[1] - 1)).count() == 0
    sums = orders.groupBy("payout").agg(F.sum("net_paise").alias("net"))
    joined = paid.withColumn("payout", F.substring("settlement_id", 6, 9).cast("long")).join(sums, "payout")
    assert joined.where("case = 'clean' and net <> net_paise").count() == 0 and joined.where("case = 'refund_offset' and net <= net_paise").count() == 0
    portfolio.write_csv(paid, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2_000


def test_agreement_and_lanes(spark):
    rows = [("s", "a b", "a", 5), ("s", "a b", "b", 7), ("s", "a c", "a", 5), ("s", "a c", "c", 7), ("t", "d", "d", 9)]
    explained = spark.createDataFrame([(s, e, o, n, n) for s, e, o, n in rows], "settlement_id string, explanation string, order_id string, net_paise long, gross_paise long")
    got = {r.settlement_id: r for r in evidence.settled_disputed(explained).collect()}
    assert (got["s"].n_forced, got["s"].n_contested, got["s"].settled_paise, got["s"].disputed_paise) == (1, 2, 5, 14)
    assert (got["t"].n_forced, got["t"].disputed_paise, got["t"].first_contested) == (1, 0, None)
    pool = spark.createDataFrame([("s", f"o{i:02}", i) for i in range(1, 22)], "settlement_id string, order_id string, net_paise long")
    lanes = evidence.lanes(pool).orderBy("lane").collect()
    assert [r.order_id for r in lanes][:2] == ["o21", "o20"] and lanes[-1].order_id == "+3" and lanes[-1].net_paise == 6 and lanes[2].above_paise == 41


@pytest.mark.parametrize("steps", [200_000, 3])
def test_large_groups_are_searched_within_steps(monkeypatch, steps):
    monkeypatch.setattr(setpacking, "STEPS", steps)
    rows = [(f"p{i}", 10, frozenset({f"o{i}", f"o{i + 1}"})) for i in range(900)] if steps == 3 else [(f"p{i}", 10, frozenset({f"o{i}"})) for i in range(900)]
    score, chosen, whole = setpacking.best(rows)
    assert whole == (steps != 3) and len({o for i in chosen for o in rows[i][2]}) == sum(len(rows[i][2]) for i in chosen)
