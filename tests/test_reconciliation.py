import itertools
import os

import pytest
from pyspark.sql import functions as F

from tallymark.functions import calendar as cal
from tallymark.functions import money
from tallymark.operators import advice, blocking, changes, findings, kernel, matching, policy, solver
from tallymark.operators.close.exposure import Bound
from tallymark.sources import ingest

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_fees_round_half_up_and_nets_add_up(spark):
    for gross, (method, bps) in itertools.product((1, 99, 100, 12_345, 999_999, 4_500_000), money.FEE_BPS.items()):
        fee = (gross * bps + 5000) // 10000
        assert one(spark, money.fee(F.lit(gross), F.lit(method))) == fee
        assert one(spark, money.net(F.lit(gross), F.lit(method))) == gross - fee - (fee * 1800 + 5000) // 10000
    assert one(spark, money.half_up(F.lit(-7), 2)) == -3
    assert one(spark, money.floor_div(F.lit(-7), 2)) == -4
    assert one(spark, money.fee(F.lit(100), F.lit("cheque"))) == 0


@pytest.mark.parametrize(("paise", "shown"), [(0, "₹0.00"), (5, "₹0.05"), (99_999, "₹999.99"), (100_000, "₹1,000.00"), (12_345_678_900, "₹12,34,56,789.00"), (-530_289_747, "-₹53,02,897.47"), (1_000_000_000, "₹1,00,00,000.00")])
def test_rupees(spark, paise, shown):
    assert one(spark, money.rupees(F.lit(paise).cast("long"))) == shown


@pytest.mark.parametrize(("start", "n", "end"), [("2026-05-01", 2, "2026-05-05"), ("2026-05-02", 2, "2026-05-05"), ("2026-05-03", 2, "2026-05-05"), ("2026-05-04", 2, "2026-05-06"), ("2026-05-01", 4, "2026-05-07"), ("2026-05-06", 3, "2026-05-11")])
def test_business_days(spark, start, n, end):
    assert str(one(spark, cal.business_days_after(F.lit(start).cast("date"), n))) == end
    assert one(spark, cal.business_days_between(F.lit(start).cast("date"), F.lit(end).cast("date"))) == n


@pytest.mark.parametrize(
    ("raw", "unit", "paise", "reason"),
    [("1050", "paise", 1050, None), ("1050.00", "paise", 1050, None), (" 7 ", "paise", 7, None), ("+5", "paise", 5, None), ("10.50", "rupees", 1050, None), ("10", "rupees", 1000, None), ("10.5", "paise", None, "FRACTIONAL_PAISE"),
     ("10.001", "rupees", None, "FRACTIONAL_PAISE"), ("NaN", "paise", None, "NOT_A_NUMBER"), ("1e3", "paise", None, "NOT_A_NUMBER"), ("", "paise", None, "EMPTY"), (None, "paise", None, "EMPTY"), ("-3", "paise", None, "NEGATIVE"), ("9" * 30, "paise", None, "TOO_LARGE")],
)
def test_amounts_are_exact_or_refused(spark, raw, unit, paise, reason):
    df = spark.createDataFrame([(raw,)], "raw string")
    value, why = ingest.parse_amount(F.col("raw"), unit)
    assert tuple(df.select(value, why).first()) == (paise, reason)


def test_ingest_keeps_totals_and_first_rows(spark):
    rows = [
        (1, "payment", "p1", None, "100", "upi", "s", None), (2, "payment", "p1", None, "100", "upi", "s", None), (3, "refund", "p1", None, "30", None, "s", None),
        (4, "payment", "p2", "p9", "5", "upi", "s", None), (5, "payment", "", " ", "7", "upi", "s", None), (6, "payment", None, None, "7", "upi", "s", None),
        (7, "payment", "p3", None, "1.5", "upi", "s", None), (8, "payment", "p4", None, "11", "barter", "s", None), (9, "payment", "p5", None, "100", "emi", "s", None),
    ]
    read = ingest.normalised(spark.createDataFrame(rows, "idx long, kind string, entity_id string, payment_id string, amount string, method string, settlement_id string, created_at date"))
    got = {r.idx: (r.status, r.reason) for r in read.collect()}
    assert got == {1: ("ACCEPTED", None), 2: ("DUPLICATE", None), 3: ("ACCEPTED", None), 4: ("REJECTED", "IDENTITY_CONFLICT"), 5: ("ACCEPTED", None), 6: ("ACCEPTED", None), 7: ("REJECTED", "FRACTIONAL_PAISE"), 8: ("UNMATCHED", "UNKNOWN_METHOD"), 9: ("ACCEPTED", None)}
    assert ingest.settlement_rollup(read).first().net_paise == 100 - 30 + 7 + 7 + 11 + 100


def brute(nets, target):
    found = []
    for k in range(1, len(nets) + 1):
        for c in itertools.combinations(range(len(nets)), k):
            if 0 <= target - sum(nets[i] for i in c) <= k:
                found.append(set(c))
    return [f for f in found if not any(g < f for g in found)]


def test_solver_against_all_subsets():
    import random

    rng = random.Random(4)
    for _ in range(150):
        nets = [rng.randint(1, 60) for _ in range(rng.randint(1, 9))]
        target = rng.randint(1, 200)
        verdict, found, exhaustive, density = solver.explain(nets, target, listed=10_000)
        for f in found:
            assert 0 <= target - sum(nets[i] for i in f) <= len(f)
        want = brute(nets, target)
        assert (verdict == "CONTRADICTED") == (not want) and exhaustive and 0 <= density <= 1
        assert (verdict == "PROVEN") == (len(found) == 1)
    one_way, many = solver.counts([1, 2, 3], 6)
    ways = [sum(1 for k in range(4) for c in itertools.combinations([1, 2, 3], k) if sum(c) == s) for s in range(7)]
    assert [(one_way >> s & 1, many >> s & 1) for s in range(7)] == [(w == 1, w > 1) for w in ways]


def test_solver_refuses_what_is_too_large():
    assert solver.explain([5] * 1000, 100)[0] == "INSUFFICIENT"
    assert solver.explain([1], 30_000_000)[0] == "INSUFFICIENT"
    assert solver.explain([], 5)[0] == solver.explain([3], -1)[0] == "CONTRADICTED"


def payouts(spark, *rows):
    return spark.createDataFrame(rows, "settlement_id string, settled_on string, net_paise long").withColumn("settled_on", F.col("settled_on").cast("date"))


def orders(spark, *rows):
    return spark.createDataFrame(rows, "order_id string, captured_on string, gross_paise long, net_paise long, method string").withColumn("captured_on", F.col("captured_on").cast("date"))


def test_findings_exceptions_and_kernel(spark):
    o = orders(spark, ("a", "2026-05-04", 100, 100, "upi"), ("b", "2026-05-04", 200, 200, "upi"), ("c", "2026-05-04", 200, 200, "upi"), ("d", "2026-05-05", 900, 900, "upi"))
    p = payouts(spark, ("s1", "2026-05-06", 100), ("s2", "2026-05-06", 200), ("s3", "2026-05-06", 5000), ("s4", "2026-05-06", 300), ("s5", "2026-05-12", 70))
    found = findings.single_order_findings(p, o)
    got = {r.settlement_id: r.verdict for r in found.collect()}
    assert got == {"s1": "PROVEN", "s2": "AMBIGUOUS", "s3": "CONTRADICTED", "s4": "INSUFFICIENT", "s5": "CONTRADICTED"}
    reasons = {r.settlement_id: (r.reason, r.unexplained_paise, r.severity) for r in findings.exceptions(found).collect()}
    assert reasons["s1"] == ("SEARCH_SPACE_UNCERTAIN", 0, "LOW") and reasons["s2"] == ("MULTIPLE_VALID_ASSIGNMENTS", 400, "HIGH") and reasons["s3"] == ("MISSING_TRANSACTION", 4500, "HIGH")
    space = {r.settlement_id: r for r in blocking.search_space(p, o).collect()}
    assert all(r.universe - r.removed_by_date - r.removed_by_amount == r.candidates for r in space.values())
    solved = {r.settlement_id: (r.verdict, r.order_ids) for r in solver.solved(p, o).collect()}
    assert solved["s1"] == ("PROVEN", ["a"]) and solved["s4"][0] == "AMBIGUOUS" and solved["s5"] == ("CONTRADICTED", [])
    members = spark.createDataFrame([("s1", "a"), ("s2", "b"), ("s2", "b"), ("s3", "zz"), ("s4", "a"), ("s4", "b")], "settlement_id string, order_id string")
    checked = {r.settlement_id: r.reason for r in kernel.check(kernel.proofs(members, o, p)).collect()}
    assert checked == {"s1": "OK", "s2": "DUPLICATE_ORDER", "s3": "UNKNOWN_ORDER", "s4": "OK"}
    moved = {r.settlement_id: r.direction for r in changes.diff(found, findings.single_order_findings(p, o.where("order_id <> 'c'"))).collect()}
    assert moved["s2"] == "RESOLVED" and moved["s1"] == "UNCHANGED"


def test_references_win_over_amounts(spark):
    p = payouts(spark, ("s1", "2026-05-06", 100), ("s2", "2026-05-06", 100), ("s3", "2026-05-06", 300)).withColumn("utr", F.when(F.col("settlement_id") == "s2", "123456789012"))
    bank = spark.createDataFrame([("t1", "2026-05-06", 999, "NEFT-111111111-123456789012-X"), ("t2", "2026-05-06", 300, "neft 12xx"), ("t3", "2026-05-06", 100, "none")], "txn_id string, value_date string, credit_paise long, narration string").withColumn("value_date", F.col("value_date").cast("date"))
    got = {r.txn_id: (r.settlement_id, r.via) for r in matching.credit_to_payout(bank, p).collect()}
    assert got == {"t1": ("s2", "reference"), "t2": ("s3", "amount"), "t3": (None, "none")}


@pytest.mark.parametrize(("wrong", "total", "upper"), [(1, 152, 0.03632), (0, 104, 0.03562), (1, 19, 0.24639), (0, 0, 1.0)])
def test_wilson(spark, wrong, total, upper):
    assert one(spark, policy.wilson_upper(F.lit(wrong), F.lit(total))) == pytest.approx(upper, abs=1e-5)


def test_materiality_bounds(spark):
    bound = Bound(100, 10_000, 10_000_000)
    for total, allowed, governing in ((0, 10_000, "FLOOR"), (1_000_000, 10_000, "FLOOR"), (1_000_100, 10_001, "PERCENTAGE"), (2_000_000_000, 10_000_000, "CEILING")):
        assert (one(spark, bound.allowed(F.lit(total).cast("long"))), one(spark, bound.governing(F.lit(total).cast("long")))) == (allowed, governing)


def test_advice(spark):
    tries = spark.createDataFrame([("s", ["a"]), ("s", ["b"]), ("s", ["z"])], "settlement_id string, anchor array<string>")
    known = spark.createDataFrame([("s", ["a", "b"]), ("s", ["b", "c"])], "settlement_id string, order_ids array<string>")
    assert {r.anchor[0]: r.outcome for r in advice.falsify(tries, known).collect()} == {"a": "CONFIRMED", "b": "UNIQUENESS", "z": "CONSISTENCY"}
    said = spark.createDataFrame([(1, "setl_1 and setl_2"), (2, "nothing"), (3, "setl_9")], "statement_id long, text string")
    ok = advice.grounded(said, spark.createDataFrame([("setl_1",), ("setl_2",)], "settlement_id string"))
    assert {r.statement_id: (r.n_refs, r.ok) for r in ok.collect()} == {1: (2, True), 2: (0, True), 3: (1, False)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry_and_registry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() >= 1
    assert set(driver.oracle_sql()) <= set(driver.queries())
    lines = driver.queries()["journal_balance"](spark, SF).agg(F.sum("debit_paise").alias("d"), F.sum("credit_paise").alias("c")).first()
    assert lines.d == lines.c
