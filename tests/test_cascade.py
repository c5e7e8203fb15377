import itertools
import random

from pyspark.sql import functions as F

from tallymark.operators import cascade, setpacking


def test_cascade_consumes_and_widens(spark):
    orders = spark.createDataFrame([("a", "2026-05-04", 100), ("b", "2026-05-04", 250), ("c", "2026-05-05", 400), ("d", "2026-05-04", 77)], "order_id string, captured_on string, net_paise long").withColumn("captured_on", F.col("captured_on").cast("date"))
    orders = orders.withColumn("gross_paise", F.col("net_paise")).withColumn("method", F.lit("upi"))
    payouts = spark.createDataFrame([("s1", "2026-05-06", 100), ("s2", "2026-05-06", 100), ("s3", "2026-05-08", 400), ("s4", "2026-05-06", 9_000), ("s5", "2026-05-06", 327)], "settlement_id string, settled_on string, net_paise long").withColumn("settled_on", F.col("settled_on").cast("date"))
    got = {r.settlement_id: r for r in cascade.cascade(payouts, orders).collect()}
    assert {k: (r.verdict, r.order_ids) for k, r in got.items()} == {"s1": ("PROVEN", ["a"]), "s2": ("CONTRADICTED", []), "s3": ("PROVEN", ["c"]), "s4": ("CONTRADICTED", []), "s5": ("PROVEN", ["b", "d"])}
    assert got["s1"].rung == 0 and got["s3"].rung == 1
    used = [o for r in got.values() if r.verdict == "PROVEN" for o in r.order_ids]
    assert len(used) == len(set(used))


def test_propagation(spark):
    rows = [("s1", 0, ["a"]), ("s2", 0, ["a", "b"]), ("s2", 1, ["c"]), ("s3", 0, ["c"]), ("s3", 1, ["d"]), ("s4", 0, ["x"]), ("s4", 1, ["y"])]
    got = {r.settlement_id: r.verdict for r in cascade.propagated(spark.createDataFrame(rows, "settlement_id string, explanation long, order_ids array<string>")).collect()}
    assert got == {"s1": "PROVEN", "s2": "PROVEN", "s3": "PROVEN", "s4": "AMBIGUOUS"}


def test_packing_against_all_choices():
    rng = random.Random(8)
    for _ in range(60):
        rows = [(f"s{rng.randrange(4)}", rng.randint(1, 50), frozenset(rng.sample("abcdef", rng.randint(1, 3)))) for _ in range(rng.randint(1, 7))]
        top = (0, 0)
        for k in range(len(rows) + 1):
            for c in itertools.combinations(range(len(rows)), k):
                used = [o for i in c for o in rows[i][2]]
                if len({rows[i][0] for i in c}) == k and len(used) == len(set(used)):
                    top = max(top, (k, sum(rows[i][1] for i in c)))
        score, chosen, whole = setpacking.best(rows)
        assert whole
        assert score == top == (len(chosen), sum(rows[i][1] for i in chosen))


def test_packed_components(spark):
    rows = [("s1", 0, 10, ["a"]), ("s1", 1, 10, ["b"]), ("s2", 0, 5, ["a"]), ("s3", 0, 7, ["z"])]
    got = {(r.settlement_id, r.explanation): r for r in setpacking.packed(spark.createDataFrame(rows, "settlement_id string, explanation long, net_paise long, order_ids array<string>")).collect()}
    assert {k for k, r in got.items() if r.chosen} == {("s1", 1), ("s2", 0), ("s3", 0)} == {k for k, r in got.items() if r.forced}
    assert got["s1", 0].component == got["s2", 0].component != got["s3", 0].component
