import json
import os

from pyspark.sql import functions as F

from tallymark.streaming import boundary, events

HANDLED = ("paid", "settled")
ROWS = [
    ("g", "1", "paid", "a", 1), ("g", "1", "paid", "a", 2), ("g", "1", "paid", "b", 3), ("h", "1", "paid", "b", 4),
    ("g", "2", "odd", "x", 5), ("g", "2", "odd", "x", 6), ("g", "3", "settled", "", 7),
]
WANT = {1: "ACCEPTED", 2: "DUPLICATE", 3: "REPLAY_MISMATCH", 4: "ACCEPTED", 5: "UNSUPPORTED", 6: "DUPLICATE", 7: "ACCEPTED"}
SCHEMA = "provider string, event_id string, kind string, body string, arrival long"


def test_batch(spark):
    got = events.classified(spark.createDataFrame(ROWS, SCHEMA), HANDLED)
    assert {r.arrival: r.status for r in got.collect()} == WANT


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k, part in enumerate((ROWS[:2], ROWS[2:5], ROWS[5:])):
        (source / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("provider", "event_id", "kind", "body", "arrival"), r, strict=True))) for r in part))
        os.utime(source / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # a stream takes files by age; equal ages come in any order
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(source))
    log = events.stream(rows, HANDLED).writeStream.format("memory").queryName("logged").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    log.awaitTermination(120)
    got = {r.arrival: r.status for r in spark.table("logged").collect()}
    assert got == WANT


def test_affected_payouts(spark):
    logged = events.classified(spark.createDataFrame(ROWS, SCHEMA), HANDLED)
    members = spark.createDataFrame([("1", "s1"), ("3", "s1"), ("2", "s2")], "order_key string, settlement_id string")
    got = {r.settlement_id: (r.n_events, r.last_kind) for r in events.affected(logged, members, F.col("event_id")).collect()}
    assert got == {"s1": (2, "settled")}


def test_ties_and_equal_rows(spark):
    """Of bodies that arrive together one is first, of equal rows one; null keys count."""
    rows = [("p", "1", "k", "b", 5), ("p", "1", "k", "a", 5), ("p", "1", "k", "a", 5), ("p", "1", "k", "b", 6), ("p", None, "k", "x", 1), ("p", None, "k", "x", 2), (None, None, "k", "x", 1), ("p", "2", "odd", "x", 1), ("p", "2", None, "x", 0)]
    got = events.classified(spark.createDataFrame(rows, "provider string, event_id string, kind string, body string, arrival long"), ("k",)).collect()
    assert len(got) == len(rows)
    by_key = {}
    for r in sorted(got, key=lambda r: (str(r.provider), str(r.event_id), r.arrival, r.digest, str(r.kind))):
        by_key.setdefault((r.provider, r.event_id), []).append(r.status)
    first = sorted(by_key["p", "1"])
    assert first == ["ACCEPTED", "DUPLICATE", "REPLAY_MISMATCH", "REPLAY_MISMATCH"]
    assert by_key["p", None] == ["ACCEPTED", "DUPLICATE"] and by_key[None, None] == ["ACCEPTED"]
    assert by_key["p", "2"] == ["UNSUPPORTED", "DUPLICATE"]
    assert events.classified(spark.createDataFrame([], "provider string, event_id string, kind string, body string, arrival long"), ("k",)).count() == 0


def test_no_plan_shows_the_key(spark):
    secret = b"a key that nobody should read"
    own = spark.createDataFrame([("p", "{}", "s", 1)], "provider string, body string, signature string, arrival long")
    plan = boundary.received(own, secret)._jdf.queryExecution().toString()
    pads = [bytes(b ^ pad for b in secret).hex().upper() for pad in (0, 0x36, 0x5C)]
    assert not any(p in plan.upper() for p in pads) and "NOBODY" not in plan.upper()
