"""Queries at the boundary: signed deliveries, the synthetic portfolio, reviews, requests, replays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators import advice, blocking, evidence, review
from tallymark.plans.close_queries import _JUDGED, _judged
from tallymark.plans.evidence_queries import _EXPLAINED, _explained
from tallymark.plans.recon_queries import FINDINGS, base, findings_of
from tallymark.sources import portfolio
from tallymark.sources.views import SQL as VIEWS
from tallymark.streaming import boundary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def take(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return take


# Deliveries with nested payloads; some unsigned, some wrongly signed, some no JSON, some again, some changed.
SECRET = b"shared secret of the test deliveries"
_IPAD, _OPAD = (bytes(b ^ pad for b in SECRET.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
_SENT = f"""WITH plain AS (
    SELECT event_id AS k, event_id AS arrival, CASE WHEN event_id % 31 = 7 THEN '[1]' ELSE '{{"event": "' || CASE event_type WHEN 'purchase' THEN 'payment.captured' WHEN 'click' THEN 'refund.created' WHEN 'signup' THEN 'settlement.processed' ELSE event_type END
        || '", "id": "evt_' || event_id || '", "payload": {{"payment": {{"entity": {{"order_id": "ord_' || user_id || '", "amount": 5}}}}, "items": [{{"settlement_id": "setl_' || event_id % 50 || '"}}]}}}}' END AS body FROM events
), several AS (
    SELECT * FROM plain UNION ALL SELECT k, arrival + 1000000, body FROM plain WHERE k % 10 = 1 UNION ALL SELECT k, arrival + 2000000, replace(body, '"amount": 5', '"amount": 6') FROM plain WHERE k % 25 = 1
), hashed AS (SELECT *, sha256(from_hex('{_OPAD}') || from_hex(sha256(from_hex('{_IPAD}') || encode(body)))) AS hmac FROM several
), sent AS (SELECT 'gateway' AS provider, k, arrival, body, CASE WHEN k % 13 = 3 THEN NULL WHEN k % 17 = 5 THEN 'bad' ELSE hmac END AS signature, hmac FROM hashed
), named AS (
    SELECT provider, arrival, body, coalesce(CASE WHEN body <> '[1]' THEN json_extract_string(body, '$.id') END, substr(sha256(body), 1, 24)) AS event_id, coalesce(CASE WHEN body <> '[1]' THEN json_extract_string(body, '$.event') END, 'unknown') AS kind,
        CASE WHEN signature IS NULL OR signature <> hmac OR body = '[1]' THEN 'bad_signature' END AS checked FROM sent
), firsts AS (SELECT event_id, min(arrival) AS first_arrival, arg_min(body, arrival) AS first_body FROM named WHERE checked IS NULL GROUP BY event_id
), logged AS (
    SELECT provider, n.event_id, kind, arrival, body, CASE WHEN checked IS NOT NULL THEN checked WHEN arrival > first_arrival THEN CASE WHEN body = first_body THEN 'duplicate' ELSE 'replay_mismatch' END
        WHEN kind NOT IN ('payment.captured', 'refund.created', 'settlement.processed') THEN 'unsupported' ELSE 'accepted' END AS status FROM named n LEFT JOIN firsts f ON f.event_id = n.event_id
)"""


def signed_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    kind = F.when(F.col("event_type") == "purchase", "payment.captured").when(F.col("event_type") == "click", "refund.created").when(F.col("event_type") == "signup", "settlement.processed").otherwise(F.col("event_type"))
    body = F.concat(F.lit('{"event": "'), kind, F.lit('", "id": "evt_'), k.cast("string"), F.lit('", "payload": {"payment": {"entity": {"order_id": "ord_'), F.col("user_id").cast("string"), F.lit('", "amount": 5}}, "items": [{"settlement_id": "setl_'), F.pmod(k, F.lit(50)).cast("string"), F.lit('"}]}}'))
    plain = spark.read.parquet(f"{sf_dir}/events.parquet").select(k.alias("k"), k.cast("long").alias("arrival"), F.when(F.pmod(k, F.lit(31)) == 7, "[1]").otherwise(body).alias("body"))
    again = plain.where(F.pmod("k", F.lit(10)) == 1).withColumn("arrival", F.col("arrival") + 1_000_000)
    changed = plain.where(F.pmod("k", F.lit(25)) == 1).withColumn("arrival", F.col("arrival") + 2_000_000).withColumn("body", F.replace("body", F.lit('"amount": 5'), F.lit('"amount": 6')))
    rows = plain.unionByName(again).unionByName(changed)
    signature = F.when(F.pmod("k", F.lit(13)) == 3, F.lit(None).cast("string")).when(F.pmod("k", F.lit(17)) == 5, "bad").otherwise(boundary.hmac_sha256(F.col("body"), SECRET))
    return rows.select(F.lit("gateway").alias("provider"), "body", signature.alias("signature"), "arrival")


@query(_SENT + "SELECT * FROM logged")
def signed_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary.received(signed_deliveries(spark, sf_dir), SECRET)


@query(_SENT + """, late AS (SELECT arrival, kind, unnest([json_extract_string(body, '$.id'), json_extract_string(body, '$.payload.payment.entity.order_id'), json_extract_string(body, '$.payload.items[0].settlement_id')]) AS entity FROM logged WHERE status = 'accepted' AND arrival > 500)
SELECT entity, count(*) AS n_events, arg_max(kind, (arrival, kind)) AS last_kind FROM late GROUP BY entity""")
def stale_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary.owed(boundary.received(signed_deliveries(spark, sf_dir), SECRET), 500)


_N, _SEED = 5_000, 20260821


def _turn_sql(*parts: str, of: int) -> str:
    out = "CAST(7 AS BIGINT)"
    for p in parts:
        out = f"((({out} * 48271 + CAST({p} AS BIGINT) * 69621 + 12345) * 1103) % 2147483647)"
    return f"({out} % {of})"


def _case_sql() -> str:
    upto, out = 0, []
    for name, share in portfolio.MIX.items():
        upto += share
        out.append(f"WHEN roll < {upto} THEN '{name}'")
    return "CASE " + " ".join(out) + " END"


_GENERATED = f"""WITH rolled AS (SELECT range AS payout, {_turn_sql("range", str(_SEED), "1", of=100)} AS roll FROM range({_N})
), cased AS (SELECT payout, {_case_sql()} AS "case" FROM rolled
), payouts AS (
    SELECT *, CAST(DATE '{portfolio.START}' + CAST(CASE WHEN "case" = 'month_boundary' THEN 27 + {_turn_sql("payout", str(_SEED), "3", of=4)} ELSE {_turn_sql("payout", str(_SEED), "3", of=portfolio.DAYS)} END AS INTEGER) AS DATE) AS captured_on,
        CASE "case" WHEN 'clean' THEN 1 + {_turn_sql("payout", str(_SEED), "2", of=6)} WHEN 'bundle_large' THEN 20 + {_turn_sql("payout", str(_SEED), "2", of=21)} WHEN 'ambiguous_subset' THEN 3 + {_turn_sql("payout", str(_SEED), "2", of=3)} ELSE 3 + {_turn_sql("payout", str(_SEED), "2", of=10)} END AS n_orders FROM cased
), placed AS (SELECT *, unnest(range(n_orders)) AS place FROM payouts
), drawn AS (
    SELECT *, {_turn_sql("payout", "place", str(_SEED), "4", of=100)} AS pick, {portfolio.GROSS[0]} + {_turn_sql("payout", "CASE WHEN \"case\" = 'duplicate_amount' AND place = 1 THEN 0 ELSE place END", str(_SEED), "5", of=portfolio.GROSS[1] - portfolio.GROSS[0])} AS gross_paise FROM placed
), methods AS (
    SELECT *, CASE WHEN "case" = 'mixed_method' THEN ['upi', 'card', 'wallet'][place % 3 + 1] WHEN "case" = 'duplicate_amount' AND place < 2 THEN 'upi' WHEN pick < 55 THEN 'upi' WHEN pick < 80 THEN 'card' WHEN pick < 92 THEN 'netbanking' ELSE 'wallet' END AS method FROM drawn
), fees AS (SELECT *, (gross_paise * CASE method WHEN 'upi' THEN 0 WHEN 'card' THEN 200 WHEN 'netbanking' THEN 150 ELSE 250 END + 5000) // 10000 AS fee FROM methods
), orders AS (
    SELECT 'ord_' || lpad(CAST(payout * 64 + place AS VARCHAR), 9, '0') AS order_id, payout, place, captured_on, gross_paise, method,
        CASE WHEN NOT ("case" = 'missing_ref' AND {_turn_sql("payout", "place", str(_SEED), "6", of=100)} < 60) THEN 'pay_' || (payout * 64 + place) END AS payment_id, gross_paise - fee - (fee * 1800 + 5000) // 10000 AS net_paise FROM fees
)"""


def _portfolio(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    own = portfolio.payouts_of(spark, _N, _SEED)
    return own, portfolio.orders_of(own, _SEED)


@query(_GENERATED + "SELECT * FROM orders")
def generated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _portfolio(spark)[1]


@query(_GENERATED + f""", sums AS (SELECT payout, CAST(sum(net_paise) AS BIGINT) AS clean, arg_max(net_paise, place) AS last_net FROM orders GROUP BY payout
), joined AS (SELECT p.*, clean, last_net, lpad(CAST(100000000000 + {_turn_sql("payout", str(_SEED), "10", of=899_999_999)} AS VARCHAR), 12, '0') AS utr FROM payouts p JOIN sums USING (payout))
SELECT 'setl_' || lpad(CAST(payout AS VARCHAR), 6, '0') AS settlement_id, "case", net_paise, utr FROM (SELECT *, CAST(clean + CASE "case" WHEN 'split_order' THEN -(last_net // 2) WHEN 'refund_offset' THEN -least(5000 + {_turn_sql("payout", str(_SEED), "7", of=145_000)}, greatest(5000, clean // 3))
    WHEN 'chargeback_reversal' THEN -({portfolio.GROSS[0]} + {_turn_sql("payout", str(_SEED), "8", of=portfolio.GROSS[1] - portfolio.GROSS[0])}) WHEN 'orphan_settlement' THEN {portfolio.GROSS[0]} + {_turn_sql("payout", str(_SEED), "9", of=portfolio.GROSS[1] - portfolio.GROSS[0])} ELSE 0 END AS BIGINT) AS net_paise FROM joined)""")
def generated_settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.settled(*_portfolio(spark), _SEED).select("settlement_id", "case", "net_paise", "utr")


# Reviewers' actions made of orders: who and why is blank for some.
_ACTED = "WITH actions AS (SELECT CAST(o_custkey AS VARCHAR) AS item_id, o_orderkey AS seq, CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(review.ACTIONS)) + """ ELSE 'CLOSE_IT' END AS action, CASE WHEN o_orderkey % 11 = 4 THEN ' ' ELSE 'reviewer_' || o_orderkey % 5 END AS reviewer,
        CASE WHEN o_orderkey % 12 = 5 THEN NULL ELSE 'because of ' || o_orderpriority END AS justification FROM orders
), recorded AS (
    SELECT item_id, seq, action, CASE WHEN trim(coalesce(reviewer, '')) = '' THEN 'BLANK_REVIEWER' WHEN trim(coalesce(justification, '')) = '' THEN 'BLANK_JUSTIFICATION' WHEN action = 'CLOSE_IT' THEN 'UNKNOWN_ACTION' END AS error, reviewer, justification FROM actions
), log AS (
    SELECT item_id, seq, action, error, CASE WHEN error IS NULL THEN CASE action WHEN 'DEFER_REVIEW' THEN 'DEFERRED' WHEN 'ASSIGN_REVIEWER' THEN 'IN_REVIEW' ELSE 'ACTIONED' END END AS status,
        CASE WHEN error IS NULL THEN sha256(item_id || '|' || seq || '|' || action || '|' || reviewer || '|' || justification) END AS record_hash FROM recorded
)"""


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    action = F.lit("CLOSE_IT")
    for i, a in enumerate(review.ACTIONS):
        action = F.when(F.pmod(k, F.lit(9)) == i, a).otherwise(action)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_custkey").cast("string").alias("item_id"), k.alias("seq"), action.alias("action"), F.when(F.pmod(k, F.lit(11)) == 4, " ").otherwise(F.concat(F.lit("reviewer_"), F.pmod(k, F.lit(5)).cast("string"))).alias("reviewer"),
        F.when(F.pmod(k, F.lit(12)) != 5, F.concat(F.lit("because of "), "o_orderpriority")).alias("justification"),
    )


@query(_ACTED + "SELECT * FROM log")
def review_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.recorded(_actions(spark, sf_dir))


@query(_ACTED + "SELECT CAST(c_custkey AS VARCHAR) AS item_id, coalesce(s.status, 'PENDING') AS status, coalesce(n, 0) AS n_actions FROM customer LEFT JOIN (SELECT item_id, arg_max(status, seq) AS status, count(*) AS n FROM log WHERE error IS NULL GROUP BY item_id) s ON s.item_id = CAST(c_custkey AS VARCHAR)")
def review_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("item_id"))
    return review.latest(items, review.recorded(_actions(spark, sf_dir)))


#: Agents of the example requests and what they hold.
ROSTER = {"reconciliation": ("read_orders", "read_settlements", "run_solver", "explain"), "investigation": ("read_orders", "read_evidence", "search_evidence", "propose_hypothesis", "run_solver", "create_investigation", "recommend")}


@query(_JUDGED + """, requests AS (
    SELECT settlement_id AS request_id, CASE n % 3 WHEN 0 THEN 'reconciliation' WHEN 1 THEN 'investigation' ELSE 'nobody' END AS agent, CASE n % 5 WHEN 0 THEN 'run_solver' WHEN 1 THEN 'explain' WHEN 2 THEN 'recommend' WHEN 3 THEN 'post_accounting_entry' ELSE 'read_orders' END AS capability,
        CASE WHEN n % 7 <> 2 THEN settlement_id END AS evidence, verdict, verdict = 'PROVEN' AND n % 11 <> 5 AS postable, decision FROM (SELECT *, CAST(substr(settlement_id, 6) AS BIGINT) AS n FROM judged)
), staged AS (
    SELECT *, CASE WHEN NOT (agent = 'reconciliation' AND capability IN ('read_orders', 'run_solver', 'explain') OR agent = 'investigation' AND capability IN ('read_orders', 'run_solver', 'recommend')) THEN 'CAPABILITY' WHEN evidence IS NULL THEN 'EVIDENCE' WHEN NOT postable THEN 'VERIFICATION' WHEN decision <> 'AUTO_POST' THEN 'POLICY' ELSE 'ACTION' END AS stage FROM requests
) SELECT request_id, agent, capability, stage, stage = 'ACTION' AS eligible FROM staged""")
def capability_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring("settlement_id", 6, 20).cast("long")

    def one_of(of: int, *names: str) -> F.Column:
        return F.element_at(F.array(*map(F.lit, names)), (F.pmod(n, F.lit(of)) + 1).cast("int"))

    requests = _judged(spark, sf_dir)[1].select(
        F.col("settlement_id").alias("request_id"), one_of(3, "reconciliation", "investigation", "nobody").alias("agent"), one_of(5, "run_solver", "explain", "recommend", "post_accounting_entry", "read_orders").alias("capability"),
        F.when(F.pmod(n, F.lit(7)) != 2, F.col("settlement_id")).alias("evidence"), "verdict", ((F.col("verdict") == "PROVEN") & (F.pmod(n, F.lit(11)) != 5)).alias("postable"), "decision",
    )
    return review.requested(requests, spark.createDataFrame([(a, list(c)) for a, c in ROSTER.items()], "agent string, capabilities array<string>"))


_ANCHORS = """, days AS (SELECT settlement_id, captured_on, count(*) AS n FROM pool GROUP BY ALL), first_days AS (SELECT settlement_id, captured_on FROM days QUALIFY row_number() OVER (PARTITION BY settlement_id ORDER BY n DESC, captured_on) = 1
), anchors AS (SELECT e.settlement_id, min(e.order_id) AS anchor FROM explained e JOIN pool p USING (settlement_id, order_id) JOIN first_days d ON d.settlement_id = e.settlement_id AND d.captured_on = p.captured_on GROUP BY e.settlement_id
)"""


@query(_EXPLAINED + _ANCHORS + """, tested AS (SELECT a.settlement_id, a.anchor, count(DISTINCT e.explanation) FILTER (e.order_id = a.anchor) AS n FROM anchors a JOIN explained e USING (settlement_id) GROUP BY ALL)
SELECT settlement_id, anchor, CASE WHEN n = 0 THEN 'CONSISTENCY' WHEN n > 1 THEN 'UNIQUENESS' ELSE 'CONFIRMED' END AS outcome FROM tested""")
def falsified_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order of the densest capture day of each explained payout as a hypothesis, tested."""
    orders, payouts = base(spark, sf_dir)
    explained = _explained(spark, sf_dir)
    day = evidence.densest_days(blocking.pool_days(payouts, orders), 1).select("settlement_id", "captured_on")
    anchors = blocking.held(explained.select("settlement_id", "order_id").distinct(), payouts, orders).join(day, ["settlement_id", "captured_on"]).groupBy("settlement_id").agg(F.array(F.min("order_id")).alias("anchor"))
    sets = explained.select("settlement_id", "explanation").distinct().select("settlement_id", F.split("explanation", " ").alias("order_ids"))
    return advice.falsify(anchors, sets).select("settlement_id", F.col("anchor")[0].alias("anchor"), "outcome")


@query(VIEWS + FINDINGS + r""", statements AS (SELECT settlement_id AS statement_id, 'Payout ' || settlement_id || ' looks like setl_' || lpad(CAST(truth_key * 2 AS VARCHAR), 6, '0') || CASE WHEN truth_key % 3 = 0 THEN ' and setl_x' ELSE '' END AS text FROM settlements
), refs AS (SELECT statement_id, unnest(regexp_extract_all(text, '(setl_\d+)', 1)) AS ref FROM statements)
SELECT statement_id, count(*) AS n_refs, count(*) FILTER (s.settlement_id IS NULL) AS n_unknown, count(*) FILTER (s.settlement_id IS NULL) = 0 AS ok FROM refs LEFT JOIN settlements s ON s.settlement_id = ref GROUP BY statement_id""")
def grounded_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    payouts = base(spark, sf_dir)[1]
    text = F.concat(F.lit("Payout "), "settlement_id", F.lit(" looks like setl_"), F.lpad((F.col("truth_key") * 2).cast("string"), 6, "0"), F.when(F.pmod("truth_key", F.lit(3)) == 0, " and setl_x").otherwise(""))
    return advice.grounded(payouts.select(F.col("settlement_id").alias("statement_id"), text.alias("text")), payouts)


def _money(paise: str) -> str:
    return f"'Rs. ' || (abs({paise}) // 100) || '.' || lpad(CAST(abs({paise}) % 100 AS VARCHAR), 2, '0')"


@query(VIEWS + FINDINGS + f""", told AS (
    SELECT settlement_id AS statement_id, 'paid ' || {_money("net_paise")} || ' of ' || {_money("net_paise - pool_net")} || ', about ' || {_money("(abs(net_paise) // 100) * 100 + truth_key % 3")} || ' and Rs 0.50' AS text
    FROM findings JOIN (SELECT settlement_id, truth_key FROM settlements) USING (settlement_id)
), named AS (
    SELECT statement_id, unnest(regexp_extract_all(text, '(?:₹|Rs\\.?\\s*)([0-9,]+(?:\\.[0-9]{{2}})?)', 1)) AS said, generate_subscripts(regexp_extract_all(text, '(?:₹|Rs\\.?\\s*)([0-9,]+(?:\\.[0-9]{{2}})?)', 1), 1) - 1 AS place FROM told
), amounts AS (SELECT statement_id, place, CAST(round(CAST(replace(said, ',', '') AS DECIMAL(30, 2)) * 100) AS BIGINT) AS paise FROM named
), held AS (SELECT DISTINCT statement_id, unnest([abs(p), abs(p) // 100]) AS v FROM (SELECT settlement_id AS statement_id, unnest([net_paise, pool_net, fit_gross]) AS p FROM findings) WHERE p IS NOT NULL
), valid AS (SELECT statement_id, v FROM held UNION SELECT a.statement_id, unnest([a.v - b.v, (a.v - b.v) // 100]) FROM held a JOIN held b ON a.statement_id = b.statement_id AND a.v >= b.v)
SELECT statement_id, CAST(place AS INTEGER) AS place, paise, paise <= 100 OR EXISTS (SELECT 1 FROM valid v WHERE v.statement_id = a.statement_id AND (v.v = a.paise OR v.v = a.paise // 100)) AS ok FROM amounts a""")
def grounded_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts that statements on payouts name, against the payouts' own."""
    payouts, found = base(spark, sf_dir)[1], findings_of(spark, sf_dir)

    def money_of(paise: Column) -> Column:
        size = F.abs(paise)
        return F.concat(F.lit("Rs. "), F.floor(size / 100).cast("string"), F.lit("."), F.lpad(F.pmod(size, F.lit(100)).cast("string"), 2, "0"))

    own = found.join(payouts.select("settlement_id", "truth_key"), "settlement_id")
    net = F.col("net_paise")
    text = F.concat(F.lit("paid "), money_of(net), F.lit(" of "), money_of(net - F.col("pool_net")), F.lit(", about "), money_of(F.floor(F.abs(net) / 100) * 100 + F.pmod("truth_key", F.lit(3))), F.lit(" and Rs 0.50"))
    facts = found.select(F.col("settlement_id").alias("statement_id"), F.explode(F.array("net_paise", "pool_net", "fit_gross")).alias("paise"))
    return advice.grounded_amounts(own.select(F.col("settlement_id").alias("statement_id"), text.alias("text")), facts)


@query(VIEWS + FINDINGS.replace("findings AS (", "findings AS MATERIALIZED (") + """, again AS MATERIALIZED (SELECT * FROM findings ORDER BY settlement_id DESC)
SELECT (SELECT count(*) FROM (SELECT * FROM findings EXCEPT ALL SELECT * FROM again)) AS missing, (SELECT count(*) FROM (SELECT * FROM again EXCEPT ALL SELECT * FROM findings)) AS added""")
def replay_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings made twice from the source, each run's rows that the other lacks: none if runs repeat."""
    first, second = findings_of(spark, sf_dir), findings_of(spark, sf_dir)
    missing, added = first.exceptAll(second).agg(F.count("*").alias("missing")), second.exceptAll(first).agg(F.count("*").alias("added"))
    return missing.crossJoin(added)  # two rows of one number
