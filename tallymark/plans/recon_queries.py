"""Reconciliation queries: fees, calendar, blocking, matching, findings, policy, journal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import calendar as cal
from tallymark.functions import money
from tallymark.operators import blocking, findings, kernel, matching
from tallymark.sources import views
from tallymark.sources.shared import once, stored
from tallymark.sources.views import SQL as VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_DATES = views._sql_bizadd
#: Pools of rung 0, the single-order findings and their exceptions, after the views.
POOLS = f""", dated AS (
    SELECT *, {_DATES("captured_on", "2")} AS pool_day FROM captures
), pool AS MATERIALIZED (
    SELECT s.settlement_id, s.net_paise AS credit_paise, c.* FROM settlements s JOIN dated c ON c.pool_day = s.settled_on AND c.net_paise > 0 AND c.net_paise <= s.net_paise
)"""
FINDINGS = (
    POOLS
    + """, windows AS (SELECT pool_day, count(*) AS in_window FROM dated GROUP BY pool_day
), inside AS (SELECT settlement_id, count(*) AS candidates, CAST(sum(net_paise) AS BIGINT) AS pool_net FROM pool GROUP BY settlement_id
), space AS (
    SELECT s.settlement_id, u.universe, u.universe - coalesce(w.in_window, 0) AS removed_by_date, coalesce(w.in_window, 0) - coalesce(i.candidates, 0) AS removed_by_amount,
        coalesce(i.candidates, 0) AS candidates, coalesce(i.pool_net, 0) AS pool_net, 'HEURISTIC' AS integrity
    FROM settlements s LEFT JOIN windows w ON w.pool_day = s.settled_on LEFT JOIN inside i USING (settlement_id), (SELECT count(*) AS universe FROM captures) u
), fits AS (
    SELECT settlement_id, count(*) AS n_fits, min(order_id) AS order_id, CAST(sum(net_paise) AS BIGINT) AS fit_net, CAST(sum(gross_paise) AS BIGINT) AS fit_gross, min(method) AS method
    FROM pool WHERE abs(net_paise - credit_paise) <= 1 GROUP BY settlement_id
), findings AS (
    SELECT s.settlement_id, s.settled_on, s.net_paise,
        CASE WHEN coalesce(f.n_fits, 0) = 1 THEN 'PROVEN' WHEN coalesce(f.n_fits, 0) > 1 THEN 'AMBIGUOUS' WHEN p.pool_net < s.net_paise - 1 THEN 'CONTRADICTED' ELSE 'INSUFFICIENT' END AS verdict,
        coalesce(f.n_fits, 0) AS n_fits, CASE WHEN f.n_fits = 1 THEN f.order_id END AS order_id, f.fit_net, f.fit_gross, CASE WHEN f.n_fits = 1 THEN f.method END AS method, p.candidates, p.pool_net, p.integrity, CAST(NULL AS DOUBLE) AS density
    FROM settlements s JOIN space p USING (settlement_id) LEFT JOIN fits f USING (settlement_id)
), exceptions0 AS (
    SELECT settlement_id, settled_on, verdict, net_paise AS amount_paise,
        CASE verdict WHEN 'PROVEN' THEN 'SEARCH_SPACE_UNCERTAIN' WHEN 'INSUFFICIENT' THEN 'INSUFFICIENT_EVIDENCE' WHEN 'AMBIGUOUS' THEN 'MULTIPLE_VALID_ASSIGNMENTS'
            ELSE CASE WHEN pool_net < net_paise - greatest(candidates, 1) THEN 'MISSING_TRANSACTION' WHEN net_paise - pool_net > 0 AND net_paise - pool_net < net_paise // 4 THEN 'UNKNOWN_ADJUSTMENT' ELSE 'NO_VALID_ASSIGNMENT' END END AS reason,
        CAST(CASE verdict WHEN 'PROVEN' THEN 0 WHEN 'INSUFFICIENT' THEN net_paise WHEN 'AMBIGUOUS' THEN fit_net ELSE net_paise - pool_net END AS BIGINT) AS unexplained_paise
    FROM findings
), exceptions AS (
    SELECT *, CASE WHEN verdict = 'PROVEN' THEN CASE WHEN amount_paise < 100000 THEN 'LOW' ELSE 'MEDIUM' END
        WHEN reason = 'MISSING_TRANSACTION' OR unexplained_paise >= amount_paise OR unexplained_paise >= 100000 OR unexplained_paise * 4 > amount_paise THEN 'HIGH'
        WHEN unexplained_paise >= 5000 OR unexplained_paise * 50 > amount_paise THEN 'MEDIUM' ELSE 'LOW' END AS severity
    FROM exceptions0
)"""
)


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def take(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return take


def base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Captures and settlements, each stored once a session: queries meet them several times, and filters on
    the amounts would otherwise repeat the fee rules' expressions in each place."""
    own = views.captures(spark, sf_dir)
    orders = once("captures", (own,), lambda: own)
    return orders, once("settlements", (own,), lambda: views.settlements(orders))


@query(VIEWS + "SELECT method, count(*) AS n, CAST(sum(gross_paise) AS BIGINT) AS gross_paise, CAST(sum(fee_paise) AS BIGINT) AS fee_paise, CAST(sum(tax_paise) AS BIGINT) AS tax_paise, CAST(sum(net_paise) AS BIGINT) AS net_paise FROM captures GROUP BY method")
def fee_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.captures(spark, sf_dir).withColumn("fee_paise", money.fee(F.col("gross_paise"), F.col("method")))
    own = own.withColumn("tax_paise", money.tax(F.col("fee_paise")))
    return own.groupBy("method").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("gross_paise", "fee_paise", "tax_paise", "net_paise")])


@query(VIEWS + f"SELECT DISTINCT captured_on, CAST(lag AS INTEGER) AS lag, {_DATES('captured_on', 'lag')} AS settled_on FROM captures, (VALUES (2), (3), (4)) v(lag)")
def settlement_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.calendar(views.captures(spark, sf_dir))


@query("""SELECT business_lag, count(*) AS n FROM (
    SELECT len(list_filter(generate_series(CAST(o_orderdate AS DATE) + INTERVAL 1 DAY, CAST(l_shipdate AS DATE), INTERVAL 1 DAY), lambda d: isodow(d) < 6)) AS business_lag
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY business_lag""")
def business_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    days = line.join(orders, line["l_orderkey"] == orders["o_orderkey"])
    lag = cal.business_days_between(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")).cast("long")
    return days.groupBy(lag.alias("business_lag")).agg(F.count("*").alias("n"))


@query(VIEWS + POOLS + "SELECT settlement_id, count(*) AS candidates, CAST(sum(net_paise) AS BIGINT) AS pool_net FROM pool GROUP BY settlement_id")
def candidate_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    return blocking.pool_sizes(payouts, orders).where("candidates > 0").select("settlement_id", "candidates", "pool_net")


@query(VIEWS + f""", days AS (SELECT DISTINCT captured_on, {_DATES('captured_on', 'lag')} AS pool_day FROM captures, (VALUES (2), (3), (4)) v(lag))
    SELECT s.settlement_id, count(*) AS candidates FROM settlements s JOIN days d ON d.pool_day = s.settled_on JOIN captures c ON c.captured_on = d.captured_on AND c.net_paise > 0 AND c.net_paise <= s.net_paise GROUP BY s.settlement_id""")
def candidate_pools_widest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    return blocking.pool_sizes(payouts, orders, cal.LAGS).where("candidates > 0").select("settlement_id", "candidates")


@query(VIEWS + FINDINGS + "SELECT * FROM space")
def search_space_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    return blocking.search_space(payouts, orders)


@query(VIEWS + FINDINGS + "SELECT settlement_id, candidates, row_number() OVER (ORDER BY candidates, settlement_id) AS work_order FROM space")
def work_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    return matching.ranked_by_pool(blocking.search_space(payouts, orders))


@query(VIEWS + r""", tokens AS (
    SELECT txn_id, unnest(regexp_extract_all(narration, '\b(\d{9,14})\b', 1)) AS utr, generate_subscripts(regexp_extract_all(narration, '\b(\d{9,14})\b', 1), 1) AS pos FROM credits
), known AS (SELECT utr, max(settlement_id) AS settlement_id FROM settlements WHERE utr IS NOT NULL GROUP BY utr
), by_ref AS (SELECT txn_id, arg_min(settlement_id, pos) AS by_ref FROM tokens JOIN known USING (utr) GROUP BY txn_id
), alone AS (SELECT net_paise, settled_on, min(settlement_id) AS by_amount FROM settlements GROUP BY ALL HAVING count(*) = 1)
SELECT txn_id, coalesce(by_ref, by_amount) AS settlement_id, CASE WHEN by_ref IS NOT NULL THEN 'reference' WHEN by_amount IS NOT NULL THEN 'amount' ELSE 'none' END AS via
FROM credits LEFT JOIN by_ref USING (txn_id) LEFT JOIN alone ON alone.net_paise = credit_paise AND alone.settled_on = value_date""")
def l1_credit_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    payouts = stored(views.settlements(views.captures(spark, sf_dir)), "settlements")
    return matching.credit_to_payout(views.credits(payouts), payouts)


@query(VIEWS + POOLS + "SELECT settlement_id, min(order_id) AS order_id FROM pool WHERE abs(net_paise - credit_paise) <= 1 GROUP BY settlement_id HAVING count(*) = 1")
def l2_single_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    return matching.single_match(blocking.credit_fits(payouts, orders))


@query(VIEWS + POOLS + "SELECT a.settlement_id, a.order_id AS first_order, b.order_id AS second_order, a.credit_paise - a.net_paise - b.net_paise AS residual FROM (SELECT *, credit_paise - net_paise - r AS wanted FROM pool, (VALUES (0), (1), (2)) v(r)) a JOIN pool b ON a.settlement_id = b.settlement_id AND b.net_paise = a.wanted AND a.order_id < b.order_id")
def pair_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    return matching.pair_subsets(payouts, orders)


@query(VIEWS + POOLS + "SELECT settlement_id, min(order_id) AS order_id FROM pool WHERE net_paise = credit_paise GROUP BY settlement_id HAVING count(*) = 1")
def baseline_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    return matching.baseline_exact(blocking.credit_fits(payouts, orders, slack=0))


@query(VIEWS + POOLS + "SELECT settlement_id, arg_min(order_id, (captured_on, order_id)) AS order_id FROM pool WHERE abs(net_paise - credit_paise) * 100 <= credit_paise GROUP BY settlement_id")
def baseline_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    return matching.baseline_fuzzy(blocking.pools(payouts, orders))


@query(VIEWS + POOLS + """, rows AS (SELECT settlement_id, credit_paise, list(net_paise ORDER BY net_paise DESC, order_id) AS nets FROM pool GROUP BY ALL
), fill AS (SELECT settlement_id, credit_paise, list_reduce(nets, lambda a, x: CASE WHEN a % 100000000000 + x <= credit_paise THEN a + x + 100000000000 ELSE a END, CAST(0 AS BIGINT)) AS packed FROM rows)
SELECT settlement_id, CAST(packed // 100000000000 AS INTEGER) AS n_orders, packed % 100000000000 AS filled_paise, (credit_paise - packed % 100000000000) * 100 <= credit_paise AS accepted FROM fill""")
def baseline_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    own = matching.greedy_fills(payouts, orders)
    return own.select("settlement_id", "n_orders", "filled_paise", ((F.col("credit_paise") - F.col("filled_paise")) * 100 <= F.col("credit_paise")).alias("accepted"))


@query(VIEWS + POOLS + "SELECT order_id, min(settlement_id) AS first_settlement, max(settlement_id) AS last_settlement, count(*) AS n_settlements FROM pool GROUP BY order_id HAVING count(*) > 1")
def order_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    return matching.conflicts(payouts, orders)


_TRUTH_PROOFS = """, totals AS (
    SELECT t.settlement_id, count(*) AS k, count(DISTINCT t.order_id) AS distinct_orders, count(c.gross_paise) AS known_orders, CAST(sum(c.gross_paise) AS BIGINT) AS gross_paise, CAST(sum(c.net_paise) AS BIGINT) AS net_paise
    FROM truth t LEFT JOIN (SELECT order_id, gross_paise, net_paise FROM captures) c USING (order_id) GROUP BY t.settlement_id
), proofs AS (
    SELECT t.*, s.net_paise AS credit_paise, t.gross_paise - t.net_paise AS fee_paise, s.net_paise - t.net_paise AS residual_paise, k AS tolerance_paise FROM totals t JOIN settlements s USING (settlement_id)
), checked AS (
    SELECT *, CASE WHEN distinct_orders < k THEN 'DUPLICATE_ORDER' WHEN known_orders < k THEN 'UNKNOWN_ORDER' WHEN abs(residual_paise) > tolerance_paise THEN 'RESIDUAL_OVER_TOLERANCE' ELSE 'OK' END AS reason FROM proofs
)"""


@query(VIEWS + _TRUTH_PROOFS + "SELECT *, reason = 'OK' AS ok FROM checked")
def kernel_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    return kernel.check(kernel.proofs(views.truth(orders), orders, payouts))


@query(VIEWS + _TRUTH_PROOFS + "SELECT s.hazard, c.reason, count(*) AS n, CAST(sum(abs(c.residual_paise)) AS BIGINT) AS off_paise FROM checked c JOIN settlements s USING (settlement_id) GROUP BY ALL")
def false_proof_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    checked = kernel.check(kernel.proofs(views.truth(orders), orders, payouts))
    return checked.join(payouts.select("settlement_id", "hazard"), "settlement_id").groupBy("hazard", "reason").agg(F.count("*").alias("n"), F.sum(F.abs("residual_paise")).alias("off_paise"))


def findings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    return findings.single_order_findings(payouts, orders)


@query(VIEWS + FINDINGS + "SELECT * FROM findings")
def single_order_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_of(spark, sf_dir)


@query(VIEWS + FINDINGS + "SELECT verdict, count(*) AS n, CAST(sum(net_paise) AS BIGINT) AS amount_paise FROM findings GROUP BY verdict")
def verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_of(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"), F.sum("net_paise").alias("amount_paise"))


@query(VIEWS + FINDINGS + "SELECT * FROM exceptions")
def exception_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.exceptions(findings_of(spark, sf_dir))


@query(VIEWS + FINDINGS + """SELECT *, CASE WHEN steps > 0 THEN value_paise // steps END AS leverage FROM (
    SELECT reason, count(*) AS items, CAST(sum(amount_paise) AS BIGINT) AS value_paise, CAST(sum(unexplained_paise) AS BIGINT) AS unexplained_paise, min(settlement_id) AS example,
        CASE WHEN reason IN ('UNKNOWN_ADJUSTMENT', 'REFUND_MISMATCH', 'CHARGEBACK', 'PARTIAL_SETTLEMENT', 'NO_VALID_ASSIGNMENT') THEN count(*) ELSE 1 END AS steps FROM exceptions GROUP BY reason)""")
def action_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.action_plan(findings_of(spark, sf_dir))
