"""Queries over policy, journal and the close of a period."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators import policy
from tallymark.operators.close import exposure, prediction, readiness
from tallymark.operators.findings import exceptions, single_order_findings
from tallymark.plans.recon_queries import FINDINGS, base
from tallymark.sources import views
from tallymark.sources.shared import stored
from tallymark.sources.views import SQL as VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_Z = policy.Z95
_JUDGED = (
    VIEWS + FINDINGS
    + f""", true_sets AS (SELECT settlement_id, count(*) AS k, min(order_id) AS true_order FROM truth GROUP BY settlement_id
), graded AS (SELECT *, 'unmeasured' AS cheapness FROM findings
), strata0 AS (
    SELECT integrity, cheapness, CAST(sum(CASE WHEN coalesce(k, 0) = 1 AND true_order = order_id THEN 0 ELSE 1 END) AS BIGINT) AS wrong, count(*) AS total
    FROM graded LEFT JOIN true_sets USING (settlement_id) WHERE verdict = 'PROVEN' GROUP BY ALL
), strata AS (
    SELECT *, CASE WHEN total >= {policy.MIN_OBSERVATIONS} THEN least(1.0, (CAST(wrong AS DOUBLE) / total + {_Z * _Z} / (2 * CAST(total AS DOUBLE)) + CAST({_Z} AS DOUBLE) * sqrt(CAST(wrong AS DOUBLE) / total * (1 - CAST(wrong AS DOUBLE) / total) / total + {_Z * _Z} / (4 * CAST(total AS DOUBLE) * total))) / (1 + {_Z * _Z} / CAST(total AS DOUBLE))) END AS p_error FROM strata0
), judged0 AS (
    SELECT g.*, t.p_error, CASE WHEN verdict = 'PROVEN' THEN CAST(ceil(t.p_error * (250000 + net_paise * 3000 // 10000)) AS BIGINT) END AS expected_loss FROM graded g LEFT JOIN strata t USING (integrity, cheapness)
), judged AS (
    SELECT settlement_id, verdict, net_paise, CASE WHEN verdict = 'PROVEN' THEN p_error END AS p_error, expected_loss,
        CASE WHEN verdict <> 'PROVEN' THEN 'REVIEW' WHEN integrity = 'COMPROMISED' OR p_error IS NULL THEN 'BLOCK' WHEN net_paise > 10000000 THEN 'REVIEW' WHEN expected_loss < 25000 THEN 'AUTO_POST' ELSE 'REVIEW' END AS decision FROM judged0
)"""
)
_ITEMS = (
    _JUDGED
    + """, items0 AS (SELECT e.*, j.decision, abs(amount_paise) AS v, abs(unexplained_paise) AS u, e.verdict = 'PROVEN' AND j.decision = 'BLOCK' AS stopped FROM exceptions e LEFT JOIN judged j USING (settlement_id)
), items AS (
    SELECT settlement_id, strftime(settled_on, '%Y-%m') AS period_id, settled_on, verdict, reason, severity, decision, unexplained_paise, v AS value_paise,
        CASE WHEN verdict = 'PROVEN' AND NOT stopped THEN v - least(v, u) ELSE 0 END AS verified_paise,
        CASE WHEN stopped THEN 'POLICY_BLOCKED' WHEN verdict = 'PROVEN' THEN CASE WHEN u > 0 THEN 'PARTIAL' END WHEN verdict IN ('AMBIGUOUS', 'INSUFFICIENT') THEN verdict WHEN u > 0 AND u < v THEN 'PARTIAL' ELSE 'UNVERIFIED' END AS kind,
        CASE WHEN stopped OR verdict = 'INSUFFICIENT' THEN v WHEN verdict = 'PROVEN' THEN least(v, u) WHEN u > 0 THEN u ELSE v END AS exposure_paise
    FROM items0
)"""
)


def _close_sql(source: str, prefix: str = "") -> str:
    """Totals, blockers and verdicts over a relation like items; names get a prefix."""
    return f""", {prefix}sums AS (
    SELECT period_id, count(*) AS n_settlements, count(reason) AS n_exceptions, CAST(sum(value_paise) AS BIGINT) AS total_paise, CAST(sum(verified_paise) AS BIGINT) AS verified_paise,
        CAST(sum(CASE WHEN kind IS NOT NULL THEN exposure_paise ELSE 0 END) AS BIGINT) AS contested_paise,
        CAST(coalesce(sum(exposure_paise) FILTER (kind = 'AMBIGUOUS'), 0) AS BIGINT) AS ambiguous_paise, CAST(coalesce(sum(exposure_paise) FILTER (kind IN ('PARTIAL', 'UNVERIFIED')), 0) AS BIGINT) AS contradicted_paise,
        CAST(coalesce(sum(exposure_paise) FILTER (kind = 'INSUFFICIENT'), 0) AS BIGINT) AS insufficient_paise
    FROM {source} GROUP BY period_id
), {prefix}totals AS (
    SELECT *, total_paise - verified_paise AS net_unresolved_paise, CASE WHEN total_paise <= 0 THEN 10000 ELSE greatest(10000, least(total_paise * 100 // 10000, 10000000)) END AS allowed_paise,
        CASE WHEN total_paise <= 0 OR total_paise * 100 // 10000 <= 10000 THEN 'FLOOR' WHEN total_paise * 100 // 10000 >= 10000000 THEN 'CEILING' ELSE 'PERCENTAGE' END AS governing,
        total_paise - verified_paise > CASE WHEN total_paise <= 0 THEN 10000 ELSE greatest(10000, least(total_paise * 100 // 10000, 10000000)) END AS material
    FROM {prefix}sums
), {prefix}claims AS (
    SELECT settlement_id, order_id FROM findings WHERE verdict = 'PROVEN' AND order_id IN (SELECT order_id FROM findings WHERE verdict = 'PROVEN' GROUP BY order_id HAVING count(DISTINCT settlement_id) > 1)
), {prefix}raised AS (
    SELECT period_id, 3 AS rule_no, 'CONTRADICTORY_EVIDENCE' AS kind, settlement_id AS ref_id, exposure_paise FROM {source} WHERE verdict = 'CONTRADICTED' AND unexplained_paise = value_paise AND value_paise > 0
    UNION ALL SELECT period_id, 4, 'DUPLICATE_LEDGER_IMPACT', settlement_id || ':' || order_id, value_paise FROM {source} JOIN {prefix}claims USING (settlement_id)
    UNION ALL SELECT period_id, 7, 'POLICY_BLOCKED', settlement_id, exposure_paise FROM {source} WHERE decision = 'BLOCK'
    UNION ALL SELECT period_id, 8, 'HIGH_SEVERITY_EXCEPTION', settlement_id, exposure_paise FROM {source} WHERE severity = 'HIGH'
    UNION ALL SELECT i.period_id, 10, 'AMBIGUOUS_MATERIAL_SETTLEMENT', settlement_id, exposure_paise FROM {source} i JOIN {prefix}totals t USING (period_id) WHERE kind = 'AMBIGUOUS' AND value_paise > allowed_paise
    UNION ALL SELECT period_id, 10, 'UNRESOLVED_MATERIAL_AMOUNT', 'material_exposure:' || period_id, net_unresolved_paise FROM {prefix}totals WHERE material
    UNION ALL SELECT i.period_id, 10, 'UNRESOLVED_MATERIAL_AMOUNT', settlement_id, exposure_paise FROM {source} i JOIN {prefix}totals t USING (period_id) WHERE material AND kind IS NOT NULL
), {prefix}blockers AS (
    SELECT period_id, kind, ref_id, CAST(rule_no AS INTEGER) AS rule_no, exposure_paise FROM {prefix}raised QUALIFY row_number() OVER (PARTITION BY period_id, kind, ref_id ORDER BY rule_no, exposure_paise) = 1
), {prefix}stops AS (
    SELECT period_id, count(*) AS n_blockers, count(DISTINCT kind) AS n_kinds, CAST(sum(CASE WHEN exposure_paise > 0 THEN exposure_paise ELSE 0 END) AS BIGINT) AS blocked_paise FROM {prefix}blockers GROUP BY period_id
), {prefix}verdicts AS (
    SELECT period_id, CASE WHEN coalesce(n_blockers, 0) > 0 THEN 'BLOCKED' WHEN net_unresolved_paise > 0 OR n_exceptions > 0 THEN 'READY_WITH_CARRY_FORWARD' ELSE 'READY_TO_CLOSE' END AS verdict,
        coalesce(n_blockers, 0) AS n_blockers, coalesce(n_kinds, 0) AS n_kinds, total_paise, net_unresolved_paise, CASE WHEN material THEN net_unresolved_paise ELSE coalesce(blocked_paise, 0) END AS material_exposure_paise
    FROM {prefix}totals LEFT JOIN {prefix}stops USING (period_id)
)"""


_CLOSE = _ITEMS + _close_sql("items")
_CARRIED = (
    _CLOSE
    + """, carried AS (SELECT period_id, settlement_id, reason, severity, exposure_paise, datediff('day', settled_on, last_day(settled_on)) AS age_days FROM items WHERE kind IS NOT NULL OR reason IS NOT NULL
), priors(reason, p0, days) AS (VALUES """
    + ", ".join(f"('{k}', CAST({p} AS DOUBLE), {d})" for k, (p, d) in prediction.PRIORS.items())
    + """), featured AS (
    SELECT c.*, CAST(CASE WHEN v.value_paise > 0 THEN v.value_paise ELSE greatest(c.exposure_paise, 1) END AS BIGINT) AS settlement_value_paise, least(1.0, greatest(0.0, CAST(c.exposure_paise AS DOUBLE) / CASE WHEN v.value_paise > 0 THEN v.value_paise ELSE greatest(c.exposure_paise, 1) END)) AS exposure_ratio,
        f.verdict = 'CONTRADICTED' AND f.candidates > 0 AS has_partial_match, f.verdict IN ('PROVEN', 'AMBIGUOUS') AS has_established_orders, coalesce(c.reason IN (SELECT reason FROM priors), false) AS has_missing_evidence_ref, CASE WHEN f.verdict = 'AMBIGUOUS' THEN f.n_fits ELSE 0 END AS ambiguity_count, 0 AS prior_attempts
    FROM carried c JOIN (SELECT settlement_id, value_paise FROM items) v USING (settlement_id) JOIN findings f USING (settlement_id)
), scored AS (
    SELECT c.*, days, round_even(greatest(0.01, least(0.99, 1 / (1 + exp(-(ln(greatest(1e-4, p0) / greatest(1e-4, 1 - p0))
        + CAST(CASE WHEN age_days <= 2 THEN 0.35 WHEN age_days <= 5 THEN 0.05 WHEN age_days <= 10 THEN -0.40 WHEN age_days <= 30 THEN -1.10 ELSE -2.20 END AS DOUBLE)
        + CAST(CASE WHEN exposure_paise < 1 THEN 1.0 WHEN exposure_paise < 5000 THEN 0.40 WHEN exposure_paise < 50000 THEN 0.10 WHEN exposure_paise < 500000 THEN -0.30 ELSE -0.80 END AS DOUBLE)
        + CAST(CASE severity WHEN 'HIGH' THEN -1.20 WHEN 'MEDIUM' THEN -0.30 ELSE 0 END AS DOUBLE)
        + CAST(0.35 AS DOUBLE) + CASE WHEN has_partial_match OR has_established_orders THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END))))), 4) AS probability
    FROM featured c JOIN priors USING (reason)
), predicted AS (
    SELECT settlement_id, probability, CAST(CASE WHEN probability >= 0.75 THEN greatest(1, days) WHEN probability >= 0.40 THEN days + 3 ELSE greatest(14, days + 10) END AS BIGINT) AS horizon_days,
        CASE WHEN 50 + CASE WHEN abs(probability - 0.5) >= 0.30 THEN 25 ELSE 0 END + 15 + CASE WHEN age_days > 20 THEN 10 ELSE 0 END >= 75 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
        CASE WHEN severity = 'HIGH' OR exposure_paise >= 1000000 THEN 'MANUAL_AUDIT' WHEN probability >= 0.75 AND age_days <= 3 THEN 'AUTO_RESOLVE_NEXT_CYCLE' WHEN probability >= 0.50 THEN 'HOLD_FOR_SETTLEMENT_WINDOW' ELSE 'INVESTIGATE_OPERATIONAL' END AS routing
    FROM scored
)"""
)


def query(sql: str | None = None):
    def take(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return take


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders, payouts = base(spark, sf_dir)
    found = stored(single_order_findings(payouts, orders), "findings")  # read several times
    return found, policy.decide(found, policy.strata(found, views.truth(orders)))


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found, judged = _judged(spark, sf_dir)
    return stored(exposure.items(exceptions(found), judged), "items"), found


def _featured(own: DataFrame, found: DataFrame) -> DataFrame:
    return prediction.features(readiness.carry_forward(own), own, found)


@query(_JUDGED + "SELECT * FROM strata")
def risk_strata_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    return policy.strata(single_order_findings(payouts, orders), views.truth(orders)).select("integrity", "cheapness", "wrong", "total", "p_error")


@query(_JUDGED + "SELECT * FROM judged")
def policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir)[1]


_REVIEW_COSTS = (1_000, 2_500, 5_000, 10_000, 25_000, 50_000, 100_000, 150_000, 250_000)


@query(_JUDGED + f"""SELECT CAST(review_cost AS BIGINT) AS review_cost, count(*) FILTER (posts) AS posted, CAST(coalesce(sum(net_paise) FILTER (posts), 0) AS BIGINT) AS posted_paise, CAST(coalesce(sum(expected_loss) FILTER (posts), 0) AS BIGINT) AS expected_loss
    FROM (SELECT *, expected_loss < review_cost AND net_paise <= 10000000 AS posts FROM judged, (VALUES {', '.join(f'({c})' for c in _REVIEW_COSTS)}) c(review_cost) WHERE verdict = 'PROVEN') GROUP BY review_cost""")
def policy_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.frontier(_judged(spark, sf_dir)[1], _REVIEW_COSTS)


_POSTS = _JUDGED + """, posts AS (
    SELECT f.settlement_id, f.net_paise, f.fit_gross, ((f.fit_gross * CASE f.method WHEN 'upi' THEN 0 WHEN 'card' THEN 200 WHEN 'netbanking' THEN 150 ELSE 250 END + 5000) // 10000 * 1800 + 5000) // 10000 AS gst
    FROM findings f JOIN judged j USING (settlement_id) WHERE j.decision = 'AUTO_POST'
), lines AS (
    SELECT settlement_id, 1 AS line_no, 'Bank' AS account, net_paise AS debit_paise, 0 AS credit_paise FROM posts UNION ALL SELECT settlement_id, 2, 'Gateway fees', fit_gross - net_paise - gst, 0 FROM posts
    UNION ALL SELECT settlement_id, 3, 'GST on fees', gst, 0 FROM posts UNION ALL SELECT settlement_id, 4, 'Receivables', 0, fit_gross FROM posts
)"""


@query(_POSTS + "SELECT * FROM lines")
def journal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.journal(*_judged(spark, sf_dir))


@query(_POSTS + "SELECT account, count(*) AS n, CAST(sum(debit_paise) AS BIGINT) AS debit_paise, CAST(sum(credit_paise) AS BIGINT) AS credit_paise FROM lines GROUP BY account")
def journal_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.journal(*_judged(spark, sf_dir)).groupBy("account").agg(F.count("*").alias("n"), F.sum("debit_paise").alias("debit_paise"), F.sum("credit_paise").alias("credit_paise"))


@query(_JUDGED + """SELECT refusal, count(*) AS n, CAST(sum(net_paise) AS BIGINT) AS amount_paise, arg_min(settlement_id, (-net_paise, settlement_id)) AS largest
    FROM (SELECT *, CASE WHEN verdict <> 'PROVEN' THEN 'VERDICT_' || verdict ELSE 'POLICY_' || decision END AS refusal FROM judged WHERE decision <> 'AUTO_POST') GROUP BY refusal""")
def refusal_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.refusals(_judged(spark, sf_dir)[1])


@query(_ITEMS + "SELECT * FROM items")
def exposure_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir)[0]


@query(_CLOSE + "SELECT * FROM totals")
def period_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.totals(_items(spark, sf_dir)[0])


@query(_CLOSE + "SELECT * FROM blockers")
def blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.blockers(*_items(spark, sf_dir))


@query(_CLOSE + "SELECT * FROM verdicts")
def period_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.verdicts(*_items(spark, sf_dir))


@query(_CARRIED + "SELECT * FROM carried")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.carry_forward(_items(spark, sf_dir)[0])


@query(_CARRIED + "SELECT * FROM predicted")
def resolution_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction.predict(_featured(*_items(spark, sf_dir)))


@query(_CARRIED + "SELECT period_id, settlement_id, settlement_value_paise, exposure_ratio, has_partial_match, has_established_orders, has_missing_evidence_ref, ambiguity_count, CAST(prior_attempts AS BIGINT) AS prior_attempts FROM featured")
def resolution_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What predictions of open items rest on."""
    return _featured(*_items(spark, sf_dir)).drop("reason", "severity", "exposure_paise", "age_days")


@query(_CARRIED + """, stopping AS (SELECT DISTINCT ref_id AS settlement_id FROM blockers
), queue AS (
    SELECT s.period_id, s.settlement_id, s.reason, s.exposure_paise, b.settlement_id IS NOT NULL AS blocker, s.exposure_paise > t.allowed_paise AS large, i.verdict = 'AMBIGUOUS' AS ambiguous, s.severity, s.age_days, s.probability
    FROM scored s JOIN items i USING (settlement_id) JOIN totals t ON t.period_id = s.period_id LEFT JOIN stopping b ON b.settlement_id = s.settlement_id
)
SELECT period_id, settlement_id, reason, CAST(1000000 * blocker::INT + 700000 * large::INT + CASE severity WHEN 'HIGH' THEN 300000 WHEN 'MEDIUM' THEN 100000 ELSE 0 END + 200000 * ambiguous::INT + least(exposure_paise // 1000, 10000000) + least(age_days * 1000, 50000) + floor((1 - probability) * 100000 + 1e-6) AS BIGINT) AS priority, exposure_paise,
    CASE WHEN blocker THEN 'BLOCKER' WHEN large THEN 'MATERIAL' WHEN ambiguous THEN 'AMBIGUOUS' ELSE 'CARRY_FORWARD' END AS close_impact FROM queue""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, found = _items(spark, sf_dir)
    return prediction.review_queue(own, _featured(own, found), readiness.blockers(own, found), exposure.totals(own))


def _scenario(name: str, condition: str) -> str:
    p = name.lower() + "_"
    return f""", {p}items AS (
    SELECT settlement_id, period_id, settled_on, value_paise, CASE WHEN {condition} THEN 'PROVEN' ELSE verdict END AS verdict, CASE WHEN NOT {condition} THEN reason END AS reason, CASE WHEN {condition} THEN 'LOW' ELSE severity END AS severity,
        CASE WHEN {condition} THEN 'AUTO_POST' ELSE decision END AS decision, CASE WHEN {condition} THEN 0 ELSE unexplained_paise END AS unexplained_paise, CASE WHEN {condition} THEN value_paise ELSE verified_paise END AS verified_paise,
        CASE WHEN NOT {condition} THEN kind END AS kind, CASE WHEN {condition} THEN 0 ELSE exposure_paise END AS exposure_paise FROM items
){_close_sql(p + "items", p)}"""


_SCENARIOS = {"BASELINE": "false", "RESOLVE_AMBIGUOUS": "(verdict = 'AMBIGUOUS')", "RESOLVE_HIGH": "(severity = 'HIGH')", "CLEAR_POLICY_BLOCKS": "coalesce(decision = 'BLOCK', false)", "RESOLVE_ALL": "true"}


@query(_ITEMS + "".join(_scenario(*x) for x in _SCENARIOS.items()) + " UNION ALL ".join(f"SELECT *, '{name}' AS scenario FROM {name.lower()}_verdicts" for name in _SCENARIOS))
def simulate_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction.simulate(*_items(spark, sf_dir), readiness.verdicts)
