"""Queries over hypotheses: capture batches tested against the small explanations of ambiguous payouts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators import evidence, hypothesis
from tallymark.operators.blocking import pools, search_space
from tallymark.plans.evidence_queries import _EXPLAINED, _explained
from tallymark.plans.recon_queries import base
from tallymark.sources.shared import once, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def take(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return take


_TESTED = _EXPLAINED + f""", batches AS (
    SELECT settlement_id, captured_on, count(*) AS n, list(order_id ORDER BY order_id)[1:{hypothesis.ANCHOR}] AS anchor FROM pool WHERE settlement_id IN (SELECT settlement_id FROM proposed WHERE verdict = 'AMBIGUOUS') GROUP BY ALL HAVING count(*) > 1
), ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY settlement_id ORDER BY n DESC, captured_on) AS k FROM batches) WHERE k <= {hypothesis.ROUNDS * hypothesis.PROPOSED}
), sets AS (SELECT settlement_id, explanation, list(order_id) AS ids FROM explained GROUP BY ALL
), tested AS (
    SELECT r.settlement_id, k, (k + 1) // 2 AS round, 2 - k % 2 AS no, count(*) FILTER (list_has_all(ids, anchor)) AS n_in, min(explanation) FILTER (list_has_all(ids, anchor)) AS explanation FROM ranked r JOIN sets USING (settlement_id) GROUP BY ALL
), marked AS (
    SELECT *, CASE WHEN n_in = 0 THEN 'consistency' WHEN n_in > 1 THEN 'uniqueness' ELSE '' END AS why, k = max(k) OVER (PARTITION BY settlement_id, round) AS last FROM tested
), reached AS (
    SELECT * FROM marked m WHERE NOT EXISTS (SELECT 1 FROM marked b WHERE b.settlement_id = m.settlement_id AND (b.k < m.k AND b.why = '' OR b.round < m.round AND b.last AND b.why = 'consistency'))
), ends AS (
    SELECT settlement_id, coalesce(max(round), 0) AS rounds, coalesce(bool_or(why = ''), false) AS done FROM proposed LEFT JOIN reached USING (settlement_id) WHERE verdict = 'AMBIGUOUS' GROUP BY settlement_id
)"""


def _investigated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders, payouts = base(spark, sf_dir)
    explained = once("explained", (orders,), lambda: _explained(spark, sf_dir))
    found = stored(evidence.findings(explained, search_space(payouts, orders)).select("settlement_id", "verdict"), "found")
    ambiguous = payouts.join(found.where("verdict = 'AMBIGUOUS'").select("settlement_id"), "settlement_id", "left_semi")
    own = pools(ambiguous, orders).select("settlement_id", "order_id", "captured_on")
    return hypothesis.investigate(found, explained, own, payouts, orders, hypothesis.capture_batches(own))


@query(_TESTED + """SELECT p.settlement_id, CASE WHEN r.explanation IS NOT NULL THEN 'PROVEN' ELSE p.verdict END AS verdict, CASE WHEN r.explanation IS NOT NULL THEN 'capture-batch' END AS lens, r.explanation
FROM proposed p LEFT JOIN (SELECT * FROM reached WHERE why = '') r USING (settlement_id)""")
def hypothesis_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every payout's verdict after three rounds of capture batches."""
    return _investigated(spark, sf_dir)[0]


@query(_TESTED + f"""SELECT settlement_id, CAST(round AS INTEGER) AS round, CAST(no AS INTEGER) AS no, step, actor, act, why, lens FROM (
    SELECT settlement_id, 0 AS round, 0 AS no, 0 AS step, 'engine' AS actor, 'skip' AS act, verdict AS why, '' AS lens FROM proposed WHERE verdict <> 'AMBIGUOUS'
    UNION ALL SELECT settlement_id, round, no, 1, 'model', 'propose', '', 'capture-batch' FROM reached
    UNION ALL SELECT settlement_id, round, no, 2, 'solver', 'refute', why, 'capture-batch' FROM reached WHERE why <> ''
    UNION ALL SELECT settlement_id, round, no, 2, 'solver', 'accept', '', 'capture-batch' FROM reached WHERE why = ''
    UNION ALL SELECT settlement_id, round, no, 3, 'kernel', 'verify', '', 'capture-batch' FROM reached WHERE why = ''
    UNION ALL SELECT settlement_id, rounds + 1, 0, 0, 'model', 'exhausted', '', '' FROM ends WHERE NOT done AND rounds < {hypothesis.ROUNDS}
    UNION ALL SELECT settlement_id, {hypothesis.ROUNDS + 1}, 0, 0, 'engine', 'abstain', '', '' FROM ends WHERE NOT done)""")
def hypothesis_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every proposal and what became of it, in order."""
    return _investigated(spark, sf_dir)[1]


@query(_TESTED + """, acts AS (SELECT CASE WHEN why = '' THEN 'accept' ELSE why END AS outcome, round FROM reached) SELECT CAST(round AS INTEGER) AS round, outcome, count(*) AS n FROM acts GROUP BY ALL""")
def hypothesis_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How hypotheses end in each round."""
    rows = _investigated(spark, sf_dir)[1].where("act in ('accept', 'refute')")
    return rows.groupBy("round", F.when(F.col("act") == "accept", "accept").otherwise(F.col("why")).alias("outcome")).agg(F.count("*").alias("n"))
