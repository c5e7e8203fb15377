"""Queries over references in narrations and the flow of value through proofs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators import evidence, flow, narration
from tallymark.operators.blocking import search_space
from tallymark.plans.evidence_queries import _EXPLAINED, _explained
from tallymark.plans.recon_queries import base
from tallymark.sources import views
from tallymark.sources.shared import once
from tallymark.sources.views import SQL as VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def take(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return take


@query(VIEWS + """, needles AS (SELECT settlement_id, utr, length(utr) AS n FROM settlements WHERE length(utr) > 0
), parts AS (SELECT DISTINCT txn_id, n, substr(narration, i, n) AS part FROM (SELECT txn_id, narration, n, unnest(range(1, length(narration) - n + 2)) AS i FROM credits, (SELECT DISTINCT n FROM needles)))
SELECT txn_id, settlement_id FROM parts JOIN needles ON parts.n = needles.n AND part = utr""")
def narration_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank credits whose narration holds a payout's reference, wherever it stands."""
    payouts = base(spark, sf_dir)[1]
    texts = views.credits(payouts).select(F.col("txn_id").alias("text_id"), F.col("narration").alias("text"))
    found = narration.holding(texts, payouts.select(F.col("settlement_id").alias("reference_id"), F.col("utr").alias("reference")))
    return found.select(F.col("text_id").alias("txn_id"), F.col("reference_id").alias("settlement_id"))


_FLOW = _EXPLAINED + """, members AS (SELECT e.* FROM explained e JOIN proposed p ON p.settlement_id = e.settlement_id AND p.proof = e.explanation
), sums AS (SELECT m.settlement_id, CAST(sum(gross_paise) AS BIGINT) AS gross, CAST(sum(m.net_paise) AS BIGINT) AS net, any_value(s.net_paise) AS credit, any_value(utr) AS utr FROM members m JOIN settlements s USING (settlement_id) GROUP BY m.settlement_id
), edges AS (
    SELECT settlement_id, order_id AS source, settlement_id AS target, 'ORDER' AS kind, gross_paise AS paise FROM members
    UNION ALL SELECT settlement_id, settlement_id, 'fee', 'FEE_RULE', gross - net FROM sums WHERE gross <> net
    UNION ALL SELECT settlement_id, settlement_id, 'bank', CASE WHEN utr IS NOT NULL THEN 'EXACT_UTR' ELSE 'AMOUNT_MATCH' END, credit FROM sums
    UNION ALL SELECT settlement_id, settlement_id, 'drift', 'ROUNDING', net - credit FROM sums WHERE net > credit
    UNION ALL SELECT settlement_id, 'drift', settlement_id, 'ROUNDING', credit - net FROM sums WHERE net < credit
)"""


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    explained = once("explained", (orders,), lambda: _explained(spark, sf_dir))
    proofs = evidence.findings(explained, search_space(payouts, orders)).where("proof is not null").select("settlement_id", F.col("proof").alias("explanation"))
    return flow.edges(explained.join(proofs, ["settlement_id", "explanation"]), payouts)


@query(_FLOW + "SELECT * FROM edges")
def value_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the value of every proven payout comes from and goes to."""
    return _flow(spark, sf_dir)


@query(_FLOW + """, ends AS (SELECT settlement_id, source AS node, 0 AS inflow, paise AS outflow FROM edges UNION ALL SELECT settlement_id, target, paise, 0 FROM edges)
SELECT settlement_id, node, CAST(sum(inflow) AS BIGINT) AS inflow, CAST(sum(outflow) AS BIGINT) AS outflow, CASE WHEN node = settlement_id THEN sum(inflow) = sum(outflow) END AS conserved FROM ends GROUP BY settlement_id, node""")
def value_flow_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What flows into and out of every node; a payout keeps nothing."""
    return flow.nodes(_flow(spark, sf_dir))
