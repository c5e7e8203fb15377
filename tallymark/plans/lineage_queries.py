"""Queries over the whole lineage of a close: its twelve relations, what causes a verdict, what an order touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators import blocking, lineage, matching
from tallymark.operators.close import readiness
from tallymark.plans.close_queries import _CARRIED, _items
from tallymark.plans.recon_queries import base
from tallymark.sources import views
from tallymark.sources.shared import once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def take(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return take


_GRAPH = _CARRIED + r""", tokens AS (
    SELECT txn_id, unnest(regexp_extract_all(narration, '\b(\d{9,14})\b', 1)) AS utr, generate_subscripts(regexp_extract_all(narration, '\b(\d{9,14})\b', 1), 1) AS pos FROM credits
), known AS (SELECT utr, max(settlement_id) AS settlement_id FROM settlements WHERE utr IS NOT NULL GROUP BY utr
), by_ref AS (SELECT txn_id, arg_min(settlement_id, pos) AS by_ref FROM tokens JOIN known USING (utr) GROUP BY txn_id
), alone AS (SELECT net_paise, settled_on, min(settlement_id) AS by_amount FROM settlements GROUP BY ALL HAVING count(*) = 1
), matched AS (SELECT txn_id, coalesce(by_ref, by_amount) AS settlement_id FROM credits LEFT JOIN by_ref USING (txn_id) LEFT JOIN alone ON alone.net_paise = credit_paise AND alone.settled_on = value_date
), raised_b AS (SELECT *, 'blk:' || period_id || ':' || kind || ':' || ref_id AS blk, split_part(ref_id, ':', 1) AS about, starts_with(ref_id, 'material_exposure:') AS material, kind = 'HIGH_SEVERITY_EXCEPTION' AS high FROM blockers
), edges AS MATERIALIZED (
    SELECT 'evt:pay:' || order_id AS source, 'rec:order:' || order_id AS target, 'CAPTURED_AS' AS relationship FROM captures UNION ALL SELECT 'evt:bank:' || txn_id, 'rec:bank:' || txn_id, 'CAPTURED_AS' FROM matched
    UNION ALL SELECT 'rec:bank:' || txn_id, 'setl:' || settlement_id, 'CREDITED_IN_BANK' FROM matched WHERE settlement_id IS NOT NULL
    UNION ALL SELECT 'rec:order:' || order_id, 'proof:' || settlement_id, 'BUNDLED_IN_SETTLEMENT' FROM findings WHERE order_id IS NOT NULL UNION ALL SELECT 'proof:' || settlement_id, 'find:' || settlement_id, 'PROVEN_BY' FROM findings WHERE order_id IS NOT NULL
    UNION ALL SELECT 'find:' || settlement_id, 'setl:' || settlement_id, 'PROVEN_BY' FROM findings UNION ALL SELECT 'setl:' || settlement_id, 'vdt:' || period_id, 'DETERMINES_VERDICT' FROM items
    UNION ALL SELECT 'setl:' || settlement_id, 'exc:' || settlement_id, 'DISCREPANCY_RAISED' FROM items WHERE reason IS NOT NULL
    UNION ALL SELECT 'rec:order:' || p.order_id, 'exc:' || settlement_id, 'ESTABLISHED_PARTIAL' FROM pool p JOIN findings f USING (settlement_id) JOIN items i USING (settlement_id) WHERE abs(p.net_paise - credit_paise) <= 1 AND f.verdict = 'AMBIGUOUS' AND i.reason IS NOT NULL
    UNION ALL SELECT 'miss:' || settlement_id, 'exc:' || settlement_id, 'MISSING_EVIDENCE_LINK' FROM items WHERE reason IN ('MISSING_TRANSACTION', 'INSUFFICIENT_EVIDENCE')
    UNION ALL SELECT 'setl:' || settlement_id, 'exp:' || settlement_id, 'ASSESSED_EXPOSURE' FROM items WHERE kind IS NOT NULL UNION ALL SELECT 'find:' || settlement_id, 'exp:' || settlement_id, 'ASSESSED_EXPOSURE' FROM findings JOIN items USING (settlement_id) WHERE kind IS NOT NULL
    UNION ALL SELECT 'exc:' || settlement_id, 'exp:' || settlement_id, 'ASSESSED_EXPOSURE' FROM items WHERE kind IS NOT NULL AND reason IS NOT NULL
    UNION ALL SELECT 'exp:' || settlement_id, 'mat:' || period_id, 'EVALUATED_AGAINST_POLICY' FROM items WHERE kind IS NOT NULL UNION ALL SELECT DISTINCT 'mat:' || period_id, 'vdt:' || period_id, 'DETERMINES_VERDICT' FROM items
    UNION ALL SELECT blk, 'vdt:' || period_id, 'CAUSES_BLOCKER' FROM raised_b UNION ALL SELECT CASE WHEN material THEN 'mat:' || period_id WHEN high THEN 'exc:' || about ELSE 'setl:' || about END, blk, 'CAUSES_BLOCKER' FROM raised_b
    UNION ALL SELECT 'cf:' || settlement_id, 'vdt:' || period_id, 'CARRIED_FORWARD' FROM carried UNION ALL SELECT 'exc:' || settlement_id, 'cf:' || settlement_id, 'CARRIED_FORWARD' FROM carried WHERE reason IS NOT NULL
)"""
_TYPE = "CASE WHEN split_part(node_id, ':', 1) IN ('evt', 'rec') THEN split_part(node_id, ':', 1) || ':' || split_part(node_id, ':', 2) ELSE split_part(node_id, ':', 1) END"
_RECURSIVE = _GRAPH.replace("WITH captures0", "WITH RECURSIVE captures0")


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)

    def make() -> DataFrame:
        own, found = _items(spark, sf_dir)
        fits = blocking.credit_fits(payouts, orders).join(found.where("verdict = 'AMBIGUOUS'").select("settlement_id"), "settlement_id").select("settlement_id", "order_id")
        matched = matching.credit_to_payout(views.credits(payouts), payouts)
        return lineage.whole(orders, matched, found, fits, own, readiness.blockers(own, found), readiness.carry_forward(own))

    return once("lineage", (orders,), make)


@query(_GRAPH + "SELECT * FROM edges")
def lineage_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twelve relations."""
    return _graph(spark, sf_dir)


@query(_RECURSIVE + f""", walk AS (SELECT DISTINCT target AS root, target AS node_id FROM edges WHERE target LIKE 'vdt:%' UNION SELECT w.root, e.source FROM walk w JOIN edges e ON e.target = w.node_id)
SELECT root, {_TYPE} AS type, count(*) AS n FROM walk WHERE root <> node_id GROUP BY ALL""")
def root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands behind each period's verdict, by type of node."""
    graph = _graph(spark, sf_dir)
    return lineage.causes(graph, graph.where("target like 'vdt:%'").select(F.col("target").alias("node_id")))


@query(_RECURSIVE + f""", walk AS (SELECT DISTINCT source AS root, source AS node_id FROM edges WHERE source LIKE 'rec:order:%' UNION SELECT w.root, e.target FROM walk w JOIN edges e ON e.source = w.node_id)
SELECT root, {_TYPE} AS type, count(*) AS n FROM walk WHERE root <> node_id GROUP BY ALL""")
def order_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every order that counts somewhere has touched, by type of node."""
    graph = _graph(spark, sf_dir)
    return lineage.causes(graph, graph.where("source like 'rec:order:%'").select(F.col("source").alias("node_id")), backward=False)


@query(_GRAPH + """, o AS (SELECT source AS node_id, count(DISTINCT target) AS children, count(*) AS outgoing FROM edges GROUP BY 1), i AS (SELECT target AS node_id, count(DISTINCT source) AS parents, count(*) AS incoming FROM edges GROUP BY 1)
SELECT node_id, coalesce(parents, 0) AS parents, coalesce(children, 0) AS children, coalesce(incoming, 0) AS incoming, coalesce(outgoing, 0) AS outgoing FROM o FULL JOIN i USING (node_id)""")
def lineage_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct causes and effects of every node."""
    return lineage.adjacent(_graph(spark, sf_dir))
