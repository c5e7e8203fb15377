"""Queries over explanations, ranks, percentiles, components and evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators import blocking, evidence, reports
from tallymark.operators.close import prediction, readiness
from tallymark.plans.close_queries import _CARRIED, _ITEMS, _JUDGED, _featured, _items, _judged
from tallymark.plans.close_queries import SQL as CLOSE_SQL
from tallymark.plans.close_queries import review_queue, simulate_scenarios
from tallymark.plans.recon_queries import FINDINGS, POOLS, base
from tallymark.sources import views
from tallymark.sources.shared import stored
from tallymark.sources.views import SQL as VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def take(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return take


_EXPLAINED = VIEWS + FINDINGS + """, ones AS (SELECT settlement_id, order_id AS explanation, order_id, net_paise, gross_paise, 1 AS k FROM pool WHERE credit_paise - net_paise <= 1
), rest AS MATERIALIZED (SELECT * FROM pool ANTI JOIN ones USING (settlement_id, order_id)
), pairs AS (
    SELECT a.settlement_id, a.order_id AS one, b.order_id AS two, a.net_paise AS n1, b.net_paise AS n2, a.gross_paise AS g1, b.gross_paise AS g2
    FROM (SELECT *, credit_paise - net_paise - r AS wanted FROM rest, (VALUES (0), (1), (2)) v(r)) a JOIN rest b ON a.settlement_id = b.settlement_id AND b.net_paise = a.wanted AND a.order_id < b.order_id
), explained AS (
    SELECT * FROM ones UNION ALL SELECT settlement_id, one || ' ' || two, one, n1, g1, 2 FROM pairs UNION ALL SELECT settlement_id, one || ' ' || two, two, n2, g2, 2 FROM pairs
), sizes AS (SELECT settlement_id, count(DISTINCT explanation) AS n_explanations, min(explanation) AS proof, max(k) AS k FROM explained GROUP BY settlement_id
), agreed AS (
    SELECT settlement_id, order_id, net_paise, n_with, n_explanations, n_with = n_explanations AS forced FROM (SELECT settlement_id, order_id, net_paise, count(*) AS n_with FROM explained GROUP BY ALL) JOIN sizes USING (settlement_id)
), proposed AS (
    SELECT s.settlement_id, CASE WHEN coalesce(n_explanations, 0) = 1 THEN 'PROVEN' WHEN coalesce(n_explanations, 0) > 1 THEN 'AMBIGUOUS' ELSE 'CONTRADICTED' END AS verdict, coalesce(n_explanations, 0) AS n_explanations,
        CASE WHEN n_explanations = 1 THEN proof END AS proof, universe, candidates, integrity, removed_by_date + removed_by_amount AS removed, CASE WHEN coalesce(n_explanations, 0) = 0 THEN '' WHEN k = 1 THEN 'L2' ELSE 'L3' END AS layer
    FROM space s LEFT JOIN sizes USING (settlement_id)
)"""


def _fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    return blocking.credit_fits(payouts, orders)


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    return stored(evidence.small_explanations(payouts, orders), "explanations")


def _proposed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders, payouts = base(spark, sf_dir)
    explained = stored(evidence.small_explanations(payouts, orders), "explanations")
    return explained, stored(evidence.findings(explained, blocking.search_space(payouts, orders)), "proposed")


@query(_EXPLAINED + "SELECT * FROM explained")
def small_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    return evidence.small_explanations(payouts, orders)


@query(_EXPLAINED + "SELECT * FROM agreed")
def forced_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.agreement(_explained(spark, sf_dir))


@query(_EXPLAINED + """SELECT settlement_id, n_explanations, count(*) FILTER (forced) AS n_forced, count(*) FILTER (NOT forced) AS n_contested, CAST(coalesce(sum(net_paise) FILTER (forced), 0) AS BIGINT) AS settled_paise,
    CAST(coalesce(sum(net_paise) FILTER (NOT forced), 0) AS BIGINT) AS disputed_paise, min(order_id) FILTER (forced) AS first_forced, min(order_id) FILTER (NOT forced) AS first_contested FROM agreed GROUP BY ALL""")
def settled_disputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.settled_disputed(_explained(spark, sf_dir))


@query(_EXPLAINED + "SELECT * FROM proposed")
def small_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proposed(spark, sf_dir)[1]


@query(_EXPLAINED + """, outside AS (SELECT DISTINCT settlement_id FROM (SELECT settlement_id, unnest(string_split(proof, ' ')) AS order_id FROM proposed WHERE proof IS NOT NULL) ANTI JOIN pool USING (settlement_id, order_id)
), reasons AS (
    SELECT p.*, CASE WHEN verdict <> 'PROVEN' THEN 'NOT_PROVEN' WHEN universe IS NULL THEN 'NO_SPACE' WHEN universe <= 0 THEN 'EMPTY_UNIVERSE' WHEN removed <= 0 THEN 'NO_REDUCTIONS' WHEN layer = '' THEN 'NO_LAYER' WHEN proof IS NULL THEN 'NO_PROOF'
        WHEN candidates <= 0 THEN 'NO_MEMBERS' WHEN o.settlement_id IS NOT NULL THEN 'PROOF_OUTSIDE_MEMBERS' WHEN integrity = 'COMPROMISED' THEN 'COMPROMISED' ELSE '' END AS why FROM proposed p LEFT JOIN outside o USING (settlement_id)
) SELECT settlement_id, verdict, why = '' AS postable, why FROM reasons""")
def why_not_postable(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    found = _proposed(spark, sf_dir)[1]
    cited = found.where("proof is not null").select("settlement_id", F.explode(F.split("proof", " ")).alias("order_id"))
    return evidence.why_not_postable(found, blocking.held(cited, payouts, orders))


@query(_EXPLAINED + """, totals AS (SELECT settlement_id, explanation, count(*) AS k, count(DISTINCT order_id) AS d, sum(net_paise) AS net, sum(gross_paise) AS gross FROM explained GROUP BY ALL
), own AS (SELECT p.settlement_id, p.n_explanations, p.integrity, t.k, t.d, t.net, t.gross, s.net_paise AS credit FROM proposed p JOIN totals t USING (settlement_id) JOIN settlements s USING (settlement_id) WHERE p.verdict = 'PROVEN')
SELECT settlement_id, 1 AS line_no, 'residual within tolerance' AS statement, abs(credit - net) <= k AS ok FROM own UNION ALL SELECT settlement_id, 2, 'no order twice', k = d FROM own UNION ALL SELECT settlement_id, 3, 'fees not negative', gross >= net FROM own
UNION ALL SELECT settlement_id, 4, 'only explanation found', n_explanations = 1 FROM own UNION ALL SELECT settlement_id, 5, 'space reduced without guesses', CASE integrity WHEN 'VALIDATED' THEN true WHEN 'COMPROMISED' THEN false END FROM own""")
def proof_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    explained, found = _proposed(spark, sf_dir)
    return evidence.certificate_lines(found, explained, base(spark, sf_dir)[1])


@query(VIEWS + POOLS + """, rows AS (SELECT settlement_id, credit_paise, list(net_paise ORDER BY net_paise DESC, order_id) AS nets FROM pool GROUP BY ALL
), fill AS (SELECT settlement_id, credit_paise, list_reduce(nets, lambda a, x: CASE WHEN a % 100000000000 + x <= credit_paise THEN a + x + 100000000000 ELSE a END, CAST(0 AS BIGINT)) AS packed FROM rows)
SELECT settlement_id, CAST(packed // 100000000000 AS INTEGER) AS n_orders, packed % 100000000000 AS filled_paise, credit_paise - packed % 100000000000 AS unexplained_paise FROM fill""")
def closest_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    return evidence.closest_partial(payouts, orders)


@query(VIEWS + POOLS + """, placed AS (SELECT settlement_id, order_id, net_paise, row_number() OVER w AS lane, coalesce(sum(net_paise) OVER (PARTITION BY settlement_id ORDER BY net_paise DESC, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above_paise FROM pool WINDOW w AS (PARTITION BY settlement_id ORDER BY net_paise DESC, order_id))
SELECT settlement_id, CAST(lane AS INTEGER) AS lane, order_id, net_paise, CAST(above_paise AS BIGINT) AS above_paise FROM placed WHERE lane <= 18
UNION ALL SELECT settlement_id, 19, '+' || count(*) FILTER (lane > 18), CAST(sum(net_paise) FILTER (lane > 18) AS BIGINT), CAST(sum(net_paise) FILTER (lane <= 18) AS BIGINT) FROM placed GROUP BY settlement_id HAVING count(*) > 18""")
def evidence_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    return evidence.pool_lanes(payouts, orders)


@query(VIEWS + POOLS + """SELECT settlement_id, CAST(place AS INTEGER) AS place, captured_on, n FROM (SELECT *, row_number() OVER (PARTITION BY settlement_id ORDER BY n DESC, captured_on) AS place FROM (SELECT settlement_id, captured_on, count(*) AS n FROM pool GROUP BY ALL)) WHERE place <= 3""")
def densest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    return evidence.densest_days(blocking.pool_days(payouts, orders))


@query(VIEWS + FINDINGS + """, placed AS (SELECT candidates, row_number() OVER (ORDER BY candidates) - 1 AS r, count(*) OVER () AS total FROM space)
SELECT share, min(candidates) AS value FROM placed JOIN (VALUES (CAST(0.5 AS DOUBLE)), (0.9), (0.99), (1.0)) v(share) ON r = CAST(floor(share * (total - 1) + 0.5) AS BIGINT) GROUP BY share""")
def pool_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    return evidence.nearest_rank(blocking.search_space(payouts, orders).select("candidates"), "candidates", (0.5, 0.9, 0.99, 1.0))


_COMPONENTS = VIEWS.replace("WITH captures0", "WITH RECURSIVE captures0") + POOLS + """, claims AS (SELECT DISTINCT settlement_id, order_id FROM pool WHERE abs(net_paise - credit_paise) <= 1
), edges AS (SELECT DISTINCT a.settlement_id AS a, b.settlement_id AS b FROM claims a JOIN claims b USING (order_id)
), walk AS (SELECT a AS settlement_id, b AS other FROM edges UNION SELECT w.settlement_id, e.b FROM walk w JOIN edges e ON e.a = w.other
), parts AS (SELECT settlement_id, min(other) AS component FROM walk GROUP BY settlement_id)"""


@query(_COMPONENTS + "SELECT * FROM parts")
def conflict_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.conflict_components(_fits(spark, sf_dir))


@query(_COMPONENTS + "SELECT CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' WHEN n <= 50 THEN '11-50' WHEN n <= 200 THEN '51-200' ELSE '200+' END AS bucket, count(*) AS components FROM (SELECT component, count(*) AS n FROM parts GROUP BY component) GROUP BY bucket")
def component_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.size_histogram(conflict_components(spark, sf_dir))


@query(_ITEMS + "SELECT period_id, settlement_id, exposure_paise, CAST(row_number() OVER (PARTITION BY period_id ORDER BY exposure_paise DESC, settlement_id) AS INTEGER) AS rank FROM items WHERE kind IS NOT NULL")
def exposure_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _items(spark, sf_dir)[0].where("kind is not null").select("period_id", "settlement_id", "exposure_paise")
    return evidence.ranked(own, F.desc("exposure_paise"), F.col("settlement_id"))


@query(_CARRIED + "SELECT period_id, settlement_id, probability, exposure_paise, CAST(row_number() OVER (PARTITION BY period_id ORDER BY probability, exposure_paise DESC, settlement_id) AS INTEGER) AS rank FROM predicted JOIN carried USING (settlement_id)")
def prediction_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    carried = _featured(*_items(spark, sf_dir))
    rows = prediction.predict(carried).select("settlement_id", "probability").join(carried.select("settlement_id", "period_id", "exposure_paise"), "settlement_id")
    return evidence.ranked(rows.select("period_id", "settlement_id", "probability", "exposure_paise"), F.col("probability"), F.desc("exposure_paise"), F.col("settlement_id"))


@query("WITH reviewed AS (" + CLOSE_SQL["review_queue"] + ") SELECT period_id, settlement_id, priority, exposure_paise, close_impact, CAST(row_number() OVER (PARTITION BY period_id ORDER BY priority DESC, exposure_paise DESC, settlement_id) AS INTEGER) AS rank FROM reviewed")
def review_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review queue of each period in its order."""
    rows = review_queue(spark, sf_dir).select("period_id", "settlement_id", "priority", "exposure_paise", "close_impact")
    return evidence.ranked(rows, F.desc("priority"), F.desc("exposure_paise"), F.col("settlement_id"))


@query(_CARRIED + "SELECT period_id, settlement_id, exposure_paise, age_days, CAST(row_number() OVER (PARTITION BY period_id ORDER BY exposure_paise DESC, settlement_id) AS INTEGER) AS rank FROM carried")
def carry_forward_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readiness.carry_forward(_items(spark, sf_dir)[0]).select("period_id", "settlement_id", "exposure_paise", "age_days")
    return evidence.ranked(rows, F.desc("exposure_paise"), F.col("settlement_id"))


@query(_CARRIED + "SELECT period_id, count(*) AS items, CAST(sum(exposure_paise) AS BIGINT) AS carried_paise, max(age_days) AS oldest_days FROM carried GROUP BY period_id")
def carry_forward_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readiness.carry_forward(_items(spark, sf_dir)[0])
    return rows.groupBy("period_id").agg(F.count("*").alias("items"), F.sum("exposure_paise").alias("carried_paise"), F.max("age_days").alias("oldest_days"))


_PLACES = "CASE scenario WHEN 'BASELINE' THEN 0 WHEN 'CLEAR_POLICY_BLOCKS' THEN 1 WHEN 'RESOLVE_AMBIGUOUS' THEN 2 WHEN 'RESOLVE_HIGH' THEN 3 ELSE 4 END"


@query("WITH outcomes AS (" + CLOSE_SQL["simulate_scenarios"] + f"""), placed AS (SELECT *, {_PLACES} AS place, verdict <> 'BLOCKED' AS closes FROM outcomes
), best AS (SELECT *, row_number() OVER (PARTITION BY period_id ORDER BY CASE WHEN closes THEN 0 ELSE 1 END, CASE WHEN closes THEN place ELSE 0 END, CASE WHEN closes THEN 0 ELSE material_exposure_paise END, net_unresolved_paise, place) AS r FROM placed)
SELECT period_id, scenario, closes AS closeable FROM best WHERE r = 1""")
def recommended_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.recommended(simulate_scenarios(spark, sf_dir))


@query(VIEWS + """, days AS (SELECT strftime(settled_on, '%Y-%m') AS period_id, settled_on, sha256(string_agg(settlement_id || '|' || net_paise || '|' || coalesce(utr, '-'), chr(10) ORDER BY settlement_id || '|' || net_paise || '|' || coalesce(utr, '-'))) AS day FROM settlements GROUP BY ALL)
SELECT period_id, sha256(string_agg(day, chr(10) ORDER BY settled_on)) AS checksum FROM days GROUP BY period_id""")
def source_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.checksums(base(spark, sf_dir)[1])


@query(_JUDGED + """, wrong AS (SELECT f.settlement_id FROM findings f LEFT JOIN true_sets t USING (settlement_id) WHERE f.verdict = 'PROVEN' AND NOT coalesce(t.k = 1 AND t.true_order = f.order_id, false)
), own AS (SELECT j.*, w.settlement_id IS NOT NULL AS bad FROM judged j LEFT JOIN wrong w ON w.settlement_id = j.settlement_id)
SELECT count(*) FILTER (decision = 'AUTO_POST') AS posted, count(*) FILTER (decision = 'REVIEW') AS reviewed, count(*) FILTER (decision = 'BLOCK') AS blocked, CAST(coalesce(sum(net_paise) FILTER (decision = 'AUTO_POST'), 0) AS BIGINT) AS posted_paise,
    CAST(coalesce(sum(net_paise) FILTER (decision <> 'AUTO_POST' AND bad), 0) AS BIGINT) AS protected_paise, CAST(coalesce(sum(expected_loss) FILTER (decision = 'AUTO_POST'), 0) AS BIGINT) AS expected_loss,
    CAST(coalesce(sum(250000 + net_paise * 3000 // 10000) FILTER (decision = 'AUTO_POST' AND bad), 0) AS BIGINT) AS realised_loss FROM own""")
def policy_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, judged = _judged(spark, sf_dir)
    orders, _ = base(spark, sf_dir)
    true = views.truth(orders).groupBy("settlement_id").agg(F.count("*").alias("k"), F.min("order_id").alias("true_order"))
    right = (F.col("k") == 1) & (F.col("true_order") == F.col("order_id"))
    return evidence.policy_simulation(judged, found.where("verdict = 'PROVEN'").join(true, "settlement_id", "left").where(~F.coalesce(right, F.lit(False))))


@query(_EXPLAINED + """, cited AS (SELECT settlement_id, unnest(string_split(proof, ' ')) AS order_id FROM proposed WHERE proof IS NOT NULL
), members AS (SELECT DISTINCT settlement_id, order_id FROM truth
), met AS (SELECT coalesce(c.settlement_id, t.settlement_id) AS settlement_id, count(*) FILTER (c.order_id IS NOT NULL AND t.order_id IS NOT NULL) AS tp, count(*) FILTER (t.order_id IS NULL) AS fp, count(*) FILTER (c.order_id IS NULL) AS fn
    FROM cited c FULL JOIN members t ON c.settlement_id = t.settlement_id AND c.order_id = t.order_id GROUP BY ALL
), own AS (SELECT s.hazard, p.layer, p.verdict = 'PROVEN' AS said, m.* FROM proposed p JOIN settlements s USING (settlement_id) JOIN met m USING (settlement_id))
SELECT coalesce(hazard, 'all') AS hazard, count(*) AS n, count(*) FILTER (said AND fp = 0 AND fn = 0) AS exact, count(*) FILTER (NOT said) AS declined, count(*) FILTER (said AND (fp > 0 OR fn > 0)) AS wrong,
    CAST(sum(CASE WHEN said THEN tp ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN said THEN fp ELSE 0 END) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM own GROUP BY ROLLUP (hazard)""")
def harness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    _, found = _proposed(spark, sf_dir)
    return reports.harness(found, views.truth(orders), payouts.select("settlement_id", "hazard"))
