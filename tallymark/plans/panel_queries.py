"""Queries over many payouts at once: landscapes, gates, reason shapes, tallies, panels, versions, loads."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import money
from tallymark.operators import blocking, cascade, evidence, setpacking
from tallymark.plans import boundary_queries, evidence_queries
from tallymark.plans.close_queries import _judged
from tallymark.plans.evidence_queries import _EXPLAINED, _explained
from tallymark.plans.recon_queries import FINDINGS, base, findings_of
from tallymark.sources import ingest
from tallymark.sources.shared import once
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


@query(VIEWS + FINDINGS + "SELECT 'date_window' AS reduction, false AS deterministic, count(*) FILTER (removed_by_date > 0) AS payouts, CAST(sum(removed_by_date) AS BIGINT) AS removed FROM space UNION ALL SELECT 'amount_ceiling', true, count(*) FILTER (removed_by_amount > 0), CAST(sum(removed_by_amount) AS BIGINT) FROM space")
def evidence_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    return evidence.landscape(blocking.search_space(payouts, orders))


def _with(name: str, sql: str) -> str:
    return f"WITH {name} AS ({sql})"


@query(_with("judged", boundary_queries._JUDGED + "SELECT * FROM judged") + ", posts AS (" + evidence_queries.SQL["why_not_postable"] + """), own AS (SELECT j.*, p.postable FROM judged j JOIN posts p USING (settlement_id))
SELECT settlement_id, 1 AS gate_no, 'proven' AS gate, verdict = 'PROVEN' AS passed FROM own UNION ALL SELECT settlement_id, 2, 'postable', postable FROM own UNION ALL SELECT settlement_id, 3, 'measured', p_error IS NOT NULL FROM own
UNION ALL SELECT settlement_id, 4, 'under the ceiling', net_paise <= 10000000 FROM own UNION ALL SELECT settlement_id, 5, 'cheaper than review', coalesce(expected_loss < 25000, false) FROM own""")
def decision_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.gates(_judged(spark, sf_dir)[1], evidence_queries.why_not_postable(spark, sf_dir))


@query(VIEWS + FINDINGS + """, told AS (SELECT settlement_id, net_paise, verdict || ': ₹' || CAST(floor(net_paise / 100.0) AS BIGINT) || ' of  ' || candidates || ' orders — see ' || settlement_id AS reason FROM findings
), shaped AS (SELECT *, trim(regexp_replace(regexp_replace(string_split_regex(reason, '[—;]')[1], '[₹0-9,.]+', '', 'g'), '\\s+', ' ', 'g')) AS shape FROM told)
SELECT shape, count(*) AS n, CAST(sum(net_paise) AS BIGINT) AS amount_paise, arg_min(settlement_id, (-net_paise, settlement_id)) AS largest FROM shaped GROUP BY shape""")
def reason_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.concat(F.col("verdict"), F.lit(": ₹"), money.floor_div(F.col("net_paise"), 100).cast("string"), F.lit(" of  "), F.col("candidates").cast("string"), F.lit(" orders — see "), F.col("settlement_id"))
    return evidence.reason_shapes(findings_of(spark, sf_dir).withColumn("reason", told), "reason", "net_paise", "settlement_id")


@query("WITH tested AS (" + boundary_queries.SQL["falsified_anchors"] + "), dated AS (" + VIEWS + FINDINGS + """SELECT settlement_id, count(DISTINCT captured_on) = 1 AS one_day FROM pool GROUP BY settlement_id)
SELECT outcome, count(*) AS n, count(*) FILTER (one_day) AS n_one_day FROM tested JOIN dated USING (settlement_id) GROUP BY outcome""")
def anchoring_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    days = blocking.pool_days(payouts, orders).groupBy("settlement_id").agg((F.count("captured_on") == 1).alias("one_day"))
    return boundary_queries.falsified_anchors(spark, sf_dir).join(days, "settlement_id").groupBy("outcome").agg(F.count("*").alias("n"), F.count_if("one_day").alias("n_one_day"))


@query(_EXPLAINED + """, cited AS (SELECT settlement_id, unnest(string_split(proof, ' ')) AS order_id FROM proposed WHERE proof IS NOT NULL), members AS (SELECT DISTINCT settlement_id, order_id FROM truth
), wrong AS (SELECT DISTINCT coalesce(c.settlement_id, t.settlement_id) AS settlement_id FROM cited c FULL JOIN members t ON c.settlement_id = t.settlement_id AND c.order_id = t.order_id WHERE c.order_id IS NULL OR t.order_id IS NULL
), own AS (SELECT year(s.settled_on) AS panel, p.verdict, s.net_paise, w.settlement_id IS NOT NULL AS off FROM proposed p JOIN settlements s USING (settlement_id) LEFT JOIN wrong w USING (settlement_id))
SELECT coalesce(CAST(panel AS VARCHAR), 'pooled') AS panel, count(*) AS n, count(*) FILTER (verdict = 'PROVEN' AND NOT off) AS exact, count(*) FILTER (verdict = 'PROVEN' AND off) AS wrong, max(abs(net_paise)) FILTER (verdict = 'PROVEN' AND off) AS largest_wrong FROM own GROUP BY ROLLUP (panel)""")
def pooled_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and wrong findings by year and pooled over all years."""
    from tallymark.sources import views

    orders, payouts = base(spark, sf_dir)
    _, found = evidence_queries._proposed(spark, sf_dir)
    cited = found.where("proof is not null").select("settlement_id", F.explode(F.split("proof", " ")).alias("order_id"), F.lit(1).alias("c"))
    off = cited.join(views.truth(orders).distinct().withColumn("t", F.lit(1)), ["settlement_id", "order_id"], "full_outer").where("c is null or t is null").select("settlement_id").distinct().withColumn("off", F.lit(True))
    own = found.join(payouts.select("settlement_id", F.year("settled_on").alias("panel"), "net_paise"), "settlement_id").join(off, "settlement_id", "left")
    bad = (F.col("verdict") == "PROVEN") & F.coalesce("off", F.lit(False))
    sums = own.rollup("panel").agg(F.count("*").alias("n"), F.count_if((F.col("verdict") == "PROVEN") & ~F.coalesce("off", F.lit(False))).alias("exact"), F.count_if(bad).alias("wrong"), F.max(F.when(bad, F.abs("net_paise"))).alias("largest_wrong"))
    return sums.withColumn("panel", F.coalesce(F.col("panel").cast("string"), F.lit("pooled")))


_RULES = {"currency": "INR", "fee_bps": money.FEE_BPS, "tax_bps": money.TAX_BPS, "lag_days": 2, "tolerance_paise": 1}
_CANONICAL = json.dumps(_RULES, sort_keys=True, separators=(",", ":"))


@query(f"SELECT key AS rule, value, 'rules_' || substr(sha256('{_CANONICAL}'), 1, 12) AS version FROM (VALUES " + ", ".join(f"('{k}', '{json.dumps(v, sort_keys=True)}')" for k, v in sorted(_RULES.items())) + ") r(key, value)")
def rule_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules in use, each with the version that their canonical JSON gives."""
    version = "rules_" + hashlib.sha256(_CANONICAL.encode()).hexdigest()[:12]
    return spark.createDataFrame([(k, json.dumps(v, sort_keys=True), version) for k, v in sorted(_RULES.items())], "rule string, value string, version string")


_LINES = """WITH lines AS (SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 29 = 3 THEN '[1, 2]' WHEN o_orderkey % 31 = 4 THEN 'broken {' ELSE '{"order_id": "' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'ord_' || o_orderkey END || '", ' ||
    CASE WHEN o_orderkey % 3 = 0 THEN '"credit": 90, "fee": 8, "tax": 2' ELSE '"amount": ' || o_custkey END || CASE WHEN o_orderkey % 50 = 0 THEN ', "utr": "' || o_orderkey || '"' ELSE '' END || '}' END AS line FROM orders
), read AS (SELECT idx, CASE WHEN json_valid(line) THEN CASE WHEN json_type(line) = 'OBJECT' THEN line END END AS line FROM lines)"""


@query(_LINES + """SELECT count(*) AS rows, count(*) FILTER (line IS NULL) AS rejected, count(line) AS orders, CAST(sum(coalesce(CAST(json_extract_string(line, '$.amount') AS BIGINT), CAST(json_extract_string(line, '$.credit') AS BIGINT) + CAST(json_extract_string(line, '$.fee') AS BIGINT) + CAST(json_extract_string(line, '$.tax') AS BIGINT))) AS BIGINT) AS gross_paise,
    arg_max(json_extract_string(line, '$.utr'), idx) FILTER (json_extract_string(line, '$.utr') IS NOT NULL) AS last_utr, round(count(*) FILTER (trim(json_extract_string(line, '$.order_id')) <> '') / greatest(count(line), 1), 6) AS linked_fraction FROM read""")
def recon_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    amount = F.when(F.pmod(k, F.lit(3)) == 0, '"credit": 90, "fee": 8, "tax": 2').otherwise(F.concat(F.lit('"amount": '), F.col("o_custkey").cast("string")))
    line = F.concat(F.lit('{"order_id": "'), F.when(F.pmod(k, F.lit(5)) == 0, "").otherwise(F.concat(F.lit("ord_"), k.cast("string"))), F.lit('", '), amount, F.when(F.pmod(k, F.lit(50)) == 0, F.concat(F.lit(', "utr": "'), k.cast("string"), F.lit('"'))).otherwise(""), F.lit("}"))
    lines = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("idx"), F.when(F.pmod(k, F.lit(29)) == 3, "[1, 2]").when(F.pmod(k, F.lit(31)) == 4, "broken {").otherwise(line).alias("line"))
    return ingest.snapshot(lines)


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = once("explained", (base(spark, sf_dir)[0],), lambda: _explained(spark, sf_dir)).groupBy("settlement_id", "explanation").agg(F.sum("net_paise").alias("net_paise"))
    return own.select("settlement_id", F.xxhash64("explanation").alias("explanation"), "net_paise", F.split("explanation", " ").alias("order_ids"))


@query()
def packed_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the small explanations can hold together, and which have to."""
    return setpacking.packed(_sets(spark, sf_dir))


@query()
def propagated_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the small explanations once orders have owners."""
    return cascade.propagated(_sets(spark, sf_dir))


@query()
def unsat_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payouts whose small explanations can't all hold."""
    return setpacking.unsat_cores(_sets(spark, sf_dir))


@query()
def packed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every payout's verdict by what packing forces."""
    return setpacking.packed_findings(base(spark, sf_dir)[1], _sets(spark, sf_dir))
