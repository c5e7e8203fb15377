"""Settlement-domain views over the driver's star schema.

captures: one payment for each line item. settlements: captures of a day and one of eight
desks, settled two business days later; fixed shares of them are late or off by an amount, as
real payouts are. credits: the bank's side. truth: which captures a settlement is made of.
``SQL`` has the same views for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import calendar as cal
from tallymark.functions import money

DESKS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, captured_on, gross_paise, method, payment_id, net_paise, truth_id."""
    line = _table(spark, sf_dir, "lineitem")
    day = F.col("l_shipdate").cast("date")
    turn = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(4))
    method = F.when(turn == 0, "upi").when(turn == 1, "card").when(turn == 2, "netbanking").otherwise("wallet")
    rows = line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format(day, "yyyyMMdd"), F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")).alias("order_id"),
        day.alias("captured_on"),
        F.floor("l_extendedprice").cast("long").alias("gross_paise"),
        method.alias("method"),
        F.when(F.col("l_returnflag") != "R", F.concat(F.lit("pay_"), F.col("l_orderkey").cast("string"))).alias("payment_id"),
        _key(day, F.col("l_suppkey")).alias("truth_key"),
    )
    return rows.withColumn("net_paise", money.net(F.col("gross_paise"), F.col("method")))


def _key(day: Column, supplier: Column) -> Column:
    return (F.datediff(day, F.lit("1992-01-01").cast("date")) * DESKS + F.pmod(supplier, F.lit(DESKS))).cast("long")


def settlements(payments: DataFrame) -> DataFrame:
    """settlement_id, settled_on, net_paise, utr (null for some), n_orders, hazard, truth_key."""
    grouped = payments.groupBy("truth_key").agg(F.min("captured_on").alias("captured_on"), F.sum("net_paise").alias("clean"), F.min("net_paise").alias("least"), F.count("*").alias("n_orders"))
    k = F.col("truth_key")
    turn = F.pmod(k, F.lit(20))
    hazard = F.when(turn == 0, "timing_gap").when(turn == 1, "refund_offset").when(turn == 2, "split_order").when(turn == 3, "chargeback").when(turn == 4, "orphan").otherwise("clean")
    off = F.when(turn == 1, F.lit(-5000)).when(turn == 2, -money.floor_div(F.col("least"), 2)).when(turn == 3, F.lit(-12345)).when(turn == 4, F.lit(7777)).otherwise(0)
    return grouped.select(
        F.concat(F.lit("setl_"), F.lpad(k.cast("string"), 6, "0")).alias("settlement_id"),
        cal.business_days_after(F.col("captured_on"), F.when(turn == 0, 4).otherwise(2)).alias("settled_on"),
        (F.col("clean") + off).cast("long").alias("net_paise"),
        F.when(F.pmod(k, F.lit(50)) != 7, F.lpad(F.pmod(k * 7919 + 123456789, F.lit(1_000_000_000_000)).cast("string"), 12, "0")).alias("utr"),
        F.col("n_orders").cast("long").alias("n_orders"),
        hazard.alias("hazard"),
        "truth_key",
    )


def credits(payouts: DataFrame) -> DataFrame:
    """txn_id, value_date, credit_paise, narration: one bank credit for each settlement."""
    ref = F.coalesce("utr", F.lit("NA"))
    return payouts.select(
        F.concat(F.lit("bank_"), F.substring("settlement_id", 6, 20)).alias("txn_id"),
        F.col("settled_on").alias("value_date"),
        F.col("net_paise").alias("credit_paise"),
        F.when(F.pmod("truth_key", F.lit(25)) == 3, F.concat(F.lit("neft "), F.substring(ref, 1, 6), F.lit("xx"))).otherwise(F.concat(F.lit("NEFT-"), ref, F.lit("-GATEWAY PVT LTD-SETTLEMENT"))).alias("narration"),
    )


def truth(payments: DataFrame, *more: str) -> DataFrame:
    """(settlement_id, order_id) and ``more`` columns of the payment: what each settlement was made of."""
    return payments.select(F.concat(F.lit("setl_"), F.lpad(F.col("truth_key").cast("string"), 6, "0")).alias("settlement_id"), "order_id", *more)




def _sql_bizadd(day: str, n: str) -> str:
    return f"CAST({day} + CAST(LEAST(isodow({day}) - 1, 4) - (isodow({day}) - 1) + ({n}) + 2 * ((LEAST(isodow({day}) - 1, 4) + ({n})) // 5) AS INTEGER) AS DATE)"


#: The views as common table expressions; a query goes on with ``SELECT`` or ``, name AS (``.
SQL = f"""
WITH captures0 AS (
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(CAST(l_shipdate AS DATE), '%Y%m%d'), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) AS order_id,
        CAST(l_shipdate AS DATE) AS captured_on, CAST(floor(l_extendedprice) AS BIGINT) AS gross_paise,
        CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'upi' WHEN 1 THEN 'card' WHEN 2 THEN 'netbanking' ELSE 'wallet' END AS method,
        CASE WHEN l_returnflag <> 'R' THEN 'pay_' || l_orderkey END AS payment_id,
        CAST(datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) * {DESKS} + l_suppkey % {DESKS} AS BIGINT) AS truth_key
    FROM lineitem
), captures1 AS (
    SELECT *, (gross_paise * CASE method WHEN 'upi' THEN 0 WHEN 'card' THEN 200 WHEN 'netbanking' THEN 150 ELSE 250 END + 5000) // 10000 AS fee_paise FROM captures0
), captures AS (
    SELECT *, (fee_paise * 1800 + 5000) // 10000 AS tax_paise, gross_paise - fee_paise - (fee_paise * 1800 + 5000) // 10000 AS net_paise FROM captures1
), settlements0 AS (
    SELECT truth_key, min(captured_on) AS captured_on, CAST(sum(net_paise) AS BIGINT) AS clean, min(net_paise) AS least_net, count(*) AS n_orders FROM captures GROUP BY truth_key
), settlements AS (
    SELECT 'setl_' || lpad(CAST(truth_key AS VARCHAR), 6, '0') AS settlement_id,
        {_sql_bizadd("captured_on", "CASE WHEN truth_key % 20 = 0 THEN 4 ELSE 2 END")} AS settled_on,
        CAST(clean + CASE truth_key % 20 WHEN 1 THEN -5000 WHEN 2 THEN -(least_net // 2) WHEN 3 THEN -12345 WHEN 4 THEN 7777 ELSE 0 END AS BIGINT) AS net_paise,
        CASE WHEN truth_key % 50 <> 7 THEN lpad(CAST((truth_key * 7919 + 123456789) % 1000000000000 AS VARCHAR), 12, '0') END AS utr,
        n_orders,
        CASE truth_key % 20 WHEN 0 THEN 'timing_gap' WHEN 1 THEN 'refund_offset' WHEN 2 THEN 'split_order' WHEN 3 THEN 'chargeback' WHEN 4 THEN 'orphan' ELSE 'clean' END AS hazard,
        truth_key
    FROM settlements0
), credits AS (
    SELECT 'bank_' || substr(settlement_id, 6, 20) AS txn_id, settled_on AS value_date, net_paise AS credit_paise,
        CASE WHEN truth_key % 25 = 3 THEN 'neft ' || substr(coalesce(utr, 'NA'), 1, 6) || 'xx' ELSE 'NEFT-' || coalesce(utr, 'NA') || '-GATEWAY PVT LTD-SETTLEMENT' END AS narration
    FROM settlements
), truth AS (
    SELECT 'setl_' || lpad(CAST(truth_key AS VARCHAR), 6, '0') AS settlement_id, order_id FROM captures
)
"""
