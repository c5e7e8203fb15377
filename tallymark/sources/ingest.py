"""Gateway rows to typed tables: exact amounts, identities, first-wins dedup, rejections.

Rows arrive as text, amounts in any spelling. Nothing is rounded and nothing is dropped
silently: a row is accepted, a duplicate, or rejected with its index and a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings of amounts that are read: digits, one point, an exponent without sign games.
AMOUNT = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\s*$"
METHODS = {"upi": "upi", "card": "card", "emi": "card", "netbanking": "netbanking", "wallet": "wallet"}


def parse_amount(raw: Column, unit: str = "paise") -> tuple[Column, Column]:
    """(paise or null, reason or null) of an amount given as text."""
    value = F.when(raw.rlike(AMOUNT), F.trim(raw).try_cast("decimal(38,18)"))
    scaled = value * (100 if unit == "rupees" else 1)
    reason = (
        F.when(raw.isNull() | (F.trim(raw) == ""), "EMPTY").when(~raw.rlike(AMOUNT), "NOT_A_NUMBER").when(value.isNull(), "TOO_LARGE")
        .when(value < 0, "NEGATIVE").when(scaled != F.floor(scaled), "FRACTIONAL_PAISE")
    )
    return F.when(reason.isNull(), F.floor(scaled).cast("long")), reason


def identity(*ids: Column) -> tuple[Column, Column]:
    """(identity, conflict): the one id a row has under several names; empty if none."""
    known = F.array_distinct(F.filter(F.transform(F.array(*ids), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    return F.coalesce(F.get(known, F.lit(0)), F.lit("")), F.size(known) > 1


def normalised(rows: DataFrame, unit: str = "paise") -> DataFrame:
    """Gateway rows (idx, kind, entity_id, payment_id, amount, method, settlement_id, created_at)
    with identity, amount, status and reason; of rows with one kind and identity the first counts."""
    own_id, conflict = identity(F.col("payment_id"), F.col("entity_id"))
    paise, why = parse_amount(F.col("amount"), unit)
    read = rows.withColumn("identity", own_id).withColumn("conflict", conflict).withColumn("amount_paise", paise).withColumn("amount_reason", why)
    first = read.where("identity <> ''").groupBy("kind", "identity").agg(F.min("idx").alias("first_idx"))
    own = read.join(first, ["kind", "identity"], "left")
    method = F.create_map(*[F.lit(x) for pair in METHODS.items() for x in pair])[F.col("method")]
    reason = (
        F.when(F.col("conflict"), "IDENTITY_CONFLICT").when(F.col("amount_reason").isNotNull(), F.col("amount_reason"))
        .when((F.col("kind") == "payment") & method.isNull(), "UNKNOWN_METHOD")
    )
    status = F.when(F.col("idx") > F.col("first_idx"), "DUPLICATE").when(F.col("conflict") | F.col("amount_reason").isNotNull(), "REJECTED").when(reason.isNotNull(), "UNMATCHED").otherwise("ACCEPTED")
    return own.select("idx", "kind", "identity", "settlement_id", "created_at", method.alias("method"), "amount_paise", status.alias("status"), F.when(status != "DUPLICATE", reason).alias("reason"))


def settlement_rollup(read: DataFrame) -> DataFrame:
    """Per settlement: the sum of credits less debits over all counted rows, unmatched ones too."""
    signed = F.when(F.col("kind") == "payment", F.col("amount_paise")).otherwise(-F.col("amount_paise"))
    return read.where("status in ('ACCEPTED', 'UNMATCHED')").groupBy("settlement_id").agg(F.sum(signed).alias("net_paise"), F.count("*").alias("rows"), F.max("created_at").alias("settled_at"))


def objects(lines: DataFrame) -> DataFrame:
    """Lines (idx, line) of JSON: idx, fields (null where the line isn't an object) and the reason against it."""
    fields = F.from_json("line", "map<string,string>")
    return lines.select("idx", fields.alias("fields"), F.when(fields.isNull(), "NOT_AN_OBJECT").alias("reason"))


def snapshot(lines: DataFrame) -> DataFrame:
    """One row for a load of payment lines: rows, rejects, orders, the share of orders linked to a payment,
    gross (the amount, else credit, fee and tax together) and the last reference seen."""
    read = objects(lines)

    def whole(name: str) -> Column:
        return F.col("fields")[name].try_cast("bigint")

    ok = F.col("reason").isNull()
    gross = F.coalesce(whole("amount"), whole("credit") + whole("fee") + whole("tax"))
    linked = ok & (F.trim(F.coalesce(F.col("fields")["order_id"], F.lit(""))) != "")
    sums = read.agg(F.count("*").alias("rows"), F.count_if(~ok).alias("rejected"), F.count_if(ok).alias("orders"), F.count_if(linked).alias("linked"), F.sum(gross).alias("gross_paise"), F.max_by(F.col("fields")["utr"], F.when(F.col("fields")["utr"].isNotNull(), F.col("idx"))).alias("last_utr"))
    return sums.select("rows", "rejected", "orders", "gross_paise", "last_utr", F.round(F.col("linked") / F.greatest(F.col("orders"), F.lit(1)), 6).alias("linked_fraction"))
