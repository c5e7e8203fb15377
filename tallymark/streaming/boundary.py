"""The boundary that signed deliveries pass: signature, shape, idempotence, what they name.

Deliveries are rows (provider, body: text, signature, arrival). Everything is column expressions, so the
same functions serve batch and stream, but for the walk through nested JSON, a small vectorised helper.
"""

from __future__ import annotations

import hmac
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallymark.streaming.events import repeated

#: Kinds of events that are acted on, and keys under which records are named (fixed values).
HANDLED = ("payment.captured", "payment.failed", "refund.created", "refund.processed", "settlement.processed", "payment.dispute.created")
ENTITY_KEYS = ("id", "order_id", "payment_id", "refund_id", "settlement_id", "entity_id", "invoice_id")


def hmac_sha256(body: Column, secret: bytes) -> Column:
    """HMAC-SHA256 of a text's bytes, in lower-case hex. The key goes to tasks inside the function, so that no plan or log shows it."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda text: None if text is None else hmac.new(secret, text.encode(), "sha256").hexdigest()).astype("object")

    return pandas_udf(run, "string")(body)


def canonical(text: str | None) -> str | None:
    """JSON with sorted keys and no spaces; null where it isn't an object."""
    try:
        value = json.loads(text)
    except (TypeError, ValueError):
        return None
    return json.dumps(value, sort_keys=True, separators=(",", ":")) if isinstance(value, dict) else None


def named(text: str | None) -> list[str]:
    """Every string under one of ENTITY_KEYS, at any depth, ascending; none where it isn't JSON."""
    try:
        left = [json.loads(text)]
    except (TypeError, ValueError):
        return []
    out: set[str] = set()
    while left:
        value = left.pop()
        if isinstance(value, dict):
            out |= {v for k, v in value.items() if k in ENTITY_KEYS and isinstance(v, str) and v}
            left += value.values()
        elif isinstance(value, list):
            left += value
    return sorted(out)


def canonical_json(body: Column) -> Column:
    return pandas_udf(lambda s: s.map(canonical).astype("object"), "string")(body)


def entities(body: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(named)

    return pandas_udf(run, "array<string>")(body)


def received(deliveries: DataFrame, secret: bytes | None) -> DataFrame:
    """Every delivery with event_id, kind, digest and status.

    Without a secret all are ``unverifiable``; a missing or wrong signature and a body that isn't a JSON object
    are ``bad_signature``. Of the others the first of an event counts: the same digest again is a
    ``duplicate``, another one a ``replay_mismatch``; kinds that aren't handled are ``unsupported``. Of deliveries
    that arrive at the same time the one with the smallest digest, then kind, is first, and of equal ones one.
    """
    text = canonical_json(F.col("body"))
    own = deliveries.withColumn("canonical", text)
    signed = F.lit(False) if not secret else F.coalesce(F.col("signature") == hmac_sha256(F.col("body"), secret), F.lit(False))
    checked = F.when(F.lit(not secret), "unverifiable").when(~signed | F.col("canonical").isNull(), "bad_signature")
    own = own.select(
        "provider", "arrival", "body", F.coalesce(F.get_json_object("body", "$.id"), F.substring(F.sha2("body", 256), 1, 24)).alias("event_id"), F.coalesce(F.get_json_object("body", "$.event"), F.lit("unknown")).alias("kind"),
        F.sha2("canonical", 256).alias("digest"), checked.alias("checked"),
    )
    counts = F.col("checked").isNull()
    status = F.when(~counts, F.col("checked")).when(~F.col("kind").isin(*HANDLED), "unsupported").otherwise("accepted")
    return repeated(own, counts, status, "duplicate", "replay_mismatch").select("provider", "event_id", "kind", "arrival", "body", "status")


def owed(logged: DataFrame, since: int) -> DataFrame:
    """(entity, n_events, last_kind): what accepted events after ``since`` name, so that verdicts on it are stale."""
    late = logged.where((F.col("status") == "accepted") & (F.col("arrival") > since)).select("arrival", "kind", F.explode(entities(F.col("body"))).alias("entity"))
    return late.groupBy("entity").agg(F.count("*").alias("n_events"), F.max_by("kind", F.struct("arrival", "kind")).alias("last_kind"))
