"""Idempotent event log: a batch form, and the same as a stateful stream.

An event is known by provider and id. The first body seen is kept; the same body again is a
DUPLICATE, another one a REPLAY_MISMATCH, an unknown kind UNSUPPORTED, else ACCEPTED. Of arrivals
at the same time the one with the smallest digest, then kind, is first, and of rows that are equal throughout
one; null providers and ids are a key like any other. State
is kept without end unless a time to live is given, since a late repetition must still be
found.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUS = ("ACCEPTED", "DUPLICATE", "REPLAY_MISMATCH", "UNSUPPORTED")


def digest(body: Column) -> Column:
    return F.sha2(body, 256)


def classified(events: DataFrame, handled: tuple[str, ...]) -> DataFrame:
    """Batch form over (provider, event_id, kind, body, arrival): adds status.

    The first arrival of a key is found by aggregation and joined back, so that a key with
    very many arrivals isn't gathered in one place.
    """
    own = events.withColumn("digest", digest(F.col("body"))).select("provider", "event_id", "kind", "arrival", "digest")
    status = F.when(~F.coalesce(F.col("kind").isin(*handled), F.lit(False)), "UNSUPPORTED").otherwise("ACCEPTED")
    return repeated(own, F.lit(True), status, "DUPLICATE", "REPLAY_MISMATCH")


def repeated(rows: DataFrame, counts: Column, first: Column, same: str, other: str) -> DataFrame:
    """rows (provider, event_id, kind, arrival, digest, ...) with ``status``: ``first`` for the first row of a key among
    those that count, ``same`` or ``other`` for later ones by their digest, ``first`` for rows that don't count."""
    key, place = F.struct("provider", "event_id").alias("key"), F.struct("arrival", "digest", "kind").alias("place")
    equal = rows.groupBy(*rows.columns).agg(F.count("*").alias("times")).select("*", key, place)
    firsts = equal.where(counts).groupBy("key").agg(F.min("place").alias("earliest"))
    each = equal.join(firsts, "key", "left").select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time"))
    later = counts & ~((F.col("place") == F.col("earliest")) & (F.col("time") == 1))
    again = F.when(F.col("digest").eqNullSafe(F.col("earliest.digest")), same).otherwise(other)
    return each.select(*rows.columns, F.when(later, again).otherwise(first).alias("status"))


def stream(events: DataFrame, handled: tuple[str, ...], ttl_ms: int | None = None) -> DataFrame:
    """The same over a stream, with the first digest of every key in state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first = state.get[0] if state.exists else None
        for frame in frames:
            frame = frame.sort_values(["arrival", "digest", "kind"], kind="stable")
            out = []
            for kind, seen in zip(frame["kind"], frame["digest"], strict=True):
                if first is None:
                    first = seen
                    out.append("ACCEPTED" if kind in handled else "UNSUPPORTED")
                else:
                    out.append("DUPLICATE" if seen == first else "REPLAY_MISMATCH")
            frame["status"] = out
            yield frame[["provider", "event_id", "kind", "arrival", "digest", "status"]]
        if first is not None:
            state.update((first,))
            if ttl_ms:
                state.setTimeoutDuration(ttl_ms)

    own = events.withColumn("digest", digest(F.col("body"))).select("provider", "event_id", "kind", "arrival", "digest")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return own.groupBy("provider", "event_id").applyInPandasWithState(step, "provider string, event_id string, kind string, arrival long, digest string, status string", "first string", "append", timeout)


def affected(logged: DataFrame, members: DataFrame, order_of: Column) -> DataFrame:
    """(settlement_id, n_events, last_kind): payouts that accepted events name through an order."""
    named = logged.where("status = 'ACCEPTED'").withColumn("order_key", order_of).join(members, "order_key")
    return named.groupBy("settlement_id").agg(F.count_distinct("event_id").alias("n_events"), F.max(F.struct("arrival", "kind")).alias("last")).select("settlement_id", "n_events", F.col("last.kind").alias("last_kind"))
