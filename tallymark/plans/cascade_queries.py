"""Queries over the cascade: its findings, their spaces, and the policy and close that rest on them.

SQL can't express the solver; tests hold the cascade against a loop over payouts, and these
queries against sums over its findings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators import cascade, evidence, policy
from tallymark.operators.close import exposure, readiness
from tallymark.operators.findings import cascade_findings, exceptions
from tallymark.plans.recon_queries import base
from tallymark.sources import views
from tallymark.sources.shared import once, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    return once("cascade", (orders, payouts), lambda: cascade.cascade(payouts, orders))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    return once("cascade-findings", (orders, payouts), lambda: cascade_findings(decided(spark, sf_dir), payouts, orders))


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.strata(found(spark, sf_dir), views.truth(base(spark, sf_dir)[0]))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.decide(found(spark, sf_dir), _strata(spark, sf_dir))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(exposure.items(exceptions(found(spark, sf_dir)), _judged(spark, sf_dir)), "items")


@query
def reconcile_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every payout's verdict, layer and proof, in the order of work."""
    return decided(spark, sf_dir).withColumn("explanations", F.transform("explanations", lambda e: F.array_join(e, " "))).withColumn("order_ids", F.array_join("order_ids", " "))


@query
def cascade_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each reduction took from the orders that a payout was decided against."""
    orders, payouts = base(spark, sf_dir)
    return cascade.spaces(decided(spark, sf_dir), payouts, orders)


@query
def cascade_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All explanations of every payout while no order is consumed."""
    orders, payouts = base(spark, sf_dir)
    return cascade.candidates(payouts, orders, listed=None).withColumn("order_ids", F.array_join("order_ids", " "))


@query
def cascade_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exceptions by what explanations dispute and what the closest partial leaves open."""
    return exceptions(found(spark, sf_dir))


@query
def cascade_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong proofs by how easily their sums are reached."""
    return _strata(spark, sf_dir)


@query
def cascade_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir)


def _postable(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, payouts = base(spark, sf_dir)
    members = cascade.open_pools(decided(spark, sf_dir), payouts, orders, "PROVEN")
    return evidence.why_not_postable(found(spark, sf_dir), members)


@query
def cascade_postable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a finding may be posted, and the first condition against it."""
    return _postable(spark, sf_dir)


@query
def cascade_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal lines of the proofs that may be posted, by their findings' conditions and by policy."""
    postable = _postable(spark, sf_dir).where("postable").select("settlement_id")
    return policy.journal(found(spark, sf_dir).join(postable, "settlement_id", "left_semi"), _judged(spark, sf_dir))


@query
def cascade_period_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.verdicts(_items(spark, sf_dir), found(spark, sf_dir))
