"""The evidence graph of a close: nodes and edges from orders to the period, walks and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.sources import shared


def edges(found: DataFrame, own: DataFrame) -> DataFrame:
    """(source, target, relationship): order, finding, settlement, exception, period."""
    proven = found.where("order_id is not null").select(F.concat(F.lit("rec:order:"), "order_id").alias("source"), F.concat(F.lit("find:"), "settlement_id").alias("target"), F.lit("EVIDENCE_FOR").alias("relationship"))
    finds = found.select(F.concat(F.lit("find:"), "settlement_id").alias("source"), F.concat(F.lit("setl:"), "settlement_id").alias("target"), F.lit("DECIDES").alias("relationship"))
    raised = own.where("kind is not null").select(F.concat(F.lit("setl:"), "settlement_id").alias("source"), F.concat(F.lit("exc:"), "settlement_id").alias("target"), F.lit("RAISES").alias("relationship"))
    counted = own.where("kind is not null").select(F.concat(F.lit("exc:"), "settlement_id").alias("source"), F.concat(F.lit("period:"), "period_id").alias("target"), F.lit("EXPOSES").alias("relationship"))
    verified = own.where("verified_paise > 0").select(F.concat(F.lit("setl:"), "settlement_id").alias("source"), F.concat(F.lit("period:"), "period_id").alias("target"), F.lit("VERIFIES").alias("relationship"))
    return proven.unionByName(finds).unionByName(raised).unionByName(counted).unionByName(verified)


def nodes(graph: DataFrame) -> DataFrame:
    both = graph.select(F.col("source").alias("node_id")).union(graph.select("target")).distinct()
    return both.withColumn("stage", F.substring_index("node_id", ":", 1))


def closure(graph: DataFrame, start: DataFrame, backward: bool = True) -> DataFrame:
    """(root, node_id): everything reached from each start node (column node_id), itself too.

    The walk goes on until a round adds nothing, circles included; each round joins only
    the nodes that the last one added.
    """
    near = graph.selectExpr("target as at", "source as next") if backward else graph.selectExpr("source as at", "target as next")
    found = front = start.select(F.col("node_id").alias("root"), "node_id").distinct()
    while True:
        front = shared.stored(front.join(near, front["node_id"] == near["at"]).select("root", F.col("next").alias("node_id")).distinct().join(found, ["root", "node_id"], "left_anti"), "frontier")
        if not front.limit(1).count():
            return found
        found = found.unionByName(front)


def integrity(graph: DataFrame, known: DataFrame) -> DataFrame:
    """(node_id, defect): ends of edges that no known node has, and exceptions nothing raises."""
    missing = nodes(graph).join(known.select("node_id"), "node_id", "left_anti").select("node_id", F.lit("BROKEN_REFERENCE").alias("defect"))
    raised = graph.where("relationship = 'RAISES'").select(F.col("target").alias("node_id"))
    orphans = known.where("node_id like 'exc:%'").join(raised, "node_id", "left_anti").select("node_id", F.lit("ORPHAN_EXCEPTION").alias("defect"))
    return missing.unionByName(orphans)


#: Node types by the head of their id, from sources to the decision.
TYPES = ("evt:pay", "evt:bank", "rec:order", "rec:bank", "setl", "proof", "find", "miss", "exc", "exp", "mat", "blk", "cf", "vdt")
#: Reasons that say something isn't there (fixed values).
MISSING = ("MISSING_TRANSACTION", "INSUFFICIENT_EVIDENCE")


def node(head: str, *parts: str) -> Column:
    """The id of a node: its type, then columns, by colons."""
    return F.concat_ws(":", F.lit(head), *parts)


def whole(orders: DataFrame, matched: DataFrame, found: DataFrame, established: DataFrame, own: DataFrame, stops: DataFrame, carried: DataFrame) -> DataFrame:
    """(source, target, relationship) of all twelve relations between what a close rests on and its verdict.

    ``orders`` (order_id), ``matched`` (txn_id, settlement_id, null where a credit has none), ``found`` (settlement_id,
    order_id of a proof), ``established`` (settlement_id, order_id: orders of explanations that don't decide), items ``own``,
    blockers ``stops`` and ``carried`` items, by period.
    """

    def edge(rows: DataFrame, source: Column, target: Column, relationship: str) -> DataFrame:
        return rows.select(source.alias("source"), target.alias("target"), F.lit(relationship).alias("relationship"))

    proven, excepted, exposed = found.where("order_id is not null"), own.where("reason is not null"), own.where("kind is not null")
    period = found.select("settlement_id").join(exposed.select("settlement_id", "period_id"), "settlement_id")
    blocker, about = node("blk", "period_id", "kind", "ref_id"), F.substring_index("ref_id", ":", 1)
    material, raised = F.col("ref_id").startswith("material_exposure:"), F.col("kind") == "HIGH_SEVERITY_EXCEPTION"
    parts = [
        edge(orders, node("evt:pay", "order_id"), node("rec:order", "order_id"), "CAPTURED_AS"), edge(matched, node("evt:bank", "txn_id"), node("rec:bank", "txn_id"), "CAPTURED_AS"),
        edge(matched.where("settlement_id is not null"), node("rec:bank", "txn_id"), node("setl", "settlement_id"), "CREDITED_IN_BANK"),
        edge(proven, node("rec:order", "order_id"), node("proof", "settlement_id"), "BUNDLED_IN_SETTLEMENT"), edge(proven, node("proof", "settlement_id"), node("find", "settlement_id"), "PROVEN_BY"),
        edge(found, node("find", "settlement_id"), node("setl", "settlement_id"), "PROVEN_BY"), edge(own, node("setl", "settlement_id"), node("vdt", "period_id"), "DETERMINES_VERDICT"),
        edge(excepted, node("setl", "settlement_id"), node("exc", "settlement_id"), "DISCREPANCY_RAISED"),
        edge(established.join(excepted.select("settlement_id"), "settlement_id"), node("rec:order", "order_id"), node("exc", "settlement_id"), "ESTABLISHED_PARTIAL"),
        edge(excepted.where(F.col("reason").isin(*MISSING)), node("miss", "settlement_id"), node("exc", "settlement_id"), "MISSING_EVIDENCE_LINK"),
        edge(exposed, node("setl", "settlement_id"), node("exp", "settlement_id"), "ASSESSED_EXPOSURE"), edge(period, node("find", "settlement_id"), node("exp", "settlement_id"), "ASSESSED_EXPOSURE"),
        edge(exposed.where("reason is not null"), node("exc", "settlement_id"), node("exp", "settlement_id"), "ASSESSED_EXPOSURE"),
        edge(exposed, node("exp", "settlement_id"), node("mat", "period_id"), "EVALUATED_AGAINST_POLICY"),
        edge(own.select("period_id").distinct(), node("mat", "period_id"), node("vdt", "period_id"), "DETERMINES_VERDICT"),
        edge(stops, blocker, node("vdt", "period_id"), "CAUSES_BLOCKER"), edge(stops.where(material), node("mat", "period_id"), blocker, "CAUSES_BLOCKER"),
        edge(stops.where(raised), F.concat(F.lit("exc:"), about), blocker, "CAUSES_BLOCKER"), edge(stops.where(~material & ~raised), F.concat(F.lit("setl:"), about), blocker, "CAUSES_BLOCKER"),
        edge(carried, node("cf", "settlement_id"), node("vdt", "period_id"), "CARRIED_FORWARD"), edge(carried.where("reason is not null"), node("exc", "settlement_id"), node("cf", "settlement_id"), "CARRIED_FORWARD"),
    ]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every


def type_of(node_id: Column) -> Column:
    """The head of a node's id."""
    head = F.substring_index(node_id, ":", 1)
    return F.when(head.isin("evt", "rec"), F.substring_index(node_id, ":", 2)).otherwise(head)


def causes(graph: DataFrame, start: DataFrame, backward: bool = True) -> DataFrame:
    """(root, type, n): how many nodes of each type stand behind (or after) each start node, itself left out."""
    return closure(graph, start, backward).where("root <> node_id").groupBy("root", type_of(F.col("node_id")).alias("type")).agg(F.count("*").alias("n"))


def adjacent(graph: DataFrame) -> DataFrame:
    """(node_id, parents, children, incoming, outgoing): distinct neighbours and edges of every node."""
    each = graph.groupBy("source", "target").agg(F.count("*").alias("n"))  # both sides read this one shuffle
    out = each.groupBy(F.col("source").alias("node_id")).agg(F.count("target").alias("children"), F.sum("n").alias("outgoing"))
    into = each.groupBy(F.col("target").alias("node_id")).agg(F.count("source").alias("parents"), F.sum("n").alias("incoming"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.join(into, "node_id", "full").select("node_id", *[none(c) for c in ("parents", "children", "incoming", "outgoing")])
