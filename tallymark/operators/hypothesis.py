"""Hypotheses about ambiguous payouts: proposed without amounts, tested, refined over rounds.

A proposer sees which orders a payout may hold and when they were captured, never what they are worth. It
names an anchor, some orders that belong together. An anchor settles a payout only if exactly one of the
explanations that arithmetic has found holds it, and the kernel accepts that one; everything else is a
refutation, which the next round's proposer gets to know: what is rejected, what has been tried.
All payouts go through a round together; within a round a payout's hypotheses count in their order, up to
the first that holds. Every proposal and its end is kept as an event, so that the account can be
read afterwards.

Defined results: payouts that aren't AMBIGUOUS are skipped and keep their verdict; one that no anchor
settles keeps AMBIGUOUS; an anchor without orders distinguishes nothing; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymark.operators import kernel
from tallymark.sources.shared import stored

#: Rounds of refinement, hypotheses of a round, orders of an anchor (fixed values).
ROUNDS, PROPOSED, ANCHOR = 3, 2, 3

Proposer = Callable[[DataFrame], DataFrame]

_EVENT = ["settlement_id", "round", "no", "step", "actor", "act", "why", "lens"]


def capture_batches(candidates: DataFrame) -> Proposer:
    """Proposes the first orders of the days on which most candidates were captured, two days a round.

    ``candidates`` has (settlement_id, order_id, captured_on). Proposes nothing once something was rejected.
    """
    first = Window.partitionBy("settlement_id", "captured_on").orderBy("order_id")
    sizes = candidates.groupBy("settlement_id", "captured_on").agg(F.count("*").alias("n")).where("n > 1")
    few = candidates.withColumn("k", F.row_number().over(first)).where(F.col("k") <= ANCHOR).groupBy("settlement_id", "captured_on").agg(F.sort_array(F.collect_list("order_id")).alias("anchor"))
    batches = stored(few.join(sizes, ["settlement_id", "captured_on"]), "batches")

    def propose(open_payouts: DataFrame) -> DataFrame:
        rows = open_payouts.where(F.size("rejected") == 0).join(batches, "settlement_id").where(~F.array_contains("tried", F.col("anchor")))
        no = F.row_number().over(Window.partitionBy("settlement_id").orderBy(F.desc("n"), "captured_on"))  # the days of one payout's pool
        return rows.withColumn("no", no).where(F.col("no") <= PROPOSED).select("settlement_id", "no", "anchor", F.lit("capture-batch").alias("lens"))

    return propose


def falsified(hypotheses: DataFrame, explained: DataFrame, known: DataFrame, checked: DataFrame) -> DataFrame:
    """hypotheses (settlement_id, no, anchor, ...) with ``why``: existence, consistency, uniqueness, kernel, or empty
    for one that holds; ``explanation`` that it selects, orders ``refused`` by it, and what it leaves ``unexplained``.

    ``known`` has the orders that payouts may hold, ``checked`` the kernel's answer (ok, residual_paise) for each explanation.
    """
    each = hypotheses.select("settlement_id", "no", F.explode(F.array_distinct("anchor")).alias("order_id"))
    ghosts = each.join(known.select("settlement_id", "order_id").distinct(), ["settlement_id", "order_id"], "left_anti")
    ghosts = ghosts.groupBy("settlement_id", "no").agg(F.sort_array(F.collect_list("order_id")).alias("ghosts"))  # an anchor's orders
    every = explained.select("settlement_id", "explanation", "order_id").distinct()
    held = each.join(every, ["settlement_id", "order_id"]).groupBy("settlement_id", "no", "explanation").agg(F.count("*").alias("n"))
    sizes = hypotheses.select("settlement_id", "no", F.size(F.array_distinct("anchor")).alias("size"))
    fits = held.join(sizes, ["settlement_id", "no"]).where("n = size").groupBy("settlement_id", "no").agg(F.count("*").alias("fits"), F.min("explanation").alias("explanation"))
    competing = every.groupBy("settlement_id").agg(F.count_distinct("explanation").alias("competing"))
    own = hypotheses.join(ghosts, ["settlement_id", "no"], "left").join(fits, ["settlement_id", "no"], "left").join(competing, "settlement_id", "left")
    n = F.when(F.size("anchor") == 0, F.coalesce("competing", F.lit(0))).otherwise(F.coalesce("fits", F.lit(0)))
    own = own.join(checked.select("settlement_id", "explanation", "ok", "residual_paise", "credit_paise"), ["settlement_id", "explanation"], "left")
    why = (
        F.when(F.col("ghosts").isNotNull(), "existence").when(n == 0, "consistency").when(n > 1, "uniqueness")
        .when(~F.coalesce("ok", F.lit(False)), "kernel").otherwise("")
    )
    own = own.withColumn("why", why)
    refused = F.when(F.col("why") == "existence", F.col("ghosts")).when(F.col("why") == "consistency", F.sort_array(F.array_distinct("anchor"))).otherwise(F.array().cast("array<string>"))
    return own.select(*hypotheses.columns, "why", F.when(F.col("why") == "", F.col("explanation")).alias("explanation"), refused.alias("refused"), F.when(F.col("why") == "kernel", F.col("residual_paise")).alias("residual"))


def investigate(findings: DataFrame, explained: DataFrame, known: DataFrame, payouts: DataFrame, orders: DataFrame, propose: Proposer, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(outcomes, trail) of findings (settlement_id, verdict).

    outcomes: (settlement_id, verdict, lens, explanation), PROVEN where an anchor held; such a finding has no search
    space of its own and isn't postable. trail: (settlement_id, round, no, step, actor, act, why, lens), in that order.
    ``propose`` gets (settlement_id, rejected, tried, unexplained) of the payouts that are still open and gives
    (settlement_id, no, anchor, lens). ``explained`` has rows (settlement_id, explanation, order_id).
    """
    members = explained.select("settlement_id", "explanation", "order_id").distinct()
    ambiguous = stored(findings.where("verdict = 'AMBIGUOUS'").select("settlement_id"), "ambiguous")
    competing = members.join(ambiguous, "settlement_id", "left_semi")
    totals = kernel.proofs(competing, orders, payouts, ("settlement_id", "explanation"))
    checked = stored(kernel.check(totals).select("settlement_id", "explanation", "ok", "residual_paise", "credit_paise"), "checked")
    credits = payouts.select("settlement_id", F.col("net_paise").alias("credit"))
    none = F.array().cast("array<string>")
    state = ambiguous.select("settlement_id", none.alias("rejected"), F.array().cast("array<array<string>>").alias("tried"), F.lit(None).cast("long").alias("unexplained"))

    def event(rows: DataFrame, number: int, step: int, actor: str, act: str, no: str = "0", why: str = "''", lens: str = "''") -> DataFrame:
        return rows.selectExpr("settlement_id", f"{number} as round", f"cast({no} as int) as no", f"{step} as step", f"'{actor}' as actor", f"'{act}' as act", f"{why} as why", f"{lens} as lens")

    trail, settled = [event(findings.where("verdict <> 'AMBIGUOUS'"), 0, 0, "engine", "skip", why="verdict")], None
    for number in range(1, rounds + 1):
        offered = stored(propose(state), "offered")
        fresh = offered.join(state.select("settlement_id", "tried"), "settlement_id").where(~F.array_contains("tried", F.col("anchor"))).drop("tried")
        tested = stored(falsified(fresh, competing, known, checked), "tested")
        trail.append(event(state.join(tested, "settlement_id", "left_anti"), number, 0, "model", "exhausted"))
        holds = tested.where("why = ''").groupBy("settlement_id").agg(F.min("no").alias("first"))
        shown = tested.join(holds, "settlement_id", "left").where(F.col("first").isNull() | (F.col("no") <= F.col("first")))
        good = shown.where("why = ''")
        trail += [
            event(shown, number, 1, "model", "propose", "no", lens="lens"), event(shown.where("why <> ''"), number, 2, "solver", "refute", "no", "why", "lens"),
            event(good, number, 2, "solver", "accept", "no", lens="lens"), event(good, number, 3, "kernel", "verify", "no", lens="lens"),
        ]
        now = good.select("settlement_id", "lens", "explanation")
        settled = now if settled is None else settled.unionByName(now)
        last = tested.groupBy("settlement_id").agg(F.max_by(F.struct("why", "refused", "residual"), "no").alias("last"))
        tried = offered.groupBy("settlement_id").agg(F.collect_list("anchor").alias("more"))  # a round's proposals
        left = state.join(last, "settlement_id").join(holds, "settlement_id", "left_anti").join(tried, "settlement_id").join(credits, "settlement_id", "left")
        hint = F.when(F.col("last.why") == "existence", F.col("credit")).when(F.col("last.why") == "kernel", F.col("last.residual")).otherwise(F.lit(0))
        state = stored(left.select("settlement_id", F.concat("rejected", "last.refused").alias("rejected"), F.concat("tried", "more").alias("tried"), hint.cast("long").alias("unexplained")), "open")
    if settled is None:
        settled = ambiguous.limit(0).selectExpr("settlement_id", "'' as lens", "'' as explanation")
    settled = stored(settled, "settled")
    trail.append(event(ambiguous.join(settled, "settlement_id", "left_anti"), rounds + 1, 0, "engine", "abstain"))
    events = trail[0]
    for more in trail[1:]:
        events = events.unionByName(more)
    verdict = F.when(F.col("explanation").isNotNull(), "PROVEN").otherwise(F.col("verdict"))
    outcomes = findings.select("settlement_id", "verdict").join(settled, "settlement_id", "left").select("settlement_id", verdict.alias("verdict"), "lens", "explanation")
    return outcomes, events.select(*_EVENT)
