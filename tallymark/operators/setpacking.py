"""Which explanations can hold together: set packing within each group of rival payouts.

Payouts are rivals if explanations of theirs share an order; groups of rivals are found by
spreading labels, and each is solved by branch and bound in ``applyInPandas``. The search of a group
ends after ``STEPS`` choices: what it has found by then is returned as ``BEST_FOUND`` and nothing
of it is called forced. Payouts of a group that can't all be explained are told as cores, each with a state that says
whether the search came to its end. A group's frame holds its explanations, however many.
"""

from __future__ import annotations

import sys
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators.reports import conflict_components
from tallymark.sources.shared import stored

STEPS = 200_000


def best(rows: list[tuple[str, int, frozenset[str]]], banned: frozenset[int] = frozenset()) -> tuple[tuple[int, int], list[int], bool]:
    """Most payouts explained, then most paise: rows are (payout, paise, orders), one for each
    payout at most, every order once. Gives (count, paise), the places of the chosen rows, and
    whether the search was exhaustive."""
    by_payout: dict[str, list[int]] = {}
    for i, (payout, _, _) in enumerate(rows):
        if i not in banned:
            by_payout.setdefault(payout, []).append(i)
    payouts = sorted(by_payout, key=lambda p: (len(by_payout[p]), p))
    most = [max(rows[i][1] for i in by_payout[p]) for p in payouts]
    after = [0] * (len(payouts) + 1)
    for k in range(len(payouts) - 1, -1, -1):
        after[k] = after[k + 1] + max(0, most[k])
    top: tuple[tuple[int, int], list[int]] = ((0, 0), [])
    steps = 0
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 2 * len(payouts) + 1_000))

    def go(k: int, used: frozenset[str], score: tuple[int, int], chosen: list[int]) -> None:
        nonlocal top, steps
        steps += 1
        if score > top[0]:
            top = score, list(chosen)
        if k == len(payouts) or steps > STEPS or (score[0] + len(payouts) - k, score[1] + after[k]) <= top[0]:
            return
        for i in by_payout[payouts[k]]:
            if not used & rows[i][2]:
                chosen.append(i)
                go(k + 1, used | rows[i][2], (score[0] + 1, score[1] + rows[i][1]), chosen)
                chosen.pop()
        go(k + 1, used, score, chosen)

    go(0, frozenset(), (0, 0), [])
    return *top, steps <= STEPS


def loosened(sets: list[list[frozenset[str]]]) -> list[list[frozenset[str]]]:
    """sets without those that can't be in the way: a list with a set whose orders no other list wants is
    taken out, again and again. What is left holds together just if all did."""
    left = [list(own) for own in sets]
    while True:
        wanted = Counter(o for own in left for o in frozenset().union(*own))
        stay = [own for own in left if not any(all(wanted[o] == 1 for o in x) for x in own)]
        if len(stay) == len(left):
            return stay
        left = stay


def together(sets: list[list[frozenset[str]]], most: int | None = None) -> bool | None:
    """Whether one set of each list can be taken with no order twice; None if ``most`` (``STEPS``) choices don't tell.

    The list with the fewest sets left is always chosen from next.
    """
    stack, steps = [loosened(sets)], 0
    while stack:
        left = stack.pop()
        if not left:
            return True
        steps += 1
        if steps > (STEPS if most is None else most):
            return None
        at = min(range(len(left)), key=lambda i: len(left[i]))
        rest = left[:at] + left[at + 1 :]
        for own in reversed(left[at]):
            less = [[x for x in other if not x & own] for other in rest]
            if all(less):
                stack.append(less)
    return False


def cores(rows: list[tuple[str, frozenset[str]]], most: int | None = None) -> list[tuple[list[str], str]]:
    """Disjoint sets of payouts that can't all be explained at once, with their state; rows are (payout, orders).

    A core is found by halves: what is needed of one half is looked for while the other stays. MINIMAL cores need each
    of their members; of a CONTRADICTORY one a search gave up on that. What remains without a core's payouts is
    searched for the next, until it holds together; if a search gives up on this, the rest is one UNDECIDED core.
    """
    by_payout: dict[str, list[frozenset[str]]] = {}
    for payout, own in rows:
        by_payout.setdefault(payout, []).append(own)
    gave_up = False

    def holds(payouts: list[str]) -> bool | None:
        nonlocal gave_up
        answer = together([by_payout[p] for p in payouts], most)
        gave_up |= answer is None
        return answer

    def needed(kept: list[str], added: bool, some: list[str]) -> list[str]:
        """Members of ``some`` that make a contradiction with ``kept``, which holds together as long as nothing was added."""
        if added and holds(kept) is False:
            return []
        if len(some) == 1:
            return some
        half = len(some) // 2
        second = needed(kept + some[:half], True, some[half:])
        return needed(kept + second, bool(second), some[:half]) + second

    out: list[tuple[list[str], str]] = []
    rest = sorted(by_payout)
    while rest and (answer := holds(rest)) is not True:
        if answer is None:
            out.append((rest, "UNDECIDED"))
            break
        gave_up = False
        core = sorted(needed([], False, rest))
        out.append((core, "CONTRADICTORY" if gave_up else "MINIMAL"))
        rest = [p for p in rest if p not in core]
    return out


def unsat_cores(explanations: DataFrame, most: int | None = None) -> DataFrame:
    """(core, settlement_id, contested, state) of payouts in a contradiction of explanations (settlement_id,
    explanation, order_ids); core is its smallest payout, contested the number of orders that
    several of its members claim, state as ``cores`` has it. Payouts without an explanation have no row there and none here.
    """
    parts = conflict_components(explanations.select("settlement_id", F.explode("order_ids").alias("order_id")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = cores([(s, frozenset(o)) for s, o in zip(frame["settlement_id"], frame["order_ids"], strict=True)], most)
        return pd.DataFrame([(core[0], payout, state) for core, state in found for payout in core], columns=["core", "settlement_id", "state"])

    # a component of one payout always holds together
    several = parts.join(parts.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component"), "component")
    members = explanations.join(several, "settlement_id").select("component", "settlement_id", "order_ids").groupBy("component").applyInPandas(run, "core string, settlement_id string, state string")
    members = stored(members, "cores")
    claims = members.join(explanations, "settlement_id").select("core", "settlement_id", F.explode("order_ids").alias("order_id")).distinct()
    contested = claims.groupBy("core", "order_id").agg(F.count("*").alias("n")).where("n > 1").groupBy("core").agg(F.count("*").alias("contested"))
    return members.join(contested, "core", "left").select("core", "settlement_id", F.coalesce("contested", F.lit(0)).alias("contested"), "state")


def packed_findings(payouts: DataFrame, explanations: DataFrame) -> DataFrame:
    """(settlement_id, verdict, layer, strict, optimistic, core) of every payout: PROVEN where the
    choice is forced, AMBIGUOUS with other explanations, CONTRADICTED without any. ``strict``
    is the forced explanation's number, ``optimistic`` the chosen one's, ``core`` the
    contradiction that the payout is in, all null where there is none.
    """
    own = packed(explanations).groupBy("settlement_id").agg(F.max(F.when(F.col("chosen"), F.col("explanation"))).alias("optimistic"), F.max(F.when(F.col("forced"), F.col("explanation"))).alias("strict"), F.lit(True).alias("explained"))
    joined = payouts.select("settlement_id").join(own, "settlement_id", "left").join(unsat_cores(explanations).select("settlement_id", "core"), "settlement_id", "left")
    verdict = F.when(F.col("strict").isNotNull(), "PROVEN").when(F.col("explained"), "AMBIGUOUS").otherwise("CONTRADICTED")
    layer = F.when(F.col("strict").isNotNull(), "PACKED_FORCED").when(F.col("explained"), "PACKED_UNFORCED").otherwise("NO_CANDIDATE")
    return joined.select("settlement_id", verdict.alias("verdict"), F.when(F.col("core").isNotNull(), F.concat(layer, F.lit("+CORE"))).otherwise(layer).alias("layer"), "strict", "optimistic", "core")


def packed(explanations: DataFrame) -> DataFrame:
    """(settlement_id, explanation, component, chosen, forced, state) of every explanation
    (settlement_id, explanation, net_paise, order_ids).

    A chosen one is forced if no equally good choice does without it.
    """
    parts = conflict_components(explanations.select("settlement_id", F.explode("order_ids").alias("order_id")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["settlement_id", "explanation"])
        out = frame[["settlement_id", "explanation", "component"]].copy()
        rows = [(s, int(p), frozenset(o)) for s, p, o in zip(frame["settlement_id"], frame["net_paise"], frame["order_ids"], strict=True)]
        score, chosen, whole = best(rows)
        without = {i: best(rows, frozenset([i])) for i in chosen} if whole else {}
        forced = {i for i, (less, _, sure) in without.items() if sure and less < score}
        return out.assign(chosen=[i in chosen for i in range(len(rows))], forced=[i in forced for i in range(len(rows))], state="SOLVED" if whole else "BEST_FOUND")

    joined = explanations.join(parts, "settlement_id").select("settlement_id", "explanation", "net_paise", "order_ids", "component")
    return joined.groupBy("component").applyInPandas(run, "settlement_id string, explanation long, component string, chosen boolean, forced boolean, state string")
