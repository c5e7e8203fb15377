"""The subset solver: which orders of a pool compose a credit.

Reachable sums are counted up to two in two bit sets held as whole numbers, so adding an
order is a shift and a few bitwise operations. The bit sets of all prefixes are too much to hold, so
some are kept as marks, about the square root of their number, and what lies between two marks is
reckoned again when the search gets there. A depth-first search, largest order first, lists
explanations; a branch goes on only if the orders left reach the window that its explanation's
size allows, and a place that has once led nowhere isn't searched again. There is no limit of
steps: the search ends with all explanations, or with one more than are listed. It runs once for
each payout in ``applyInArrow``. Pools are counted first; those over ``MAX_POOL`` orders or ``MAX_TARGET`` paise are
refused without being grouped, so a group is bounded. ``walk`` over ``Sums`` is the same search for pools and credits of any size.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, islice
from math import gcd, isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallymark.operators import blocking
from tallymark.sources.shared import stored

MAX_TARGET, MAX_POOL, MAX_LISTED, BAND, WINDOW = 20_000_000, 900, 4, 64, 10_000
#: Bytes of bit sets that are all held; beyond them marks are kept.
HELD_BYTES, SPAN_BYTES = 48 << 20, 32 << 20
#: Dead ends remembered at once, and steps after which they are.
MOST_DEAD, REMEMBER_FROM = 500_000, 2_000


def added(reach: int, net: int, target: int) -> int:
    """Sums up to ``target`` with one order more."""
    more = reach << net
    if more.bit_length() > target + 1:
        more &= (1 << (target + 1)) - 1
    return reach | more


def as_bytes(bits: int) -> bytes:
    return bits.to_bytes((bits.bit_length() + 7) // 8, "little")


def some(bits: bytes, low: int, high: int) -> bool:
    """Whether a bit from low to high is set."""
    part = bits[low >> 3 : (high >> 3) + 1]
    return bool(int.from_bytes(part, "little") >> (low & 7) & ((1 << (high - low + 1)) - 1))


class Reach:
    """Which sums the last i of some orders reach, for every i; once and several times for all of them."""

    def __init__(self, nets: list[int], target: int, held_bytes: int = HELD_BYTES):
        self.nets, self.target, n = nets, target, len(nets)
        whole = (n + 1) * (target // 8 + 1) <= held_bytes
        self.step = n + 1 if whole else isqrt(n) + 1
        self.marks: dict[int, int] = {}
        self.spans: OrderedDict[int, list[bytes]] = OrderedDict()
        one, many, mask, own = 1, 0, (1 << (target + 1)) - 1, []
        for i in range(n + 1):
            if whole:
                own.append(as_bytes(one | many))
            elif i % self.step == 0:
                self.marks[i // self.step] = one | many
            if i < n and 0 < (net := nets[n - 1 - i]) <= target:
                more_one, more_many = (one << net) & mask, (many << net) & mask
                many |= more_many | one & more_one
                one = (one | more_one) & ~many
        if whole:
            self.spans[0] = own
        self.one, self.many = one, many

    def layer(self, i: int) -> bytes:
        """The bit set of the last i orders. Older spans between marks go once all hold more than SPAN_BYTES."""
        k, j = divmod(i, self.step)
        if k not in self.spans:
            while sum(len(b) for span in self.spans.values() for b in span) > SPAN_BYTES:
                self.spans.popitem(last=False)
            bits, own = self.marks[k], []
            for at in range(k * self.step, min((k + 1) * self.step, len(self.nets) + 1)):
                own.append(as_bytes(bits))
                if at < len(self.nets):
                    bits = added(bits, self.nets[len(self.nets) - 1 - at], self.target)
            self.spans[k] = own
        else:
            self.spans.move_to_end(k)
        return self.spans[k][j]

    def within(self, i: int, low: int, high: int) -> bool:
        """Whether the last i orders reach a sum from low to high."""
        return some(self.layer(i), low, high)


class Sums:
    """Which sums up to ``limit`` the first i of some orders reach, for every i; orders rise.

    Soon all sums from some ``full`` on to the total less ``full`` are reached, and the sums above mirror those below
    (what the other orders add up to). From then on the sums below ``full`` tell all, and few orders change them, so that neither
    the number of orders nor the credit is bounded. Sums that never fill up are held as bit sets; where
    these take more than ``held_bytes``, some are kept as marks and others reckoned again from there.
    """

    def __init__(self, nets: list[int], limit: int, held_bytes: int = HELD_BYTES):
        self.unit = gcd(*nets) or 1
        self.nets, self.limit = [n // self.unit for n in nets], limit // self.unit
        self.totals = [0, *accumulate(self.nets)]
        self.changes: list[int] = []  # where the sums below full, or full, are others than before
        self.marks: dict[int, tuple[bytes, int]] = {}
        self.held_bytes, self.near = held_bytes, {}
        state, size, apart = (1, 1), 0, 1
        for i in range(len(self.nets) + 1):
            if i:
                before, state = state, self._grown(*state, i - 1)
                if state == before and state[1] <= self.totals[i - 1]:
                    continue
            if len(self.changes) % apart == 0:
                self.marks[i] = as_bytes(state[0]), state[1]
                size += len(self.marks[i][0])
            self.changes.append(i)
            while size > held_bytes and len(self.marks) > 1:
                apart *= 2
                self.marks = {c: self.marks[c] for c in self.changes[::apart]}
                size = sum(len(b) for b, _ in self.marks.values())

    def _grown(self, bits: int, full: int, i: int) -> tuple[int, int]:
        """The sums with order i as well: a bit set, and from where on all are reached (over the total if there is no such run)."""
        net, total = self.nets[i], self.totals[i]
        if full <= total:
            if net <= total + 1 - 2 * full or total - full >= self.limit:  # the run goes on into its own shift
                if net < full:
                    bits |= bits << net & (1 << full) - 1
                    full = (~bits & (1 << full) - 1).bit_length()
                    bits &= (1 << full) - 1
                return bits, full
            tail = int(format(bits, f"0{full}b")[::-1], 2) if full else 0
            bits |= ((1 << (total + 1 - 2 * full)) - 1) << full | tail << (total - full + 1)
        bits = (bits | bits << net) & (1 << (self.limit + 1)) - 1
        total += net
        middle = min(total // 2, self.limit)
        full = (~bits & (1 << (middle + 1)) - 1).bit_length()
        if full <= middle and total + 1 - 2 * full >= 2 * net:
            return bits & (1 << full) - 1, full
        return bits, total + 1

    def _state(self, i: int) -> tuple[bytes, int]:
        c = self.changes[bisect_right(self.changes, i) - 1]
        if c in self.marks:
            return self.marks[c]
        if c not in self.near:
            kept = max(m for m in self.marks if m < c)
            own: OrderedDict[int, tuple[bytes, int]] = OrderedDict()
            state, size = (int.from_bytes(self.marks[kept][0], "little"), self.marks[kept][1]), 0
            for at in range(kept, c):
                state = self._grown(*state, at)
                own[at + 1] = as_bytes(state[0]), state[1]
                size += len(own[at + 1][0])
                while size > self.held_bytes and len(own) > 1:  # the search goes on to fewer orders: the last ones are wanted
                    size -= len(own.popitem(last=False)[1][0])
            self.near = own
        return self.near[c]

    def within(self, i: int, low: int, high: int) -> bool:
        """Whether the first i orders reach a sum from low to high."""
        bits, full = self._state(i)
        total = self.totals[i]
        low, high = -(-low // self.unit), min(high // self.unit, total)
        if low > high:
            return False
        if full > total:
            return some(bits, low, high)
        if high >= full and low <= total - full:
            return True
        return low < full and some(bits, low, min(high, full - 1)) or high > total - full and some(bits, total - high, min(total - low, full - 1))


def counts(nets: list[int], target: int) -> tuple[int, int]:
    """Bit sets of sums reached in one way exactly and in several."""
    reach = Reach(nets, target, held_bytes=0)
    return reach.one, reach.many


@dataclass(frozen=True)
class Answer:
    """A payout's explanations as places in its orders, the one beyond those listed included in ``seen``;
    of the sums near the credit how many are reachable, and which share of these in one way."""

    verdict: str
    found: list[tuple[int, ...]] = field(default_factory=list)
    exhaustive: bool = True
    density: float = 0.0
    reachable: int = 0
    unique_share: float = 0.0
    seen: list[tuple[int, ...]] = field(default_factory=list)


def walk(values: list[int], target: int, reach: Reach | Sums, band: int) -> Iterator[tuple[int, ...]]:
    """Every explanation, in the order of the search; values descend.

    A branch goes on while the orders left reach the credit or up to ``band`` below it.
    """
    n, rising = len(values), values[::-1]
    least = [0, *accumulate(rising)]  # sums of the smallest orders
    dead: set[tuple[int, int, int]] = set()
    steps = found = 0
    stack: list[tuple] = [(0, target, 0, None)]
    while stack:
        at, left, k, chosen = stack.pop()
        if at < 0:  # a place is left: without an explanation since, it is a dead end
            if left == found:
                if len(dead) >= MOST_DEAD:
                    dead.clear()
                dead.add(chosen)
            continue
        steps += 1
        if k and left <= k:
            found += 1
            own = []
            while chosen:
                own.append(chosen[1])
                chosen = chosen[0]
            yield tuple(reversed(own))
            continue
        at = max(at, n - bisect_right(rising, left))  # larger ones don't fit any more
        rest = n - at
        more = min(rest, bisect_right(least, left) - 1)  # no more orders than the smallest that fit
        if not rest or least[rest] < left - k - more or (at, left, k) in dead or not reach.within(rest, max(0, left - min(band, k + more)), left):
            continue
        if steps > REMEMBER_FROM:
            stack.append((-1, found, 0, (at, left, k)))
        stack.append((at + 1, left, k, chosen))
        stack.append((at + 1, left - values[at], k + 1, (chosen, at)))


def search(values: list[int], target: int, reach: Reach, enough: int) -> list[tuple[int, ...]]:
    """The first explanations of ``walk``, at most ``enough``."""
    return list(islice(walk(values, target, reach, min(len(values), BAND)), enough))


def answer(nets: list[int], target: int, listed: int = MAX_LISTED, held_bytes: int = HELD_BYTES) -> Answer:
    """An explanation of k orders may miss the target by up to k paise, from below."""
    usable = sorted((i for i, n in enumerate(nets) if 0 < n <= target), key=lambda i: (-nets[i], i))
    if target <= 0 or not usable:
        return Answer("CONTRADICTED")
    if target > MAX_TARGET or len(usable) > MAX_POOL:
        return Answer("INSUFFICIENT", exhaustive=False)
    values = [nets[i] for i in usable]
    reach = Reach(values, target, held_bytes)
    window = min(target, WINDOW)
    once, several = (x >> (target - window) for x in (reach.one, reach.many))
    near = (once | several).bit_count()
    told = {"density": near / (window + 1), "reachable": near, "unique_share": once.bit_count() / near if near else 0.0}
    if not reach.within(len(values), max(0, target - min(len(values), BAND)), target):
        return Answer("CONTRADICTED", **told)
    seen = [tuple(usable[i] for i in c) for c in search(values, target, reach, listed + 1)]
    verdict = "CONTRADICTED" if not seen else "PROVEN" if len(seen) == 1 else "AMBIGUOUS"
    return Answer(verdict, seen[:listed], len(seen) <= listed, seen=seen, **told)


def explain(nets: list[int], target: int, listed: int = MAX_LISTED) -> tuple[str, list[tuple[int, ...]], bool, float]:
    """(verdict, explanations as places in nets, exhaustive, density)."""
    a = answer(nets, target, listed)
    return a.verdict, a.found, a.exhaustive, a.density


def solved(payouts: DataFrame, orders: DataFrame, lags: tuple[int, ...] = (2,)) -> DataFrame:
    """(settlement_id, verdict, n_found, order_ids of the first, exhaustive, density) of every payout."""
    # counted before anything is grouped: pools that explain() would refuse never become a frame
    held = blocking.pool_sizes(payouts, orders, lags).where("candidates > 0").join(payouts.select("settlement_id", F.col("net_paise").alias("credit")), "settlement_id")
    sizes = stored(held.select("settlement_id", F.col("candidates").alias("n"), "credit"), "pool-sizes")
    fits = F.col("n").between(1, MAX_POOL) & (F.col("credit") <= MAX_TARGET)
    small = payouts.join(sizes.where(fits).select("settlement_id"), "settlement_id", "left_semi")
    pool = blocking.pools(small, orders, lags).select("settlement_id", "credit_paise", "order_id", "net_paise")

    ddl = "settlement_id string, verdict string, n_found long, order_ids array<string>, exhaustive boolean, density double"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip((-n for n in table["net_paise"].to_pylist()), table["order_id"].to_pylist(), strict=True))
        ids = [i for _, i in rows]
        verdict, found, exhaustive, density = explain([-n for n, _ in rows], table["credit_paise"][0].as_py())
        own = table["settlement_id"][0].as_py(), verdict, len(found), sorted(ids[i] for i in found[0]) if found else [], exhaustive, density
        return pa.Table.from_arrays([pa.array([v], f.type) for f, v in zip(schema, own, strict=True)], schema=schema)

    done = pool.groupBy("settlement_id").applyInArrow(run, ddl)
    answer = "settlement_id", "verdict", "0L as n_found", "cast(array() as array<string>) as order_ids", "exhaustive", "0.0d as density"
    refused = sizes.where(~fits).selectExpr("settlement_id", "'INSUFFICIENT' as verdict", "false as exhaustive").selectExpr(*answer)
    none = payouts.select("settlement_id").join(sizes, "settlement_id", "left_anti").selectExpr("settlement_id", "'CONTRADICTED' as verdict", "true as exhaustive").selectExpr(*answer)
    return done.unionByName(refused).unionByName(none)
