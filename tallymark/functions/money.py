"""Money in integer paise: fees, taxes, nets and how amounts are shown, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fee of each payment method and the tax on fees, in basis points (fixed values).
FEE_BPS = {"upi": 0, "card": 200, "netbanking": 150, "wallet": 250}
TAX_BPS = 1800


def floor_div(value: Column, by: int) -> Column:
    """Integer division towards minus infinity, in whole numbers throughout."""
    whole = value.cast("long")
    return F.call_function("div", whole - F.pmod(whole, F.lit(by).cast("long")), F.lit(by).cast("long"))


def half_up(numerator: Column, denominator: int) -> Column:
    """Integer division rounding half up, for negative numbers too: floor((n + d / 2) / d)."""
    shifted = numerator + F.lit(denominator // 2)
    return floor_div(shifted, denominator)


def fee_bps(method: Column, table: dict[str, int] | None = None) -> Column:
    """Basis points of a method; 0 for one that isn't listed."""
    out = F.lit(0)
    for name, bps in (table or FEE_BPS).items():
        out = F.when(method == name, F.lit(bps)).otherwise(out)
    return out.cast("long")


def fee(gross: Column, method: Column, table: dict[str, int] | None = None, fixed: int = 0) -> Column:
    return half_up(gross * fee_bps(method, table), 10_000) + F.lit(fixed).cast("long")


def tax(fee_paise: Column, bps: int = TAX_BPS) -> Column:
    return half_up(fee_paise * F.lit(bps), 10_000)


def net(gross: Column, method: Column, table: dict[str, int] | None = None, tax_bps: int = TAX_BPS, fixed: int = 0) -> Column:
    own = fee(gross, method, table, fixed)
    return gross - own - tax(own, tax_bps)


def tolerance(orders: Column, cap: int | None = None) -> Column:
    """A paisa for each order, up to an optional cap."""
    own = orders.cast("long")
    return own if cap is None else F.least(own, F.lit(cap).cast("long"))


def rupees(paise: Column) -> Column:
    """Rupees with Indian grouping: three digits, then twos; a minus stands before the sign."""
    size = F.abs(paise)
    units = floor_div(size, 100).cast("string")
    head = F.when(F.length(units) > 3, F.substring(units, F.lit(1), F.length(units) - 3)).otherwise(F.lit(""))
    last = F.when(F.length(units) > 3, F.substring(units, F.length(units) - 2, F.lit(3))).otherwise(units)
    pairs = F.reverse(F.regexp_replace(F.reverse(head), r"(\d{2})(?=\d)", "$1,"))
    grouped = F.when(head == "", last).otherwise(F.concat(pairs, F.lit(","), last))
    return F.concat(F.when(paise < 0, F.lit("-")).otherwise(F.lit("")), F.lit("₹"), grouped, F.lit("."), F.lpad(F.pmod(size, F.lit(100)).cast("string"), 2, "0"))


def floor_div_columns(value: Column, by: Column) -> Column:
    """Integer division towards minus infinity by a positive column."""
    return F.call_function("div", value - F.pmod(value, by), by)
