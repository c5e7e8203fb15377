"""Business days, Monday to Friday, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAGS = (2, 3, 4)


def business_days_after(start: Column, n: int | Column) -> Column:
    """The day n weekdays after a date. A weekend counts as the Friday before it."""
    n = F.lit(n) if isinstance(n, int) else n
    day = F.weekday(start)
    friday = F.least(day, F.lit(4))
    weeks = F.call_function("div", friday + n, F.lit(5)).cast("int")
    return F.date_add(start, (friday - day + n + 2 * weeks).cast("int"))


def business_days_between(start: Column, end: Column) -> Column:
    """Weekdays in (start, end]; 0 if the end isn't later."""

    def upto(d: Column) -> Column:
        days = F.datediff(d, F.lit("1970-01-05").cast("date"))  # a Monday
        week = F.floor(days / 7).cast("int")
        return week * 5 + F.least(days - week * 7 + 1, F.lit(5))

    return F.when(end > start, upto(end) - upto(start)).otherwise(0).cast("int")


def calendar(days: DataFrame, column: str = "captured_on", lags: tuple[int, ...] = LAGS) -> DataFrame:
    """(captured_on, lag, settled_on) for distinct days: a small dimension, one row for each day and lag."""
    own = days.select(column).where(F.col(column).isNotNull()).distinct()
    return own.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("settled_on", business_days_after(F.col(column), F.col("lag")))
