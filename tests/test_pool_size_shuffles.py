"""Pool sizes compare only amounts of a credit's own band, so that no others are shuffled."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallymark.operators import blocking


def test_amounts_of_other_bands_stay(spark):
    monday, wednesday = dt.date(2024, 3, 4), dt.date(2024, 3, 6)
    orders = spark.range(5_000).select(F.lit(monday).alias("captured_on"), (F.col("id") + 1_000).alias("net_paise"))
    payouts = spark.createDataFrame([("s", wednesday, 2**40)], "settlement_id string, settled_on date, net_paise long")
    stages = spark._jsc.sc().statusStore()
    rest = [getattr(stages, f"stageList$default${n}")() for n in (2, 3, 4, 5)]
    listed = lambda: spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages.stageList(None, *rest))
    last = max((s.stageId() for s in listed()), default=-1)
    (row,) = blocking.pool_sizes(payouts, orders).collect()
    assert (row.in_window, row.candidates, row.pool_net) == (5_000, 5_000, sum(range(1_000, 6_000)))
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    assert sum(s.shuffleWriteRecords() for s in listed() if s.stageId() > last) < 1_000
