from pyspark.sql import functions as F

from tallymark.operators import solver


def test_large_pools_are_refused_before_they_are_grouped(spark, monkeypatch):
    orders = spark.range(solver.MAX_POOL + 1).selectExpr("cast(id as string) as order_id", "date'2026-05-04' as captured_on", "1L as net_paise")
    more = spark.createDataFrame([("x", 700), ("y", 900)], "order_id string, net_paise long").selectExpr("order_id", "date'2026-05-05' as captured_on", "net_paise")
    payouts = spark.createDataFrame([("big", "2026-05-06", 5), ("one", "2026-05-07", 700), ("none", "2026-05-12", 70), ("dear", "2026-05-07", solver.MAX_TARGET + 1)], "settlement_id string, settled_on string, net_paise long").withColumn("settled_on", F.col("settled_on").cast("date"))
    kind, largest = type(payouts.groupBy("settlement_id")), []
    for name in ("applyInPandas", "applyInArrow"):

        def watched(self, *args, apply=getattr(kind, name)):
            largest.append(self._df.groupBy("settlement_id").count().agg(F.max("count")).first()[0])
            return apply(self, *args)

        monkeypatch.setattr(kind, name, watched)
    got = {r.settlement_id: (r.verdict, r.order_ids, r.exhaustive) for r in solver.solved(payouts, orders.unionByName(more)).collect()}
    assert got == {"big": ("INSUFFICIENT", [], False), "one": ("PROVEN", ["x"], True), "none": ("CONTRADICTED", [], True), "dear": ("INSUFFICIENT", [], False)}
    assert largest == [1]
