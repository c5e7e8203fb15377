import datetime as dt

from tallymark.operators import matching


def test_fills_shuffle_different_amounts_once(spark):
    orders = spark.range(20_000).selectExpr("concat('o', id) as order_id", "date'2024-03-04' as captured_on", "id + 1 as net_paise")
    payouts = spark.createDataFrame([("a", dt.date(2024, 3, 6), 39_999), ("b", dt.date(2024, 3, 20), 10**6)], "settlement_id string, settled_on date, net_paise long")
    store = spark.sparkContext._jsc.sc().statusStore()

    def written() -> int:
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    assert [tuple(r) for r in matching.greedy_fills(payouts, orders).collect()] == [("a", 39_999, 2, 39_999)]
    assert written() - before < 21_000
