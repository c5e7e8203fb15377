"""What changed between two runs, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Full outer comparison of findings by settlement: direction and amounts."""
    a = before.select("settlement_id", F.col("verdict").alias("was"), F.col("order_id").alias("was_order"), F.col("candidates").alias("was_candidates"), F.col("net_paise").alias("was_paise"))
    b = after.select("settlement_id", F.col("verdict").alias("now"), F.col("order_id").alias("now_order"), F.col("candidates").alias("now_candidates"), F.col("net_paise").alias("now_paise"))
    both = a.join(b, "settlement_id", "full_outer")
    direction = (
        F.when(F.col("was").isNull(), "APPEARED").when(F.col("now").isNull(), "VANISHED")
        .when((F.col("was") == F.col("now")) & F.col("was_order").eqNullSafe(F.col("now_order")), "UNCHANGED")
        .when((F.col("was") == "PROVEN") & (F.col("now") == "PROVEN"), "RECOMPOSED").when(F.col("now") == "PROVEN", "RESOLVED")
        .when(F.col("was") == "PROVEN", "WITHDRAWN").otherwise("REFRAMED")
    )
    moved = F.coalesce("now_candidates", F.lit(0)) - F.coalesce("was_candidates", F.lit(0))
    return both.select("settlement_id", "was", "now", direction.alias("direction"), moved.alias("candidates_moved"), F.coalesce("now_paise", "was_paise").alias("amount_paise"))


def gates(before: DataFrame, after: DataFrame) -> DataFrame:
    """Regression gates over two one-row metric tables: fatal if proofs fall or blocks rise."""
    table = [("proven", "up", True), ("ambiguous", "down", False), ("contradicted", "down", True), ("exposure_paise", "down", False)]
    spark = before.sparkSession
    rules = spark.createDataFrame(table, "metric string, better string, fatal boolean")
    names = [m for m, _, _ in table]
    old, new = (df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("value")) for m in names])).alias("m")).select("m.*") for df in (before, after))
    joined = rules.join(old.withColumnRenamed("value", "before"), "metric").join(new.withColumnRenamed("value", "after"), "metric")
    worse = F.when(F.col("better") == "up", F.col("after") < F.col("before")).otherwise(F.col("after") > F.col("before"))
    return joined.select("metric", "before", "after", F.when(~worse, "PASS").when(F.col("fatal"), "FAIL").otherwise("WARN").alias("result"))
