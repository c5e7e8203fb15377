"""Which texts hold which references, by an index of the texts' character runs.

Every text is entered under all its runs of a few characters, every reference looks only at the rarest of its own
runs, and what meets there is compared as a whole. Short references are runs themselves. The result is that
of comparing each text with each reference.

Defined results: null and empty references are in no text, null texts hold none; equal references are told each
by its own id; case counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a run.
RUN = 6


def _runs(text: Column, size: Column | int) -> Column:
    """All distinct runs of ``size`` characters; none of a shorter text."""
    n = size if isinstance(size, Column) else F.lit(size)
    last = F.char_length(text) - n + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, n)))).otherwise(F.array().cast("array<string>"))


def holding(texts: DataFrame, references: DataFrame, run: int = RUN) -> DataFrame:
    """(text_id, reference_id) of texts (text_id, text) and references (reference_id, reference) where the text holds the reference."""
    known = references.where(F.char_length("reference") > 0).select("reference_id", "reference")
    long = known.where(F.char_length("reference") >= run)
    entries = texts.select("text_id", F.explode(_runs(F.col("text"), run)).alias("run"))
    sizes = entries.groupBy("run").agg(F.count("*").alias("n"))
    asked = long.select("reference_id", "reference", F.explode(_runs(F.col("reference"), run)).alias("run")).join(sizes, "run", "left")
    rarest = asked.groupBy("reference_id", "reference").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("least")).where("least.n > 0")  # a run that no text has: nowhere
    met = rarest.select("reference_id", "reference", F.col("least.run").alias("run")).join(entries, "run").join(texts.select("text_id", "text"), "text_id")
    whole = met.where(F.contains("text", "reference")).select("text_id", "reference_id")
    short = known.where(F.char_length("reference") < run).withColumn("size", F.char_length("reference"))
    sizes_asked = F.explode(F.sequence(F.lit(1), F.lit(run - 1)))
    parts = texts.select("text_id", "text", sizes_asked.alias("size")).join(F.broadcast(short.select("size").distinct()), "size").select("text_id", "size", F.explode(_runs(F.col("text"), F.col("size"))).alias("reference"))  # a few sizes
    return whole.unionByName(parts.join(short, ["size", "reference"]).select("text_id", "reference_id")) if run > 1 else whole
