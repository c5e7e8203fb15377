"""Advisory operators: scans of untrusted text, grounding of statements, falsification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Directives that don't belong in records, in order of precedence; the first found counts (fixed values).
PATTERNS = (
    r"(?i)system\s*override",
    r"(?i)ignore\s+(all\s+)?(previous\s+)?instructions",
    r"(?i)approve\s+(close|period|verdict)",
    r"(?i)bypass\s+(verification|blocker|materiality)",
    r"(?i)verdict\s*:\s*ready_to_close",
    r"(?i)disregard\s+(all\s+)?blockers?",
    r"(?i)set\s+status\s+to\s+proven",
    r"(?i)you\s+are\s+now\s+in\s+developer\s+mode",
    r"(?i)delete\s+all\s+exceptions?",
)


def first_pattern(text: Column) -> Column:
    """What the first pattern that is found matches; null if none is."""
    found = [F.when(text.rlike(p), F.regexp_extract(text, p, 0)) for p in PATTERNS]
    return F.coalesce(*found)


def sanitised(text: Column) -> Column:
    """A text marked as untrusted, its code fences made harmless; empty for null."""
    return F.when(text.isNull() | (text == ""), "").otherwise(F.concat(F.lit("<untrusted_text>"), F.replace(text, F.lit("```"), F.lit("'''")), F.lit("</untrusted_text>")))


def scan(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, found, sanitised) of texts in which a directive stands."""
    return rows.select(key, first_pattern(F.col(text)).alias("found"), sanitised(F.col(text)).alias("sanitised")).where("found is not null")


def falsify(proposed: DataFrame, explanations: DataFrame) -> DataFrame:
    """Outcome of anchors (settlement_id, anchor array) against explanations
    (settlement_id, order_ids array): CONSISTENCY without one that holds the anchor,
    UNIQUENESS with several, else CONFIRMED."""
    joined = proposed.join(explanations, "settlement_id", "left")
    holds = F.col("order_ids").isNotNull() & (F.size(F.array_except("anchor", "order_ids")) == 0)
    counted = joined.groupBy("settlement_id", "anchor").agg(F.count_if(holds).alias("n"))
    return counted.select("settlement_id", "anchor", F.when(F.col("n") == 0, "CONSISTENCY").when(F.col("n") > 1, "UNIQUENESS").otherwise("CONFIRMED").alias("outcome"))


def grounded(statements: DataFrame, evidence: DataFrame) -> DataFrame:
    """(statement_id, n_refs, n_unknown, ok): settlement references in a text against known ids."""
    refs = statements.select("statement_id", F.explode_outer(F.regexp_extract_all("text", F.lit(r"(setl_\d+)"), F.lit(1))).alias("ref"))
    joined = refs.join(evidence.select(F.col("settlement_id").alias("ref"), F.lit(1).alias("known")).distinct(), "ref", "left")
    counts = joined.groupBy("statement_id").agg(F.count("ref").alias("n_refs"), F.count_if(F.col("ref").isNotNull() & F.col("known").isNull()).alias("n_unknown"))
    return counts.withColumn("ok", F.col("n_unknown") == 0)


#: Amounts in a text: a rupee sign or Rs., digits with commas, and paise or none (fixed pattern).
AMOUNT = r"(?:₹|Rs\.?\s*)([0-9,]+(?:\.[0-9]{2})?)"


def grounded_amounts(statements: DataFrame, evidence: DataFrame) -> DataFrame:
    """(statement_id, place, paise, ok): amounts that statements (statement_id, text) name, against what their evidence
    (statement_id, paise) holds.

    An amount is grounded if it, or its whole rupees, is an amount of the evidence, that amount in rupees, the difference
    of two of these, or that difference in rupees. A rupee and less needs no ground. Differences are looked for by
    joins on what the other amount would have to be. A statement without evidence grounds nothing.
    """
    named = statements.select("statement_id", F.posexplode(F.regexp_extract_all("text", F.lit(AMOUNT), F.lit(1))).alias("place", "said"))
    clean = F.regexp_replace("said", ",", "")
    named = named.where(F.length(clean) > 0).withColumn("paise", F.round(clean.try_cast("decimal(30,2)") * 100).cast("long"))
    asked = named.select("statement_id", "place", "paise", F.explode(F.array_distinct(F.array("paise", F.floor(F.col("paise") / 100).cast("long")))).alias("x"))
    held = evidence.where("paise is not null").select("statement_id", F.explode(F.array(F.abs("paise"), F.floor(F.abs("paise") / 100).cast("long"))).alias("v")).distinct()
    met = asked.join(held.withColumnRenamed("v", "x"), ["statement_id", "x"]).select("statement_id", "place")
    larger = asked.join(held, "statement_id")  # an amount meets the amounts of its own statement
    smaller = held.withColumnRenamed("v", "w")
    exact = larger.withColumn("w", F.col("v") - F.col("x")).join(smaller, ["statement_id", "w"]).select("statement_id", "place")
    hundred = F.floor((F.col("v") - 100 * F.col("x")) / 100).cast("long")
    near = larger.withColumn("bucket", F.explode(F.array(hundred, hundred - 1))).join(smaller.withColumn("bucket", F.floor(F.col("w") / 100).cast("long")), ["statement_id", "bucket"])
    whole = near.where((F.col("v") - F.col("w")).between(100 * F.col("x"), 100 * F.col("x") + 99)).select("statement_id", "place")
    good = met.union(exact).union(whole).distinct().withColumn("found", F.lit(True))
    ok = (F.col("paise") <= 100) | F.coalesce("found", F.lit(False))
    return named.join(good, ["statement_id", "place"], "left").select("statement_id", "place", "paise", ok.alias("ok"))
