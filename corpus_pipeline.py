"""The corpus pipeline: language ID, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Stages but
the last return the columns of documents; ``run`` writes each result to the shared folder as
Parquet and reads it again for the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import jaccard, langid, packing, substrings, toxicity
from tallymark.llm.common import read_table, shared_path, staged

#: Under this share of the best language no language stands out.
LEAST_LANGUAGE = 0.3
#: From this score on a document goes.
TOXIC = 0.5
#: Near duplicates: words in a shingle, and similarity in hundredths.
SHINGLE, SIMILAR = 5, 80
VOCABULARY = "word_bpe_49k.json"


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; texts without letters or without a clear language go, null texts too.

    Null ids stay; an empty table stays empty; further columns are kept, whatever their names.
    """
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    found, share = fresh(docs, "_language"), fresh(docs, "_share")
    own = langid.with_languages(docs, model, lang_col=found, score_col=share)
    return own.where((F.col(found) != langid.UNKNOWN) & (F.col(share) >= LEAST_LANGUAGE)).select(docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier doesn't take for toxic; null and empty texts are scored like any other.

    Null ids stay; an empty table stays empty; further columns are kept, whatever their names.
    """
    model, score = toxicity.fit(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels")), fresh(docs, "_score")
    return toxicity.with_scores(docs, model, score_col=score).where(F.col(score) < TOXIC).select(docs.columns)


def keyed(docs: DataFrame, row: str) -> DataFrame:
    """docs with a number for each row in column ``row``, stored; rows are in order of id, a null id first."""
    at = fresh(docs, "_at")
    placed = docs.withColumn(at, F.monotonically_increasing_id())  # splits ids that many rows share
    return staged(placed.orderBy(F.col("doc_id").asc_nulls_first(), at).drop(at).withColumn(row, F.monotonically_increasing_id()), "keyed")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: one with the group's smallest id. Texts without a word are in no group and stay.

    Where ids repeat or are null, rows get numbers in order of id, null ids first, and these decide. An empty table
    stays empty; further columns are kept, whatever their names.
    """
    n = docs.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    row = "doc_id" if n["rows"] == n["ids"] else fresh(docs, "_row")
    own = docs if row == "doc_id" else keyed(docs, row)
    groups = jaccard.linked_components(own.select(row, "text"), n=SHINGLE, t100=SIMILAR, id_col=row)
    heads = groups.where(F.col("component_id") == F.col(row)).select(row)
    return own.join(heads, row, "left_semi").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without passages that stand earlier in the corpus; texts without one stay as they are.

    n_chars follows a text that changes. Null ids come first; null texts stay null; an empty table stays empty;
    further columns are kept, whatever their names.
    """
    changed = fresh(docs, "_changed")
    own = substrings.without_repeats(docs, changed)
    if "n_chars" in docs.columns:
        own = own.withColumn("n_chars", F.when(F.col(changed), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return own.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece with its sequence and place; a null text is an empty one, null ids are kept, an empty table has no pieces."""
    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language_id", language),
    ("toxicity", toxic),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("best_fit_packing", pack),
]

#: The stages learn and tokenize, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
