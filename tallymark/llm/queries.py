"""The registered queries of the training-data operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import twins
from tallymark.llm.common import fold, read_table


def op1_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymark.llm.warc import read_archives, write_archives

    records = read_archives(write_archives(read_table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymark.llm import toxicity

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), keep=fold("doc_id", 5) != 0)
    return toxicity.score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tallymark.llm.bpe import encode_documents

    return encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymark.llm.topk import top_k

    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymark.llm.substrings import dedup_substrings

    return dedup_substrings(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tallymark.llm.packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymark.llm.katz import Model

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = Model(docs, train=fold("doc_id", 10) != 0).score()
    return scores.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymark.llm.jaccard import linked_components

    return linked_components(read_table(spark, sf_dir, "documents"), n=3, t100=90)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymark.llm import langid

    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang"), keep=fold("doc_id", 4) != 2)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymark.llm.media import read_media, store_media

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_media(store_media(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymark.llm.merkle import verified

    picked = F.col("doc_id").isNotNull() & (fold("doc_id", 5) == 0)
    changed = F.when(picked, F.translate("text", twins.UPPER, twins.LOWER)).otherwise(F.col("text"))
    return verified(read_table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"text": changed})


def slips(doc_id: str) -> Callable[[str], str]:
    """The runs of a document with the contract's slips: one in 97 loses a character."""
    start = zlib.crc32(f"{doc_id}:".encode())

    def changed(run: str) -> str:
        h = zlib.crc32(run.encode(), start)
        return run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]

    return changed


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymark.llm.variants import variants, word_counts

    return variants(word_counts(read_table(spark, sf_dir, "documents"), change=slips))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tallymark.llm.bytebpe import encode_documents

    return encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_archives": op1_warc_archives,
    "op2_toxicity": op2_toxicity,
    "op3_bpe_encode": op3_bpe_encode,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_katz_scores": op7_katz_scores,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_language_id": op9_language_id,
    "op10_media_columns": op10_media_columns,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLE_SQL: dict[str, str] = {
    "op4_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op11_merkle_manifest": twins.MERKLE,
    "op12_spelling_variants": twins.VARIANTS,
}
