"""The registered queries of the operators, with their production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.llm import alignment, chunks, decontam, embeddings, html, jaccard, langid, licenses, pii, quality, resample, sentencepiece, tokens
from timeloom.llm.session import fold_column, table
from timeloom.llm.sql import embeddings_sql, jaccard_sql, licences_sql, pii_sql, resample_sql

WORDS = "/opt/tokenizers/word_bpe_49k.json"
BYTES = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def held_out() -> Column:
    """Whether a row is of the fold that nothing is learned from; a row without an id is of none."""
    return F.coalesce(fold_column() == 1, F.lit(False)).alias("held_out")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = licenses.scan(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), F.col("n_unknown").cast("long").alias("n_unknown"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold_column() != 1).select("doc_id", "text", "lang"))
    return langid.predict(docs, model).select("doc_id", held_out(), "lang_pred", "score")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.round_trip(table(spark, sf_dir, "documents"), sentencepiece.load(TOKENIZER))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = chunks.repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_passages", "repeated_bytes", "removed_bytes", "first_docs", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, trained_quality(spark, sf_dir))
    return scored.select("doc_id", held_out(), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def trained_quality(spark: SparkSession, sf_dir: str, max_rows: int = 20_000) -> quality.Forest:
    """The classifier fitted on the labelled rows outside the held-out fold, at most about ``max_rows`` of them."""
    labels = table(spark, sf_dir, "labels").where(fold_column() != 1).where("quality in (0, 1)").select("doc_id", F.col("quality").alias("label"))
    share = min(1.0, max_rows / max(1, labels.count()))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    return quality.train(table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), max_rows=max_rows)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return got.select(
        F.col("id").alias("doc_id"),
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)],
        F.sha2(pii.written(F.col("spans")).cast("binary"), 256).alias("base_sha256"),
        pii.written(pii.all_spans(F.col("spans"), F.col("terms"))).alias("spans"),
    )


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(table(spark, sf_dir, "documents"), tokens.load(WORDS))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), alignment.load(BYTES, TOKENIZER))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_language_id": op2_language_id,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_decontamination": op5_decontamination,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_html_extraction": op7_html_extraction,
    "op8_quality": op8_quality,
    "op9_pii": op9_pii,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_token_counts": op11_token_counts,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}
ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": licences_sql(),
    "op3_ngram_jaccard": jaccard_sql(),
    "op9_pii": pii_sql(),
    "op10_embedding_dedup": embeddings_sql(),
    "op12_importance_resampling": resample_sql(),
}
