"""From raw documents to training ids: quality, near duplicates, benchmark passages, personal data, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of ``documents``. Nulls in any column, repeated rows and rows that share an id are allowed everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.llm import decontam, jaccard, pii, quality, sentencepiece
from timeloom.llm.queries import TOKENIZER, trained_quality
from timeloom.llm.session import checkpointed, numbered, small, table

#: Near duplicates of the pipeline: five-word shingles, a similarity of 0.8.
NEAR = jaccard.JaccardJoin(shingle=5, percent=80)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more."""
    scored = quality.score(docs, trained_quality(spark, sf_dir), keep=True)
    return scored.where("quality_score >= 0.5").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the one with the smallest id, else any one.

    Of rows that repeat an id and a text one stays, and so of rows without an id that repeat a text. Texts without words
    are no copies of each other: rows with them stay unless they repeat an id too.
    """
    rows = numbered(docs)
    found = jaccard.components(rows, NEAR, id_column="__row")
    kept = rows.join(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__row")).distinct(), "__row", "left_anti")
    named = "doc_id is not null or trim(text) <> ''"
    again = checkpointed(rows.where(named).groupBy("__row").agg(F.count("*").alias("n")).where("n > 1").select("__row"))
    if again.isEmpty():
        return kept.select(*docs.columns)
    again = small(again)
    repeated = kept.join(again, "__row", "left_semi")
    one = repeated.where(named).dropDuplicates(["__row"])
    return kept.join(again, "__row", "left_anti").unionByName(one).unionByName(repeated.where(f"not ({named})")).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; a row without an id goes by its own text."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and words that reveal it, replaced; n_chars is that of the new text."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its ids, their numbers, the text they decode to, and whether that is the text they were made of."""
    return sentencepiece.round_trip(docs, sentencepiece.load(TOKENIZER), with_text=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", sentencepiece_ids),
]
#: Fitted trees, links and Viterbi paths are beyond SQL; a brute-force version in the tests stands for it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage kept is checkpointed for the next one."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
