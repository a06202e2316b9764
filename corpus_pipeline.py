"""From raw documents to encoded training text: each stage works on what the one before kept.

Every stage is written as Parquet in the shared folder and read again, so a lost
executor costs at most the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import language_id, mixing, near_texts, sentencepiece_nbest, simhash, substring_dedup
from marquee.llm.common import bounded_batches, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts without letters, in other languages and gibberish go.

    Texts of any length are judged by labelled texts of like length. Nulls in lang are no lesson;
    without any labelled text no language is known and every document goes.
    """
    bounded_batches(spark)
    profiles = written(language_id.learn_profiles(docs), "profiles")
    limits = language_id.learn_limits(docs, profiles)
    tagged = language_id.annotate(docs, profiles)
    return tagged.where(language_id.within_limits(limits)).select([F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles of Jaccard similarity 0.8."""
    bounded_batches(spark)
    return simhash.one_of_each(docs, classes_of=near_texts.similar_texts)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that repeat earlier ones; n_chars follows the text.

    Null and empty texts stay as they are; a text that only repeats others becomes empty.
    """
    bounded_batches(spark)
    cut = substring_dedup.drop_repeats(docs)
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars").cast("bigint"))
    return cut.withColumn("n_chars", chars).select([F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: none, one or two rows.

    A null source is a source of its own; texts without words weigh nothing.
    """
    return mixing.take_copies(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and the best segmentations of each row; null for a null text, none for an empty one."""
    bounded_batches(spark)
    return sentencepiece_nbest.encode_texts(docs.select("doc_id", "lang", "source", "text"), sentencepiece_nbest.MODEL)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("passages", cut_passages),
    ("mix", mix),
    ("encode", encode),
]

#: The stages rest on counts, hashes and iterations that SQL cannot express; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
