"""The corpus pipeline: five stages, each applied to all that the one before it kept of the table `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sondage.llm.common import stage
from sondage.llm.decontaminate import drop_contaminated
from sondage.llm.line_dedup import drop_repeated_lines
from sondage.llm.near_join import keep_one_of_each
from sondage.llm.packing import pack_documents
from sondage.llm.toxicity import drop_toxic, fit_toxicity, training_ids


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, learned from the labels outside the held-out fold, calls toxic.

    Null and empty texts have a score of their own (the bias); rows without id or label teach nothing; equal rows share one
    fate; an empty table stays empty; columns keep their names, whatever they are. Texts of any length are scored whole."""
    return drop_toxic(docs, fit_toxicity(docs, training_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of lines that occur earlier, by id and place; a document of nothing else goes.

    Null texts stay null, empty ones empty; rows with equal id and text share one fate; null ids come first; n_chars is
    counted anew. Other columns keep names and values. Texts of any length; an empty table stays empty."""
    return drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that a Jaccard similarity of 0.8 on 5-word shingles links: the one of the smallest id.

    Rows without id come last; of equal ids one text is chosen, of equal rows one stays. Rows without words (null, empty,
    white space) are in no group and all stay. Columns keep names and values; an empty table stays empty."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows hit a twentieth or more of the words.

    Null and empty texts have no words and stay; equal rows share one fate; ids play no part; texts of any length are
    searched whole; columns keep names and values; an empty table or an empty benchmark changes nothing."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, each with its sequence and place.

    Null and empty texts are one end token; equal rows are packed one by one, rows without id like others; long texts are
    cut into pieces; other columns do not matter; an empty table gives no pieces."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A trained classifier and a tokenizer are beyond SQL; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
