"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and gets all rows that its predecessor kept; between stages the rows are
written as Parquet. All but the last return the columns of documents (COLUMNS); other columns of docs, whatever their names, go.
Every stage takes rows with nulls in any column, empty and very long texts, repeated rows and empty tables; what becomes of
them stands with the stage. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavestrata.llm.jaccard_join import keep_one
from wavestrata.llm.mixing import SEED, WEIGHTS, mix_sources
from wavestrata.llm.packing import CAPACITY, pack_documents, vocabulary
from wavestrata.llm.quality import score_quality
from wavestrata.llm.store import written
from wavestrata.llm.substring_dedup import dedup_substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5 go.

    A null text is scored like an empty one; each of repeated rows is judged, and equal texts alike; a null doc_id has no label. Without labels all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score_quality(docs.select(*COLUMNS), labels).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 or more, the one with the least doc_id stays.

    Texts without words, or null, are linked with nothing and stay. Rows of one doc_id are one document, of which one row
    stays; rows without doc_id stay.
    """
    return keep_one(docs.select(*COLUMNS), n=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document, or an earlier place of the document, has too go; n_chars follows the text.

    A text that loses nothing, or is null or shorter than a window, stays as it is. A null doc_id comes last; rows with one doc_id and text lose the same words.
    """
    kept = dedup_substrings(docs.select(*COLUMNS), window=20)
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight asks for, in random order.

    Documents of no source, or of one without a weight, come once; null texts have no characters; rows with one doc_id and source come equally often.
    """
    return mix_sources(docs.select(*COLUMNS), WEIGHTS, SEED).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences.

    A null or empty text is the end id alone; every row is a document of its own, also when its doc_id is null or repeats.
    """
    return pack_documents(docs, vocabulary(), CAPACITY)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("packing", packing),
]

#: SQL cannot express the classifier and the tokenizer; tests/llm holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
