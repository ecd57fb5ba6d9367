"""Training-data pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input.

All stages but the last return the columns of ``documents``; each works on all that the one before has kept.  Learnt and
iterative stages have no SQL, so ``ORACLE_SQL`` is None and the tests compare with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import op2_quality_classifier as quality
from hushframe.llm.labelled import fold
from hushframe.llm.op5_substring_dedup import remove_repeats
from hushframe.llm.op7_bpe import encode
from hushframe.llm.op8_mixing import mix
from hushframe.llm.op10_ngram_jaccard import near_copies
from hushframe.llm.scratch import cut

ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of good quality stay; it learns from the labels of ``sf_dir``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    weights = quality.train(docs, labels, fold(F.col("doc_id"), 5) != 0)
    return quality.score(docs, weights).where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    A row without id stays if its group has no id at all; rows that repeat an id and its text become one.
    """
    first = near_copies(docs).where(F.col("component_id").eqNullSafe(F.col("doc_id")))
    return first.withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"]).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has are removed; a document that loses nothing keeps its white space."""
    got = remove_repeats(docs)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return got.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken by the probabilities that rake sources, languages and topics to their targets."""
    return mix(docs).where("taken").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    got = encode(docs.select("doc_id", "lang", "source", "text"), check=True)
    return got.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decodes")


STAGES = [
    ("quality_classifier", good_quality),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", target_weights),
    ("bpe", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
