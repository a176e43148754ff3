"""The corpus pipeline: language ID, exact dedup, near-duplicate join, benchmark decontamination and encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents; the last returns each remaining document's ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import language_id
from granary.llm.bayes_jaccard import jaccard_classes, row_id
from granary.llm.common import fold, table, written
from granary.llm.decontaminate import benchmark, decontaminated
from granary.llm.exact_dedup import exact_dedup, text_digest
from granary.llm.merge_codec import encode_documents
from granary.llm.queries import piece_model


def _one_row_each(docs: DataFrame, key: Column, size: Column, kept: DataFrame) -> DataFrame:
    """One row of docs, that of the greatest `size`, for each key that `kept` has in its only column.

    Each task keeps one row a key before texts move, so a key of any number of rows is one row a task from there on; texts
    move once, by the key. docs' columns are one struct here, so no name of theirs can clash.
    """
    own = docs.select(F.struct("*").alias("row"), key.alias("key"), size.alias("size"))
    best = own.groupBy("key").agg(F.max_by("row", F.struct("size", F.xxhash64("row"))).alias("row"))
    return best.join(kept.toDF("key"), "key", "left_semi").select("row.*")


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter go, as op8 tells none for them."""
    model = language_id.train(docs.filter(fold(modulus=4) != 2).select("doc_id", "text", "lang"))
    return language_id.identified(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row that stays of each group of equal texts; of rows that repeat its id, the longest."""
    found = exact_dedup(docs.select("doc_id", "text")).filter("kept")
    key = lambda digest: F.xxhash64("doc_id", digest)
    return _one_row_each(docs, key(text_digest("text")), F.coalesce(F.length("text"), F.lit(0)), found.select(key(F.col("text_sha256"))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of texts with a Jaccard similarity of 0.8 or more on five-word shingles."""
    return _one_row_each(docs, row_id(), F.lit(0), jaccard_classes(docs.select("doc_id", "text")).filter("stays").select("rid"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, benchmark(table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded text of each document."""
    return encode_documents(docs, piece_model(), with_ids=True).drop("decoded")


STAGES = [
    ("language_id", identify),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: Trained models and edit distances over words are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
