"""The training-data pipeline: quality, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns what it keeps; all but the last return the columns of
``documents``.  Between stages the rows lie in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.ranking import global_row_number
from lexspark.llm import bpe, decontaminate, lines, minhash, quality
from lexspark.llm.common import row_key, saved, table, without

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer keeps."""
    columns = docs.columns
    rows = quality.score(docs, quality.fit(docs), out="__quality")
    return rows.where(F.col("__quality") >= quality.KEEP).select(columns)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the multi-line chunks that stand elsewhere; those with nothing left go."""
    rows = lines.dedup(docs)
    left = (F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0)
    return rows.where(left).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
                                       .cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of every group of near-duplicates; a document is a row's id and text.

    Of rows that are equal in both one stays.  Rows are numbered in the order of
    their keys, since near-dedup takes integers.
    """
    rows = docs.withColumn("__row", row_key(docs)).dropDuplicates(["__row"])
    numbers = saved(global_row_number(rows.select("__row").distinct(), ["__row"], "__no"), "numbers")
    rows = saved(rows.join(numbers, "__row"), "numbered")
    bad = minhash.near_duplicates(rows, key="__no", size=5, percent=80).where("NOT kept")
    return without(rows, bad, "__no").select(docs.columns)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; a document is a row's id and text."""
    rows = docs.withColumn("__row", row_key(docs))
    found = decontaminate.contamination(rows.select(F.col("__row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(rows, found.where("contaminated").withColumnRenamed("doc_id", "__row"), "__row").select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents left: doc_id, ids (little-endian, 32 bits), n_tokens, and digests of ids and decoded text."""
    rows = bpe.encode_decode(docs.select("doc_id", F.col("text").cast("string").alias("text")), VOCABULARY)
    return rows.select("doc_id", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"), "ids",
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", distinct_lines),
    ("MinHash near-dedup", one_of_each_group),
    ("benchmark decontamination", not_in_benchmark),
    ("BPE encoding and decoding", encoded),
]

# The weak-label scorer and the encoder have no SQL form; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, name.replace(" ", "-"))
    return docs
