"""The training-data pipeline over `documents`: quality rules, near duplicates, repeated passages, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared folder and read
again as the next stage's docs. All stages but the last return the columns of documents. What run() writes on the way is
removed when it ends or fails; the last table stays, as its result.

Defined results: documents without text, or with an empty one, fail the quality rules; null ids and repeated rows are treated as each
operator says; empty tables give an empty result; further columns of documents pass through all stages but the last,
whatever their names. `n_chars` follows a text that is cut.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave import bounded, prepare
from chunkweave.llm import budget_mix, packing, quality_rules, simhash, substring
from chunkweave.llm.common import read, shared_folder, working_folder
from chunkweave.sources.files import Files


def ready(spark: SparkSession) -> None:
    """Rows hold whole texts, often twice: batches of them for Python end by bytes."""
    prepare(spark)
    bounded(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base checks or a learnt rule go."""
    ready(spark)
    return quality_rules.filtered(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, similarity 0.8 or more."""
    ready(spark)
    return simhash.keep_one(docs, similarity=0.8, shingle=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 13 words that also start in a smaller document are cut out; every document stays."""
    ready(spark)
    kept = substring.deduplicated(docs, k=13)
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return kept.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ready(spark)
    return budget_mix.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    ready(spark)
    return packing.packed_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mix to weights", mixture),
    ("best-fit packing", packed),
]

#: Learnt rules, tokens and packing are not to be said in SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    result = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        with working_folder(spark) as folder:
            for k, (_, stage) in enumerate(STAGES):
                table = result if k + 1 == len(STAGES) else f"{folder}/{k}"
                stage(spark, docs, sf_dir).write.parquet(table)
                docs = spark.read.parquet(table)
    except BaseException:
        Files(spark, result).remove()
        raise
    return docs
