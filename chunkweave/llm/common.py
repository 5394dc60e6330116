"""What the training-data operators share: word rules, checkpoints, working folders, sealed rows, components."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.sources.files import Files, shared_folder

#: Java pattern of the separators between words: space and U+0009 to U+000D.
BLANKS = "[\\x20\\x09-\\x0D]+"
#: Links in a partition, about.
LINKS = 250_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def col(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def sealed(df: DataFrame) -> Column:
    """The whole input row as one struct, so that no extra column can clash with a working column."""
    return F.struct(*[col(c) for c in df.columns]).alias("row")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def working_folder(spark: SparkSession) -> Iterator[str]:
    """A new folder in the shared one. It is removed at the end, after a failure too."""
    folder = f"{shared_folder(spark)}/working-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        Files(spark, folder).remove()


def words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+` of a text; a null text has none. Only the ends of a split can be empty."""
    parts = F.split(F.coalesce(text, F.lit("")), BLANKS)
    lead = (F.element_at(parts, 1) == "").cast("int")
    trail = ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return F.slice(parts, lead + 1, F.size(parts) - lead - trail)


def stars(edges: DataFrame) -> bool:
    """Whether each upper end a has one lower end b, which is no upper end itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("high")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("high")))
    odd = ends.groupBy("node").agg(F.sum("high").alias("high"), F.count_if(F.col("high") == 0).alias("low")).where("high > 1 or (high > 0 and low > 0)")
    return not odd.agg(F.count("*")).first()[0]


def min_labels(links: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars.

    links: columns a, b (any order, repeats allowed). Returns node, label: the smallest node that can
    be reached, for each node with a link other than to itself. Each round is a few joins and
    aggregations and ends in a checkpoint, until only stars are left; just counts reach the driver. Few links are held in few partitions.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    parts = max(1, math.ceil(edges.count() / LINKS))
    edges = edges.coalesce(parts)
    while not stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").coalesce(parts).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpointed(small.unionByName(least.select("a", F.col("m").alias("b"))).coalesce(parts).distinct().coalesce(parts))
    lower = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(lower)
