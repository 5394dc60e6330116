"""Ranked document candidates and retrieval quality by document."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.functions import text as X
from chunkweave.operators.batches import slices

#: Bytes of passages that are sent to every task at once; an automaton takes some tens of bytes for each.
PASSAGE_BYTES = 4 << 20


def candidates(questions: DataFrame, hits: DataFrame, most: int = 10) -> DataFrame:
    """question_id and document_ids: the documents of the hits by their best rank, at most `most` and, with hits, at least one."""
    best = hits.groupBy("question_id", X.document_id(F.col("source")).alias("doc")).agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))
    kept = best.withColumn("place", place).where(F.col("place") <= max(most, 1))
    held = kept.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc"))).alias("docs"))
    ids = F.transform("docs", lambda x: x["doc"])
    return questions.select("question_id").join(held, "question_id", "left").select("question_id", F.coalesce(ids, F.array().cast("array<string>")).alias("document_ids"))


def containing(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """question_id, doc: which documents (source, text) hold a passage (question_id, question) word for word.

    One scan of the documents finds all passages of a block at once by an automaton. Blocks of about PASSAGE_BYTES, as
    counted in Spark, are sent to all tasks one after another; only one block at a time is in the driver's memory.
    """
    asked = passages.select("question_id", "question").where("question <> ''")
    total = asked.agg(F.coalesce(F.sum(F.octet_length("question")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / PASSAGE_BYTES))
    number = F.pmod(F.xxhash64("question"), F.lit(blocks))
    found = [scanned(documents, asked.where(number == block)) for block in range(blocks)]
    return reduce(DataFrame.unionByName, found).select("question_id", X.document_id(F.col("source")).alias("doc"))


def scanned(documents: DataFrame, block: DataFrame) -> DataFrame:
    """question_id, source: the documents that hold passages of one block."""
    texts: dict[str, list] = {}
    for r in block.toLocalIterator():
        texts.setdefault(r.question, []).append(r.question_id)
    sent = documents.sparkSession.sparkContext.broadcast(texts)
    kind = block.schema["question_id"].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t, ids in sent.value.items():
            automaton.add_word(t, tuple(ids))
        if len(automaton):
            automaton.make_automaton()
        for batch in slices(batches):
            found: list[tuple] = []
            for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = {i for _, ids in automaton.iter(text) for i in ids} if text and len(automaton) else ()
                found += [(i, source) for i in held]
            yield pa.record_batch([pa.array([f[0] for f in found], pa.int64() if kind.simpleString() == "bigint" else pa.string()), pa.array([f[1] for f in found], pa.string())], ["question_id", "source"])

    return documents.select("source", "text").mapInArrow(scan, f"question_id {kind.simpleString()}, source string")


def gold_sets(questions: DataFrame, links: DataFrame) -> DataFrame:
    """question_id and gold, the set of documents that answer it, perhaps empty. links: question_id, doc."""
    held = links.groupBy("question_id").agg(F.array_sort(F.collect_set("doc")).alias("gold"))
    return questions.select("question_id").join(held, "question_id", "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<string>")))


def scored(proposed: DataFrame, gold: DataFrame) -> DataFrame:
    """question_id, n_gold, n_found, n_extra and recall (null without gold)."""
    both = gold.join(proposed, "question_id", "left").withColumn("document_ids", F.coalesce("document_ids", F.array().cast("array<string>")))
    n, hit = F.size("gold"), F.size(F.array_intersect("gold", "document_ids"))
    return both.select(
        "question_id", n.alias("n_gold"), hit.alias("n_found"),
        F.size(F.array_except("document_ids", "gold")).alias("n_extra"), F.try_divide(hit.cast("double"), n).alias("recall"),
    )


def category_report(scores: DataFrame, categories: DataFrame) -> DataFrame:
    """For each category, and for all under 'all': n, recall and the shares of complete and of missed gold sets. Without gold: not counted."""
    rows = scores.where("n_gold > 0").join(categories, "question_id")
    report = rows.rollup("category").agg(
        F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall"),
        F.round(F.avg((F.col("n_found") == F.col("n_gold")).cast("double")), 6).alias("complete"),
        F.round(F.avg((F.col("n_found") == 0).cast("double")), 6).alias("missed"),
    )
    return report.withColumn("category", F.coalesce("category", F.lit("all")))


def sampled(documents: DataFrame, gold: DataFrame, distractors: int, seed: int = 0) -> DataFrame:
    """source and wanted: documents of the gold set, and the first others in order of a seeded MD5."""
    marked = documents.select("source", X.document_id(F.col("source")).alias("doc"))
    wanted = gold.select("doc").distinct()
    order = F.md5(F.concat("source", F.lit(f":{seed}")).cast("binary"))
    rest = marked.join(wanted, "doc", "left_anti").orderBy(order, "source").limit(distractors)
    return marked.join(wanted, "doc", "left_semi").select("source", F.lit(True).alias("wanted")).unionByName(rest.select("source", F.lit(False).alias("wanted")))
