"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer any context limit.

Documents are encoded once, in the tasks that read them, and only one row for each length and task
is shuffled. Sums over the lengths run in two levels, within blocks of `BLOCK` lengths and over the
blocks, so no task holds the whole histogram.

Defined results: a null or empty text has `extra` tokens (1 by default, the end mark); repeated rows
count as often as they stand; an empty table gives an empty histogram; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.llm.common import checkpointed, col
from chunkweave.llm.tokens import default_vocabulary, word_ids

BLOCK = 1024


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, extra: int = 1) -> DataFrame:
    """One row for each document: doc_id and n_tokens."""
    path = vocabulary or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(path)
        for batch in batches:
            n = [len(ids.text(t)) // 4 + extra for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return rows.mapInArrow(count, f"doc_id {rows.schema[0].dataType.simpleString()}, n_tokens long")


def length_histogram(counts: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """One row for each length that occurs, with sums over shorter and longer documents.

    n_docs and n_tokens of this length; docs_up_to and tokens_up_to (this length or shorter); docs_over
    and tokens_over (longer); truncated_tokens: what all documents hold if cut at this length.
    """
    hist = counts.groupBy(col(length_col).cast("long").alias("length")).agg(F.count("*").alias("n_docs"))
    hist = hist.where("length is not null")
    hist = checkpointed(hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / BLOCK).alias("block")))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "dt"], *[F.sum(c).over(everything).alias(f"{c}_all") for c in "dt"])
    longer = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda n, later: F.coalesce(F.sum(n).over(longer), F.lit(0)) + F.col(later)
    out = hist.join(blocks, "block").withColumns({"docs_over": over("n_docs", "d_later"), "tokens_over": over("n_tokens", "t_later")})
    return out.select(
        "length", "n_docs", "n_tokens",
        (F.col("d_all") - F.col("docs_over")).alias("docs_up_to"),
        (F.col("t_all") - F.col("tokens_over")).alias("tokens_up_to"),
        "docs_over", "tokens_over",
        (F.col("t_all") - F.col("tokens_over") + F.col("length") * F.col("docs_over")).alias("truncated_tokens"),
    )


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents that fit, tokens of those, and tokens of all when cut there.

    Read from the suffix sums of one row: that of the greatest length within the limit.
    """
    asked = F.broadcast(histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "`limit` long"))
    everything = histogram.agg(F.max(F.col("docs_up_to") + F.col("docs_over")).alias("n"))
    last = F.max(F.struct("length", "docs_up_to", "tokens_up_to"))
    held = histogram.join(asked, F.col("length") <= F.col("limit")).groupBy("limit").agg(last.alias("at"))
    fit = lambda c: F.coalesce(F.col(f"at.{c}"), F.lit(0))
    over = F.col("n") - fit("docs_up_to")
    out = asked.join(held, "limit", "left").join(F.broadcast(everything)).where("n is not null")  # one row
    return out.select("limit", fit("docs_up_to").alias("docs_fit"), fit("tokens_up_to").alias("tokens_fit"), (fit("tokens_up_to") + F.col("limit") * over).alias("truncated_tokens"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """For each share p: the least length such that at least p of all documents are no longer."""
    asked = histogram.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    reached = F.col("docs_up_to") >= F.col("share") * (F.col("docs_up_to") + F.col("docs_over"))
    return histogram.join(F.broadcast(asked)).where(reached).groupBy("share").agg(F.min("length").alias("length"))
