"""What a task sends at once, and so holds, is bounded, whatever a batch brings."""

from functools import partial

import pyarrow as pa
from chunkweave import BATCH_BYTES, bounded
from chunkweave.llm import substring
from chunkweave.operators.chunking import chunk
from chunkweave.operators.embedding import HashedWords, embed, hashed_counts
from pyspark.sql import types as T

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


class Captured:
    """Stands for a DataFrame and gives back the function that it is asked to run."""

    def __init__(self, schema):
        self.schema = T.StructType.fromDDL(schema)
        self.columns = self.schema.names

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return run


def texts(n, words=300):
    return [f"text {i} " + "some words. " * (words // 2) for i in range(n)]


def largest(run, batch):
    sent = list(run(iter([batch])))
    return max(b.nbytes for b in sent), sum(b.num_rows for b in sent)


def test_chunks_leave_in_small_batches(spark):
    batch = pa.record_batch([pa.array([f"s{i}" for i in range(5000)]), pa.array(texts(5000))], ["source", "text"])
    size, n = largest(chunk(Captured("source string, text string")), batch)
    assert size < 2 << 20 and n == 10_000


def test_counts_and_vectors_leave_in_small_batches(spark):
    batch = pa.record_batch([pa.array([f"s{i}" for i in range(10_000)]), pa.array(texts(10_000, 100))], ["source", "text"])
    size, n = largest(hashed_counts(Captured("source string, text string"), ["source"]), batch)
    assert size < 2 << 20 and n >= 30_000
    size, n = largest(embed(Captured("source string, text string"), HashedWords()), batch)
    assert size < 4 << 20 and n == 10_000


def test_cut_texts_leave_in_small_batches():
    marks = pa.array([[]] * 4000, pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("check", pa.int64())])))
    batch = pa.record_batch([pa.array(range(4000)), pa.array(texts(4000)), marks], ["doc_id", "text", "marks"])
    size, n = largest(partial(substring.applied, k=13), batch)
    assert size < 2 << 20 and n == 4000


def test_batches_for_python_end_by_bytes(spark):
    held = spark.conf.get(NAME, None)
    try:
        spark.conf.unset(NAME)
        bounded(spark)
        assert int(spark.conf.get(NAME).removesuffix("b").removesuffix("B")) == BATCH_BYTES
        rows = spark.range(3000, numPartitions=1).selectExpr("repeat('x', 10000) AS t")
        sizes = [r.n for r in rows.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()]
        assert sum(sizes) == 3000 and max(sizes) * 10_000 <= 2 * BATCH_BYTES
        spark.conf.set(NAME, 1 << 20)
        bounded(spark)
        assert int(spark.conf.get(NAME).removesuffix("b").removesuffix("B")) == 1 << 20  # what the session says holds
    finally:
        spark.conf.set(NAME, held) if held else spark.conf.unset(NAME)
