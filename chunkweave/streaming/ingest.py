"""Continuous ingest: new text files of a folder go through the same steps as a batch.

Structured Streaming remembers the files it has read by path in its checkpoint; the store's ids make repeats harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chunkweave.plans.pipeline import Pipeline
from chunkweave.sources.text_files import basename, with_text

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest_stream(spark: SparkSession, pipeline: Pipeline, folder: str, checkpoint: str) -> StreamingQuery:
    """Ingest what is new in the folder, then stop."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.txt").load(folder)

    def upsert(batch: DataFrame, _: int) -> None:
        pipeline.ingest_documents(with_text(batch, basename(F.col("path"))).where("status = 'ok'"))
        pipeline.release()

    return files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
