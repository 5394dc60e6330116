"""Document retrieval on Spark."""

from __future__ import annotations

import os
from importlib import import_module

from pyspark.sql import SparkSession

#: The folder that holds this package.
HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, if they share that folder.

    Where they don't, ship the package with --py-files or install it.
    """
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if HOME not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([HOME, known] if known else [HOME])


#: Bytes of rows that Spark sends to a Python worker at once.
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> None:
    """Let batches of rows for Python workers end by bytes too, not by the number of rows alone, if the session says nothing about it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


#: Public names and the modules that hold them; imported when they are asked for, so that workers load only what they run.
EXPORTS = {
    "Pipeline": "plans.pipeline", "Settings": "settings", "Collection": "sources.collection", "Embedder": "operators.embedding",
    "HashedWords": "operators.embedding", "Remote": "operators.embedding", "Pace": "operators.remote", "Generator": "operators.prompt", "Echo": "operators.prompt",
    "Chat": "operators.prompt", "chunk": "operators.chunking", "search": "operators.search", "VectorIndex": "sources.index",
}
__all__ = ["bounded", "prepare", *EXPORTS]


def __getattr__(name: str) -> object:
    if name in EXPORTS:
        return getattr(import_module(f"{__name__}.{EXPORTS[name]}"), name)
    raise AttributeError(name)
