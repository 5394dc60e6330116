"""Texts to vectors. An embedder is any object with `dimension` and `embed(texts) -> vectors`.

Embedding is a narrow step over Arrow batches, which span documents. A batch that fails is marked in columns `status`
and `error`, and `complete_sources` then leaves out whole documents, so that a stored document is always complete.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain
from typing import Protocol, TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chunkweave.operators.batches import ROWS, slices
from chunkweave.operators.remote import Caller, Pace

Result = TypeVar("Result")
Vectors = np.ndarray | list[list[float]]


class Embedder(Protocol):
    """`batch`, if there is one, is how many texts a call takes at most; 32 otherwise."""

    dimension: int

    def embed(self, texts: list[str]) -> Vectors: ...


class HashedWords:
    """Deterministic bag of words: each lower-case word counts in the bucket that the first byte of its MD5 names."""

    batch = ROWS

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def embed(self, texts: list[str]) -> Vectors:
        """Each different word of the batch is hashed once; all words are then counted by (text, bucket) in one step."""
        words = [t.lower().split() for t in texts]
        bucket = {w: hashlib.md5(w.encode()).digest()[0] % self.dimension for w in set(chain.from_iterable(words))}
        cell = np.fromiter(map(bucket.__getitem__, chain.from_iterable(words)), "i8")
        cell += np.repeat(np.arange(len(texts)) * self.dimension, list(map(len, words)))
        return np.bincount(cell, minlength=len(texts) * self.dimension).reshape(len(texts), self.dimension).astype("f8")


class Remote:
    """Embedder over any service: call(texts) -> vectors in the same order."""

    def __init__(self, call: Callable[[list[str]], list[list[float]]], dimension: int) -> None:
        self.call, self.dimension = call, dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.call(texts) if texts else []


def retry(call: Callable[[], Result], attempts: int = 5, base_delay: float = 5.0, what: str = "the call", sleep: Callable[[float], None] = time.sleep) -> Result:
    """Call again after 1, 2, 4, ... times base_delay; after the last attempt raise RuntimeError."""
    for k in range(attempts):
        try:
            return call()
        except Exception as error:  # any failure of a remote service
            if k + 1 == attempts:
                raise RuntimeError(f"{what} failed {attempts} times: {error}") from error
            sleep(base_delay * 2**k)
    raise ValueError("attempts must be positive")


def checked(vectors: Vectors, n: int, dimension: int) -> Vectors:
    if len(vectors) != n:
        raise ValueError(f"{len(vectors)} vectors for {n} texts")
    for v in vectors:
        if len(v) != dimension:
            raise ValueError(f"a vector has {len(v)} components, not {dimension}")
    return vectors


def outcome(one: Callable[[list[str]], Vectors], some: list[str]) -> Vectors | Exception:
    try:
        return one(some)
    except (RuntimeError, ValueError) as error:
        return error


def listed(vectors: list[Vectors | None], sizes: list[int]) -> pa.Array:
    """Vectors of several calls as one Arrow column; null for the texts of a call that failed."""
    if all(isinstance(v, np.ndarray) for v in vectors):
        whole = np.concatenate(vectors) if vectors else np.empty((0, 0))
        ends = np.arange(len(whole) + 1, dtype="i4") * whole.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(whole.ravel()))
    flat = [None if v is None else list(v) for call, n in zip(vectors, sizes, strict=True) for v in ([None] * n if call is None else call)]
    return pa.array(flat, pa.list_(pa.float64()))


def embed(rows: DataFrame, embedder: Embedder, batch: int | None = None, attempts: int = 1, base_delay: float = 5.0, pace: Pace | None = None) -> DataFrame:
    """Add vector, status ('ok' or 'failed') and error to rows with a column text. Texts go to the embedder in batches; a failed call is repeated.

    pace: for a remote service; rows are dealt to its number of tasks, which share its rate and keep several calls in flight.
    """
    rows = rows.repartition(pace.tasks) if pace else rows
    most = batch or getattr(embedder, "batch", 32)
    place = rows.columns.index("text")

    def vectors(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller = Caller(pace) if pace else None
        ask = caller.call if caller else lambda call: call()

        def one(some: list[str]) -> Vectors:
            call = lambda: ask(lambda: checked(embedder.embed(some), len(some), embedder.dimension))
            return retry(call, attempts, base_delay, "embedding")

        for part in slices(parts, max(1, ROWS // most) * most):
            found: list[Vectors | None] = []
            errors: list[str | None] = []
            texts = [t or "" for t in part.column(place).to_pylist()]
            calls = [texts[at : at + most] for at in range(0, len(texts), most)]
            outcomes = caller.all([partial(one, some) for some in calls]) if caller else map(partial(outcome, one), calls)
            for some, got in zip(calls, outcomes, strict=True):
                bad = isinstance(got, Exception)
                found.append(None if bad else got)
                errors += [str(got) if bad else None] * len(some)
            status = pa.array(["ok" if e is None else "failed" for e in errors], pa.string())
            columns = [*part.columns, listed(found, list(map(len, calls))), status, pa.array(errors, pa.string())]
            yield pa.record_batch(columns, [*part.schema.names, "vector", "status", "error"])

    schema = T.StructType([*rows.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("status", T.StringType()), T.StructField("error", T.StringType())])
    return rows.mapInArrow(vectors, schema)


def complete_sources(embedded: DataFrame) -> DataFrame:
    """Rows of documents (column source) of which no chunk failed."""
    failed = embedded.where("status <> 'ok'").select("source").distinct()
    return embedded.join(failed, "source", "left_anti").drop("status", "error")


def hashed_counts(rows: DataFrame, keys: list[str], dimension: int = 64) -> DataFrame:
    """The hashed bag of words as rows (keys, bucket, n): a row's counts are its own, so nothing is shuffled. keys name a row."""
    embedder = HashedWords(dimension)

    def counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            found = embedder.embed([t or "" for t in part.column(len(keys)).to_pylist()])
            row, bucket = found.nonzero()
            columns = [part.column(i).take(pa.array(row)) for i in range(len(keys))]
            yield pa.record_batch([*columns, pa.array(bucket, pa.int32()), pa.array(found[row, bucket], pa.int64())], [*keys, "bucket", "n"])

    rows = rows.select(*keys, "text")
    return rows.mapInArrow(counts, T.StructType([*rows.schema.fields[: len(keys)], T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())]))
