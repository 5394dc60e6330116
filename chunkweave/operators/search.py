"""Exact cosine search of many questions at once.

Scores are matrix products in tiles of bounded size, rounded to six digits; ties go by source, index and a hash of the row. Score and place among ties
are one whole number, so that the best of a tile is a partition of numbers.

Few questions, by a count of their bytes and of the hits that they can hold, go to every task, which reads its share of the store once and keeps the
best of it. More questions stay where they are: questions and vectors of the store are packed in blocks, and every group of blocks meets every block of
questions in a task of its own. Such a task sends ids alone; the other columns are joined to the hits that remain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkweave.sources.files import shared_folder

#: Bytes of question vectors that go to every task, and hits of all questions that such a task may hold.
SENT_BYTES, HELD_HITS = 4 << 20, 20_000
#: Bytes of vectors in a block of questions and in a group of blocks of the store, which meet in a task.
BLOCK_BYTES, GROUP_BYTES = 16 << 20, 64 << 20
#: Scores of a tile, and rows of the store in it.
TILE, WIDTH = 1 << 21, 8192
#: Bytes of hits that may be sent to all tasks for the last join.
HIT_BYTES, HIT = 32 << 20, 200
DEFAULT_TOP_K = 4
#: Rows that a task sends at once.
SENT_ROWS = 10_000
#: Steps of a score in one.
STEPS = 1_000_000
NONE = np.iinfo("i8").min


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; rows of zeros stay, and score 0."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def matrix(vectors: pd.Series | list, dimension: int) -> np.ndarray:
    return np.array([np.zeros(dimension) if v is None else v for v in vectors], "f8").reshape(len(vectors), dimension)


def improved(best: np.ndarray, questions: np.ndarray, rows: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """The k best numbers of each question, of those it had and those of the rows. A number is score * n + what is after the row's place among n."""
    k = best.shape[1]
    out = best.copy()
    for low in range(0, len(rows), WIDTH):
        x, after = rows[low : low + WIDTH], n - 1 - place[low : low + WIDTH]
        some = max(1, TILE // max(1, len(x)))
        for at in range(0, len(questions), some):
            score = np.rint(questions[at : at + some] @ x.T * STEPS).astype("i8")
            both = np.concatenate((out[at : at + some], score * n + after), axis=1)
            out[at : at + some] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
    return out


def decoded(best: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Question, score in steps and place of each number."""
    question, at = np.nonzero(best != NONE)
    number = best[question, at]
    return question, number // n, n - 1 - number % n


def tie_order(rows: pd.DataFrame) -> np.ndarray:
    return np.lexsort((rows["_row"].to_numpy("i8"), rows["index"].fillna(0).to_numpy("i8"), rows["source"].fillna("").to_numpy(str)))


def search(store: DataFrame, questions: DataFrame, top_k: int | None = None, threshold: float | None = None, default_k: int = DEFAULT_TOP_K, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """question_id, rank (from 1), score and the columns of store but vector.

    store: vector, source, index, more; questions: question_id, vector, of which those with one id share a ranking. A top_k of None or 0 means the default; a
    threshold of None or 0 means none, otherwise scores of at least it are returned. sent_bytes: vectors of questions beyond it are not sent to all tasks;
    0 for questions that grow with the store.
    """
    k = top_k or default_k
    kept = [c for c in store.columns if c != "vector"]
    store = store.withColumn("_row", F.xxhash64(*kept))
    small = False
    if sent_bytes:
        questions = questions.select("question_id", "vector").persist()  # counted, then fetched: computed once
        n, dimension = questions.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
        small = n * (dimension * 8 + 64) <= sent_bytes and n * k <= HELD_HITS
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "source", "index", "_row")
    rank = F.row_number().over(order)
    if small:
        try:
            found = scored(store, questions, dimension, k, threshold)
        finally:
            questions.unpersist()
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("question_id", "rank", "score", *kept)
    if sent_bytes:
        questions.unpersist()
    best = met(store, questions, k, threshold).withColumn("rank", rank).where(F.col("rank") <= k)
    more = [c for c in kept if c not in ("source", "index")]
    if not more:
        return best.select("question_id", "rank", "score", *kept)
    # Each of the hits has its rank; rows of the store that are equal in all columns would come to it several times.
    best = best.select("question_id", "rank", "score", F.col("source").alias("_source"), F.col("index").alias("_index"), F.col("_row").alias("_hit"))
    few = sent_bytes and n * k * HIT <= HIT_BYTES
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("index").eqNullSafe(F.col("_index")) & (F.col("_row") == F.col("_hit"))
    joined = store.drop("vector").join(F.broadcast(best) if few else best, same)
    return joined.dropDuplicates(["question_id", "rank"]).select("question_id", "rank", "score", *kept)


def scored(store: DataFrame, questions: DataFrame, dimension: int, k: int, threshold: float | None) -> DataFrame:
    """question_id, score and the columns of store but vector: the best of each task. questions: few."""
    asked = questions.toPandas()
    sent = store.sparkSession.sparkContext.broadcast((asked["question_id"].tolist(), unit(matrix(asked["vector"], dimension))))
    kept = [f for f in store.schema.fields if f.name != "vector"]

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = sent.value
        if not ids:
            return
        held: pd.DataFrame | None = None  # the rows that some question ranks
        best, n = np.full((len(ids), k), NONE), 1
        for part in parts:
            before = 0 if held is None else len(held)
            x = unit(matrix(part["vector"], dimension))
            part = part.drop(columns="vector").reset_index(drop=True)
            rows = part if held is None else pd.concat([held, part], ignore_index=True)
            order = tie_order(rows)
            place = np.empty(len(order), "i8")
            place[order] = np.arange(len(order))
            # Numbers of the rows held, whose places were their own order before.
            again = np.where(best == NONE, NONE, best // n * len(rows) + len(rows) - 1 - place[np.where(best == NONE, 0, n - 1 - best % n)])
            best = improved(again, q, x, place[before:], len(rows))
            used = np.unique(decoded(best, len(rows))[2])
            moved = np.zeros(len(rows), "i8")
            moved[used] = np.arange(len(used))
            best = np.where(best == NONE, NONE, best // len(rows) * max(1, len(used)) + len(used) - 1 - moved[np.where(best == NONE, 0, len(rows) - 1 - best % len(rows))])
            held, n = rows.iloc[order[used]].reset_index(drop=True), max(1, len(used))
        some = max(1, SENT_ROWS // k)
        for low in range(0, len(ids) if held is not None else 0, some):
            question, steps, place = decoded(best[low : low + some], n)
            out = held.iloc[place].reset_index(drop=True)
            out.insert(0, "score", steps / STEPS)
            out.insert(0, "question_id", pd.Series([ids[low + i] for i in question.tolist()], dtype=object))
            yield out if not threshold else out[out["score"] >= threshold]

    return store.mapInPandas(score, T.StructType([questions.schema["question_id"], T.StructField("score", T.DoubleType()), *kept]))


def packed(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows in blocks, one for each Arrow batch: n, dim, vectors (as bytes; a null vector as zeros) and an array of each named column. Kept in a checkpoint."""
    rows = rows.select("vector", *names)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(0).to_pylist()
            dim = max((len(v) for v in vectors if v is not None), default=0)
            columns = [pa.array([batch.num_rows], pa.int32()), pa.array([dim], pa.int32()), pa.array([matrix(vectors, dim).tobytes()], pa.binary())]
            columns += [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(i)) for i in range(1, batch.num_columns)]
            yield pa.record_batch(columns, ["n", "dim", "vectors", *names])

    schema = T.StructType([*T.StructType.fromDDL("n int, dim int, vectors binary").fields, *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in rows.schema.fields[1:]]])
    shared_folder(rows.sparkSession)
    return rows.mapInArrow(block, schema).checkpoint()


def dealt(blocks: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Blocks with a number of their group, and how many groups of about `most` bytes there are."""
    size = blocks.agg(F.coalesce(F.sum(F.octet_length("vectors")), F.lit(0))).first()[0]
    groups = max(1, math.ceil(size / most))
    return blocks.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")), groups


def met(store: DataFrame, questions: DataFrame, k: int, threshold: float | None) -> DataFrame:
    """question_id, score, source, index and _row: the best of each group of blocks of the store, for each block of questions.

    A stated set of questions against all rows: the vectors of the store are shuffled once for each block of questions.
    """
    rows, groups = dealt(packed(store, ["source", "index", "_row"]), GROUP_BYTES)
    asked, blocks = dealt(packed(questions, ["question_id"]), BLOCK_BYTES)
    left = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumnRenamed("group", "block").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def vectors(found: pd.DataFrame, dim: int) -> np.ndarray:
        x = np.zeros((found["n"].sum(), dim))
        at = 0
        for n, own, raw in zip(found["n"], found["dim"], found["vectors"], strict=True):
            x[at : at + n, :own] = np.frombuffer(raw, "f8").reshape(n, own)
            at += n
        return unit(x)

    def tile(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        names = ["question_id", "score", "source", "index", "_row"]
        if not len(here) or not len(there):
            return pd.DataFrame(columns=names)
        dim = int(max(here["dim"].max(), there["dim"].max()))
        keys = pd.DataFrame({c: np.concatenate([np.asarray(v, object) for v in here[c]]) for c in ("source", "index", "_row")})
        ids = np.concatenate([np.asarray(v, object) for v in there["question_id"]])
        order = tie_order(keys)
        best = improved(np.full((len(ids), k), NONE), vectors(there, dim), vectors(here, dim)[order], np.arange(len(order)), len(order))
        question, steps, place = decoded(best, len(order))
        out = keys.iloc[order[place]].reset_index(drop=True)
        out.insert(0, "score", steps / STEPS)
        out.insert(0, "question_id", ids[question])
        return out if not threshold else out[out["score"] >= threshold]

    kinds = {f.name: f for f in store.schema.fields}
    schema = T.StructType([questions.schema["question_id"], T.StructField("score", T.DoubleType()), *(T.StructField(c, kinds[c].dataType) for c in ("source", "index", "_row"))])
    return left.groupBy("group", "block").cogroup(right.groupBy("group", "block")).applyInPandas(tile, schema)
