"""An approximate index that is kept with a collection: an inverted file of coarse cells with product-quantised residuals.

Cells and codes are fitted on a bounded sample (`SAMPLE` vectors, chosen by hash); every row is indexed. Each run of the collection has a run of the index
beside it, in folders by cell: file and row of each vector, its code, and its unit vector. A search of few questions reads the codes of the probed cells alone, adds up
tables of inner products to approximate scores, and fetches the vectors of a short list for exact ones. Many questions would fetch more than the cells
hold: they stay in blocks, which meet the vectors of the probed cells in groups, each pair in a task of its own, and these are scored exactly at once. Rows that the
collection has marked as deleted fall out by its deletion vectors, and runs that are not indexed yet are searched exactly, so the index may lag behind.

How many cells to probe is measured: `tuned` takes the fewest with which a bounded sample of stored vectors, as questions, finds the asked share of its exact best.
Cells that hold many rows, or that many questions probe, are dealt to several tasks. Questions stay distributed.

The index also answers exactly, where a score is asked for: each row has its angle from its cell's center, in the order of which the files are sorted, and each
cell the least and greatest of them. By the triangle inequality a row within angle t of a question lies in the ring of angles a - t to a + t, where
a is the question's own angle from the center. Cells without such a ring are not read, nor are the vectors of rows outside it moved.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkweave.operators.batches import slices
from chunkweave.operators.search import STEPS, matrix, search, unit
from chunkweave.sources.collection import PLACES, Collection

#: Vectors that cells and codes are fitted on, and vectors that `tuned` asks for.
SAMPLE, ASKED = 65_536, 200
#: Cells at most, components in a part of a code, and entries of a part's book.
CELLS, PART, BOOK = 4096, 4, 256
#: Rows and questions that a task takes at most, bytes of their vectors, and scores that are worked out at once.
ROWS, QUESTIONS, TILE = 200_000, 20_000, 1 << 20
ROW_BYTES, QUESTION_BYTES = 32 << 20, 16 << 20
#: Hits that a task holds before those that have fallen behind are left out.
HELD = 1 << 20
NONE = np.iinfo("i8").min
#: Hits of a short list for each of the asked ones, and bytes of short lists that go to all tasks.
SHORT, SENT_BYTES = 12, 32 << 20
INDEX = "file string, row long, code binary, unit array<double>, angle double, cell int"
RINGS = "cell int, least double, most double"
#: What the last digit of a score may hide.
SLACK = 1 / STEPS


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    r = np.random.default_rng(seed)
    centers = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centers))
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers * centers).sum(axis=1) / 2
    return np.concatenate([(part @ centers.T - half).argmax(axis=1) for part in np.array_split(x, len(x) * len(centers) // TILE + 1)]) if len(x) else np.empty(0, "i8")


class Model:
    """Coarse centers, and a book of entries for each PART components of what is left."""

    def __init__(self, centers: np.ndarray, books: list[np.ndarray]) -> None:
        self.centers, self.books = centers, books

    @staticmethod
    def fitted(x: np.ndarray, cells: int) -> Model:
        centers = kmeans(x, cells)
        rest = x - centers[nearest(x, centers)]
        return Model(centers, [kmeans(rest[:, at : at + PART], BOOK) for at in range(0, x.shape[1], PART)])

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code of each row."""
        cell = nearest(x, self.centers)
        rest = x - self.centers[cell]
        parts = [nearest(rest[:, i * PART : (i + 1) * PART], book) for i, book in enumerate(self.books)]
        return cell, np.stack(parts, axis=1).astype("u1")

    def probed(self, q: np.ndarray, probes: int) -> np.ndarray:
        """The cells nearest to each question, the nearest first."""
        half = (self.centers * self.centers).sum(axis=1) / 2
        return np.argsort(half - q @ self.centers.T, axis=1, kind="stable")[:, :probes]

    def angles(self, x: np.ndarray) -> np.ndarray:
        """Angles between unit rows and the direction of each center; a right one for zeros."""
        return np.arccos(np.clip(x @ unit(self.centers).T, -1, 1))

    def approximate(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of questions and the rows of one cell, as far as their codes tell."""
        out = np.repeat((q @ self.centers[cell])[:, None], len(codes), axis=1)
        for i, book in enumerate(self.books):
            out += (q[:, i * PART : (i + 1) * PART] @ book.T)[:, codes[:, i]]
        return out


def rings_of(run: str) -> str:
    """The name of the table with the rings of a run of the index."""
    return f"{run}-rings"


def dealt(rows: DataFrame, asked: DataFrame, blocks: int, kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows and questions (with a cell each) that meet by cell, part and block: parts of ROWS rows of a cell, blocks of questions. Each cell has one small row of counts."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / ROWS).alias("parts"))
    left = rows.select(*kept).join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("file", "row"), "parts")).drop("parts")
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.join(F.broadcast(sizes), "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return left, right.withColumn("block", F.pmod(F.xxhash64("question_id"), F.lit(blocks)).cast("int"))


def taken(q: np.ndarray, cells: int, takes: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Which cells each question takes, by the tile; and the first question of the tile."""
    some = max(1, TILE // cells)
    for at in range(0, len(q), some):
        yield at, takes(q[at : at + some])


def met(rows_of: Callable[[list[int]], DataFrame], questions: DataFrame, dimension: int, model: Broadcast, takes: Callable[[Model, np.ndarray], np.ndarray], k: int, least: int) -> DataFrame:
    """question_id, file, row and score: each question's k best rows of each group, ties included, of the cells it takes, with at least `least` steps.

    rows_of: the rows of some cells, for which only the folders of these are read.

    Whole cells share a group, large ones are dealt to several, one small row a cell. Rows travel packed, once for each block of questions that takes a
    cell of their group, and questions once for each such group, so neither is repeated by cell.
    """
    spark, kind = questions.sparkSession, questions.schema["question_id"].dataType
    most, own = (max(1, min(n, size // (8 * dimension))) for n, size in ((ROWS, ROW_BYTES), (QUESTIONS, QUESTION_BYTES)))
    blocks = max(1, math.ceil(questions.count() / own))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            q = unit(matrix(batch.column(1).to_pylist(), dimension))
            cells = np.zeros(len(model.value.centers), bool)
            for _, chosen in taken(q, len(cells), partial(takes, model.value)):
                cells |= chosen.any(axis=0)
            ids = pa.ListArray.from_arrays(pa.array([0, len(q)], pa.int32()), batch.column(0))
            block = pa.array([TaskContext.get().partitionId()], pa.int32())
            yield pa.record_batch([block, ids, pa.array([q.tobytes()], pa.binary()), pa.array([np.flatnonzero(cells).tolist()], pa.list_(pa.int32()))], ["block", "ids", "q", "cells"])

    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), *T.StructType.fromDDL("q binary, cells array<int>").fields])
    asked = questions.select("question_id", "vector").repartition(blocks).mapInArrow(packed, schema).checkpoint()
    wanted = asked.select("block", F.explode("cells").alias("cell")).distinct()
    rows = rows_of(sorted(r.cell for r in wanted.select("cell").distinct().collect()))  # at most CELLS rows, as of the counts
    sizes = rows.groupBy("cell").count().orderBy("cell").collect()
    dealt, group, held = [], 0, 0
    for cell, n in sizes:
        if held and held + n > most:
            group, held = group + 1, 0
        parts = math.ceil(n / most)
        dealt.append((cell, group, parts))
        group, held = (group + parts, 0) if parts > 1 else (group, held + n)
    plan = spark.createDataFrame(dealt, "cell int, first int, parts int")
    pairs = wanted.join(F.broadcast(plan), "cell").select("block", F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("group")).distinct()

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0).to_numpy()
            order = np.argsort(groups, kind="stable")
            x = batch.column(4).flatten().to_numpy().reshape(len(groups), dimension)
            cells = batch.column(1).to_numpy()
            for at in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1):
                if len(at):
                    listed = [pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), batch.column(i).take(pa.array(at))) for i in (2, 3)]
                    yield pa.record_batch([pa.array([groups[at[0]]], pa.int32()), pa.array([cells[at].astype("<i4").tobytes()], pa.binary()), pa.array([x[at].tobytes()], pa.binary()), *listed], ["group", "cells", "units", "files", "rows"])

    group = (F.col("first") + F.pmod(F.xxhash64("file", "row"), F.col("parts"))).cast("int").alias("group")
    left = rows.join(F.broadcast(plan), "cell").select(group, "cell", "file", "row", "unit").mapInArrow(together, "group int, cells binary, units binary, files array<string>, rows array<long>")
    left = left.join(F.broadcast(pairs.withColumnRenamed("block", "_block")), "group").withColumnRenamed("_block", "block")
    right = asked.select("block", "ids", "q").join(F.broadcast(pairs), "block")

    def compared(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(here) or not len(there):
            return pd.DataFrame(columns=["question_id", "file", "row", "score"])
        cells = np.frombuffer(b"".join(here["cells"]), "<i4")
        x = np.frombuffer(b"".join(here["units"]), "f8").reshape(-1, dimension)
        q = np.frombuffer(b"".join(there["q"]), "f8").reshape(-1, dimension)
        found = np.unique(cells)
        chosen = np.concatenate([c[:, found] for _, c in taken(q, len(model.value.centers), partial(takes, model.value))])
        best = np.full((len(q), k), NONE)
        hits: list[np.ndarray] = []
        held, most = 0, HELD

        def kept() -> np.ndarray:
            """Hits (question, row, steps) that no k better ones of the group have passed; names decide among ties later."""
            every = np.concatenate([np.empty((3, 0), "i8"), *hits], axis=1)
            return every[:, every[2] >= best.min(axis=1)[every[0]]]

        for j, cell in enumerate(found.tolist()):
            row, ask = np.flatnonzero(cells == cell), np.flatnonzero(chosen[:, j])
            for low in range(0, len(row), TILE // 16):
                at = row[low : low + TILE // 16]
                some = max(1, TILE // (len(at) + k))
                for part in (ask[i : i + some] for i in range(0, len(ask), some)):
                    steps = np.rint(q[part] @ x[at].T * STEPS).astype("i8")
                    both = np.concatenate((best[part], np.where(steps >= least, steps, NONE)), axis=1)
                    best[part] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
                    a, b = np.nonzero(steps >= np.maximum(best[part].min(axis=1), least)[:, None])
                    hits.append(np.stack([part[a], at[b], steps[a, b]]))
                    held += len(a)
                    if held > most:
                        hits[:] = [kept()]
                        held = hits[0].shape[1]
                        most = max(HELD, 2 * held)
        question, place, steps = kept()
        ids = np.concatenate([np.asarray(v, object) for v in there["ids"]])
        files, numbers = (np.concatenate([np.asarray(v) for v in here[c]]) for c in ("files", "rows"))
        return pd.DataFrame({"question_id": ids[question], "file": files[place], "row": numbers[place], "score": steps / STEPS})

    schema = T.StructType([questions.schema["question_id"], *T.StructType.fromDDL("file string, row long, score double").fields])
    return left.groupBy("group", "block").cogroup(right.groupBy("group", "block")).applyInPandas(compared, schema)


class VectorIndex:
    """The index of a collection. Opening it makes nothing; `build` fits it, if it has not been, and indexes the runs that lack it."""

    def __init__(self, collection: Collection) -> None:
        self.collection, self.spark = collection, collection.spark

    def model(self, manifest: dict) -> Model:
        raw = self.spark.read.parquet(f"{self.collection.root}/index/{manifest['index']['model']}").first()
        return Model(np.array(raw.centers), [np.array(b) for b in raw.books])

    def build(self, cells: int | None = None) -> None:
        store = self.collection
        manifest = store.manifest()
        name = manifest.get("index", {}).get("model")
        if name is None:
            n = store.count()
            if not n:
                return
            sample = store.rows().select("vector").orderBy(F.xxhash64("id")).limit(SAMPLE).toPandas()["vector"]
            fitted = Model.fitted(unit(matrix(sample, store.dimension)), cells or min(CELLS, max(1, math.isqrt(n))))
            name = f"model-{uuid.uuid4().hex}"
            row = (fitted.centers.tolist(), [b.tolist() for b in fitted.books])
            self.spark.createDataFrame([row], "centers array<array<double>>, books array<array<array<double>>>").write.parquet(f"{store.root}/index/{name}")
            self._publish(name, {})
        model = self.spark.sparkContext.broadcast(self.model(store.manifest()))
        dimension = store.dimension

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = unit(matrix(batch.column(0).to_pylist(), dimension))
                cell, code = model.value.coded(x)
                angle = np.arccos(np.clip((x * unit(model.value.centers)[cell]).sum(axis=1), -1, 1))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype="i4") * dimension), pa.array(x.ravel()))
                yield pa.record_batch([batch.column(1), batch.column(2), pa.array([c.tobytes() for c in code], pa.binary()), vectors, pa.array(angle), pa.array(cell.astype("i4"))], ["file", "row", "code", "unit", "angle", "cell"])

        made = {}
        for run in [r for r in store.manifest()["runs"] if r not in store.manifest()["index"]["runs"]]:
            rows = store._placed([run]).select("vector", "file", "row").mapInArrow(coded, INDEX)
            # A large cell is written by several tasks.
            spread = F.pmod(F.xxhash64("file", "row"), F.lit(8))
            made[run] = f"{run}-{uuid.uuid4().hex}"
            rows.repartition("cell", spread).sortWithinPartitions("cell", "angle").write.partitionBy("cell").parquet(f"{store.root}/index/{made[run]}")
            written = self.spark.read.schema(INDEX).parquet(f"{store.root}/index/{made[run]}").groupBy("cell").agg(F.min("angle").alias("least"), F.max("angle").alias("most"))
            written.coalesce(1).write.parquet(f"{store.root}/index/{rings_of(made[run])}")
        self._publish(name, made)

    def _publish(self, name: str, made: dict[str, str]) -> None:
        def change(manifest: dict) -> dict | None:
            held = manifest.get("index", {"model": name, "runs": {}, "probes": None})
            if held["model"] != name:
                raise ValueError("another writer fitted an index at the same time")
            return manifest | {"index": held | {"runs": {r: i for r, i in (held["runs"] | made).items() if r in manifest["runs"]}}}

        self.collection._commit(change)

    def tuned(self, k: int = 20, recall: float = 0.95) -> int:
        """The fewest probes with which ASKED stored vectors, as questions, find this share of their exact best; kept with the index."""
        store = self.collection
        asked = store.rows().select("id", "vector").orderBy(F.xxhash64("id", F.lit(1))).limit(ASKED)
        asked = asked.select(F.col("id").alias("question_id"), "vector")
        exact = search(store.rows().select("source", "index", "id", "vector"), asked, k).select("question_id", "id")
        manifest = store.manifest()
        model = self.model(manifest)
        ids = asked.toPandas()
        order = dict(zip(ids["question_id"], model.probed(unit(matrix(ids["vector"], store.dimension)), len(model.centers)), strict=True))
        home = store._placed(manifest["runs"]).select("id", "file", "row").join(exact.select("id").distinct(), "id")
        home = home.join(self._codes(manifest, None).select("file", "row", "cell"), ["file", "row"]).select("id", "cell")
        hits = exact.join(home, "id").toPandas()  # at most ASKED * k rows
        turn = sorted(int(np.flatnonzero(order[h.question_id] == h.cell)[0]) for h in hits.itertuples())
        probes = turn[min(len(turn) - 1, math.ceil(recall * len(turn)) - 1)] + 1 if turn else 1
        store._commit(lambda m: m | {"index": m["index"] | {"probes": probes}})
        return probes

    def _codes(self, manifest: dict, cells: list[int] | None) -> DataFrame:
        """Rows of the index that are not deleted; only the folders of these cells are read."""
        found = None
        for run in [i for r, i in manifest["index"]["runs"].items() if r in manifest["runs"]]:
            each = self.spark.read.schema(INDEX).parquet(f"{self.collection.root}/index/{run}")
            found = each if found is None else found.unionByName(each)
        if found is None:
            found = self.spark.createDataFrame([], INDEX)
        if cells is not None:
            found = found.where(F.col("cell").isin(cells))
        return self.collection._live(found, manifest)

    def search(self, questions: DataFrame, top_k: int = 4, probes: int | None = None) -> DataFrame:
        """question_id, rank, score, source and index of about the k best rows of the collection, by exact scores.

        Missed are rows outside the probed cells and, with few questions, those that the codes leave out of the short list (SHORT * top_k rows a question and part of a cell).
        """
        store, manifest = self.collection, self.collection.manifest()
        if "index" not in manifest:
            return ranked(self._late(manifest, questions, top_k), top_k)
        held = manifest["index"]
        model = self.spark.sparkContext.broadcast(self.model(manifest))
        dimension, most = store.dimension, SHORT * top_k
        many = probes or held["probes"] or len(model.value.centers)
        kind = questions.schema["question_id"].dataType.simpleString()
        if questions.count() * most * (8 * dimension + 128) > SENT_BYTES:

            def nearest_cells(fitted: Model, q: np.ndarray) -> np.ndarray:
                out = np.zeros((len(q), len(fitted.centers)), bool)
                np.put_along_axis(out, fitted.probed(q, many), True, axis=1)
                return out

            found = met(partial(self._codes, manifest), questions, dimension, model, nearest_cells, top_k, NONE)
            return ranked(self._named(found, manifest, False).unionByName(self._late(manifest, questions, top_k)), top_k)

        def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                q = unit(matrix(part["vector"], dimension))
                yield pd.DataFrame({"question_id": part["question_id"], "q": list(q), "cells": [c.astype("i4") for c in model.value.probed(q, many)]})

        asked = questions.select("question_id", "vector").mapInPandas(ask, f"question_id {kind}, q array<double>, cells array<int>").checkpoint()
        n = asked.count()
        cells = sorted(r.cell for r in asked.select(F.explode("cells").alias("cell")).distinct().collect())  # at most CELLS
        codes = self._codes(manifest, cells)
        asking = asked.select("question_id", "q", F.explode("cells").alias("cell"))
        left, right = dealt(codes, asking, max(1, math.ceil(n / QUESTIONS)), ["cell", "file", "row", "code"])

        def short(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(here) and len(there):
                cell = int(here["cell"].iloc[0])
                code = np.frombuffer(b"".join(here["code"]), "u1").reshape(len(here), -1)
                q = np.array(there["q"].tolist())
                for at in range(0, len(q), max(1, TILE // len(code))):
                    near = model.value.approximate(q[at : at + max(1, TILE // len(code))], cell, code)
                    best = np.argpartition(-near, min(most, len(code)) - 1, axis=1)[:, :most]
                    row = best.ravel()
                    ask = np.repeat(np.arange(at, at + len(best)), best.shape[1])
                    out.append(pd.DataFrame({"question_id": there["question_id"].to_numpy()[ask], "cell": cell, "file": here["file"].to_numpy()[row], "row": here["row"].to_numpy()[row], "near": np.take_along_axis(near, best, 1).ravel()}))
            return pd.concat(out) if out else pd.DataFrame(columns=["question_id", "cell", "file", "row", "near"])

        listed = left.groupBy("cell", "part", "block").cogroup(right.groupBy("cell", "part", "block")).applyInPandas(short, f"question_id {kind}, cell int, file string, row long, near double")
        place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("near"), "file", "row"))
        listed = listed.withColumn("place", place).where(F.col("place") <= most).select("question_id", "cell", "file", "row").join(asked.select("question_id", "q"), "question_id").checkpoint()
        vectors = self._codes(manifest, cells).select("cell", "file", "row", "unit")
        scored = vectors.join(F.broadcast(listed), ["cell", "file", "row"])
        dot = F.aggregate(F.zip_with("q", "unit", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        order = Window.partitionBy("question_id").orderBy(F.desc("score"), "file", "row")
        best = scored.select("question_id", "file", "row", F.round(dot, 6).alias("score")).withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= 2 * top_k)
        best = self._named(best, manifest, True).unionByName(self._late(manifest, questions, top_k))
        return ranked(best, top_k)

    def _named(self, hits: DataFrame, manifest: dict, small: bool) -> DataFrame:
        """question_id, score, source and index of hits by file and row."""
        names = self.collection._table("places", [r for r in manifest["runs"] if r in manifest["index"]["runs"]], PLACES)
        return names.join(F.broadcast(hits) if small else hits, ["file", "row"]).select("question_id", "score", "source", "index")

    def _late(self, manifest: dict, questions: DataFrame, top_k: int, threshold: float | None = None) -> DataFrame:
        """The exact hits among rows that are not indexed yet."""
        store = self.collection
        rest = [r for r in manifest["runs"] if r not in manifest.get("index", {"runs": {}})["runs"]]
        kind = questions.schema["question_id"].dataType.simpleString()
        if not rest:
            return self.spark.createDataFrame([], f"question_id {kind}, score double, source string, index int")
        late = store._live(store._placed(rest), manifest).select("source", "index", "vector")
        return search(late, questions, top_k, threshold).select("question_id", "score", "source", "index")

    def _near(self, threshold: float, manifest: dict) -> tuple[Broadcast, Callable[[Model, np.ndarray], np.ndarray]]:
        """The model, and which cells have rows in the ring in which rows with a score of at least the threshold can lie, for some questions."""
        runs = [rings_of(i) for r, i in manifest["index"]["runs"].items() if r in manifest["runs"]]
        rings = self.collection._table("index", runs, RINGS).groupBy("cell").agg(F.min("least"), F.max("most")).collect()  # at most CELLS rows
        cell, least, most = np.array(rings, "f8").reshape(-1, 3).T
        reach = math.acos(max(-1.0, min(1.0, threshold - SLACK)))

        def near(fitted: Model, q: np.ndarray) -> np.ndarray:
            angle = fitted.angles(q)[:, cell.astype("i8")]
            out = np.zeros((len(q), len(fitted.centers)), bool)
            out[:, cell.astype("i8")] = (angle - reach <= most) & (angle + reach >= least)
            return out

        return self.spark.sparkContext.broadcast(self.model(manifest)), near

    def reached(self, questions: DataFrame, threshold: float, manifest: dict | None = None) -> DataFrame:
        """question_id and cell: the cells in which rows with a score of at least the threshold can lie."""
        model, near = self._near(threshold, manifest or self.collection.manifest())
        dimension = self.collection.dimension

        def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for at, chosen in taken(unit(matrix(part["vector"], dimension)), len(model.value.centers), partial(near, model.value)):
                    row, cell = np.nonzero(chosen)
                    yield pd.DataFrame({"question_id": part["question_id"].to_numpy()[at + row], "cell": cell.astype("i4")})

        kind = questions.schema["question_id"].dataType.simpleString()
        return questions.select("question_id", "vector").mapInPandas(cells, f"question_id {kind}, cell int")

    def within(self, questions: DataFrame, threshold: float, top_k: int = 4) -> DataFrame:
        """question_id, rank, score, source and index of the k best rows with a score of at least the threshold (above 0): the same as an exact search.

        Only folders of cells that some question reaches are read, and each question is compared with those of the cells that it reaches. Null vectors have no hits.
        """
        if not threshold > 0:
            raise ValueError("a threshold has to be above 0")
        manifest = self.collection.manifest()
        if "index" not in manifest:
            return ranked(self._late(manifest, questions, top_k, threshold), top_k)
        model, near = self._near(threshold, manifest)
        found = met(partial(self._codes, manifest), questions, self.collection.dimension, model, near, top_k, math.ceil(round(threshold * STEPS, 3)))
        return ranked(self._named(found, manifest, False).unionByName(self._late(manifest, questions, top_k, threshold)), top_k)


def ranked(hits: DataFrame, top_k: int) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "source", "index")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("question_id", "rank", "score", "source", "index")
