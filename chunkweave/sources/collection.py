"""A collection of chunks with vectors: immutable runs of Parquet files, deletion vectors, and numbered manifests that name the current ones.

A change writes a run of its own rows, in order of their ids, and marks the earlier rows that it replaces or deletes: one bit for a row, in bitmaps by file. So it
writes in proportion to itself, and readers leave marked rows out. Beside its rows each run has two small tables: `files`, with
the rows and the range of ids of each file, and `places`, with the file and row of each source and index, in their order. With these a change finds the rows that it
marks, a count reads no rows at all, and a page reads the one or two files whose ranges it needs. `compact` writes all rows into one run.

A change becomes visible by the creation of the next manifest, whose name no two writers can take. The one that comes second finds its marks
anew for what the first has added, and takes the name after; so both succeed, the later one last. A job that dies at any point changes nothing, nothing
is written over what is being read, and the last `KEPT` manifests with their files stay for readers still at work. What no kept manifest names
is removed once it is older than `GRACE`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkweave.functions import text as X
from chunkweave.sources.files import Files

POINT = "id string, vector array<double>, source string, index int, text string, line_start int, line_end int"
NAMES = [field.split()[0] for field in POINT.split(", ")]
FILES = "file string, rows long, id_min string, id_max string"
PLACES = "source string, index int, file string, row long"
DELETED = "file string, bucket long, bits binary"
#: Manifests that stay, seconds that unnamed files stay, and attempts to publish a change.
KEPT, GRACE, ATTEMPTS = 2, 3600.0, 20
#: Bytes of deletion vectors and of sources that are sent to all tasks; beyond that they are joined by a shuffle.
SENT_BYTES = 64 << 20
VECTOR_BYTES, SOURCE_BYTES = 4096 + 128, 256


def points(chunks: DataFrame) -> DataFrame:
    """Add the id, which depends on source and index alone."""
    return chunks.withColumn("id", X.point_id(F.col("source"), F.col("index")))


def with_defaults(rows: DataFrame) -> DataFrame:
    """Missing fields of stored rows: a fixed name for the source, empty text, line 0."""
    default = {"source": F.lit("inconnu"), "index": F.lit(0), "text": F.lit(""), "line_start": F.lit(0), "line_end": F.lit(0)}
    return rows.withColumns({c: F.coalesce(c, v) for c, v in default.items() if c in rows.columns})


def last_of(rows: DataFrame, *order: str) -> DataFrame:
    """Of rows with the same id the last one by the given columns."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def sources_of(rows: DataFrame) -> DataFrame:
    return rows.where("source <> ''").select("source").distinct()


def bit(bits: Column, row: Column) -> Column:
    """Whether a row (from 0) is marked in the bitmap of its bucket."""
    at = F.bitmap_bit_position(row + 1)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False))


class Collection:
    """A named collection under a root folder. Opening it creates it, or checks that the dimension is the same."""

    def __init__(self, spark: SparkSession, root: str, dimension: int) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)
        if not self.version():
            self.files.fs.mkdirs(self.files.root)
            try:
                self._publish(0, {"dimension": dimension, "metric": "cosine", "runs": [], "deletes": []})
            except FileExistsError:  # another process created it just now
                pass
        held = self.manifest()["dimension"]
        if held != dimension:
            raise ValueError(f"{root} holds vectors of {held} components, not {dimension}")
        self.dimension = dimension

    def version(self) -> int:
        """The number of the last manifest; 0 before the first."""
        return max(self._numbers(), default=0)

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.children("manifests") if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        return json.loads(self.files.read(f"manifests/{version or self.version()}.json"))

    def _publish(self, version: int, manifest: dict) -> None:
        self.files.fs.mkdirs(self.files.under("manifests"))
        self.files.create(f"manifests/{version + 1}.json", json.dumps(manifest))
        self._expire()

    def _commit(self, change: Callable[[dict], dict | None]) -> None:
        """Publish what change makes of the current manifest; if another writer was first, of the one that came of it."""
        for _ in range(ATTEMPTS):
            version = self.version()
            new = change(self.manifest(version))
            if new is None:
                return
            try:
                self._publish(version, new)
                return
            except FileExistsError:
                continue
        raise FileExistsError(f"{self.root}: {ATTEMPTS} changes of others came first")

    def _expire(self) -> None:
        """Remove manifests but the last KEPT, and folders that none of these names and that are older than GRACE."""
        numbers = self._numbers()
        kept = [self.manifest(n) for n in numbers[-KEPT:]]
        used = {run for m in kept for run in (*m["runs"], *m["deletes"])}
        used |= {run for m in kept if "index" in m for run in (m["index"]["model"], *m["index"]["runs"].values(), *(f"{i}-rings" for i in m["index"]["runs"].values()))}
        for n in numbers[:-KEPT]:
            self.files.remove(f"manifests/{n}.json")
        for kind in ("data", "files", "places", "deletes", "index"):
            for run in self.files.children(kind):
                if run not in used and self.files.age(f"{kind}/{run}") >= GRACE:
                    self.files.remove(f"{kind}/{run}")

    def _table(self, kind: str, runs: list[str], schema: str) -> DataFrame:
        paths = [f"{self.root}/{kind}/{run}" for run in runs]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _deleted(self, manifest: dict) -> DataFrame:
        """One deletion vector for each file and bucket of rows that has marks."""
        vectors = self._table("deletes", manifest["deletes"], DELETED)
        return vectors.groupBy("file", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    def _live(self, rows: DataFrame, manifest: dict) -> DataFrame:
        """Rows (with columns file and row) that are not marked."""
        if not manifest["deletes"]:
            return rows
        vectors = self._deleted(manifest).select(F.col("file").alias("_file"), F.col("bucket").alias("_bucket"), "bits")
        small = self._table("deletes", manifest["deletes"], DELETED).count() * VECTOR_BYTES <= SENT_BYTES
        here = (F.col("file") == F.col("_file")) & (F.bitmap_bucket_number(F.col("row") + 1) == F.col("_bucket"))
        joined = rows.join(F.broadcast(vectors) if small else vectors, here, "left")
        return joined.where(~bit(F.col("bits"), F.col("row"))).select(*rows.columns)

    def _placed(self, runs: list[str], paths: list[str] | None = None) -> DataFrame:
        paths = [f"{self.root}/data/{run}" for run in runs] if paths is None else paths
        where = (F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
        if not paths:
            return self.spark.createDataFrame([], POINT + ", file string, row long")
        return self.spark.read.schema(POINT).parquet(*paths).select(*NAMES, *where)

    def _write(self, rows: DataFrame, version: int) -> tuple[str, int]:
        """A run of these rows, with its tables; its name and number of rows."""
        run = f"{version}-{uuid.uuid4().hex}"
        rows.select(*NAMES).repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{self.root}/data/{run}")
        written = self._placed([run]).select("id", "source", "index", "file", "row")
        written.select("source", "index", "file", "row").repartitionByRange("source", "index").sortWithinPartitions("source", "index").write.parquet(f"{self.root}/places/{run}")
        written.groupBy("file").agg(F.count("*").alias("rows"), F.min("id").alias("id_min"), F.max("id").alias("id_max")).coalesce(1).write.parquet(f"{self.root}/files/{run}")
        return run, self._table("files", [run], FILES).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def _mark(self, manifest: dict, places: DataFrame) -> list[str]:
        """Deletion vectors of these places (file, row), as the manifest's list with one run more, or the list as it is if there are none."""
        run, at = uuid.uuid4().hex, F.col("row") + 1
        places.groupBy("file", F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).write.parquet(f"{self.root}/deletes/{run}")
        return [*manifest["deletes"], run] if self._table("deletes", [run], DELETED).head(1) else manifest["deletes"]

    def rows(self, manifest: dict | None = None) -> DataFrame:
        manifest = manifest or self.manifest()
        return self._live(self._placed(manifest["runs"]), manifest).select(*NAMES)

    def rows_from(self, sources: list[str]) -> DataFrame:
        """The rows of some sources. The index by source names their files; no other one is read."""
        manifest = self.manifest()
        wanted = F.col("source").isin(sources)
        held = self._live(self._table("places", manifest["runs"], PLACES).where(wanted), manifest)
        files = {r.file for r in held.select("file").distinct().collect()}  # names of files, of a stated list of sources
        return self._live(self._placed([], self._paths(files, manifest)), manifest).select(*NAMES).where(wanted)

    def _paths(self, names: set[str], manifest: dict) -> list[str]:
        return [f"{self.root}/data/{run}/{name}" for run in manifest["runs"] for name in self.files.children(f"data/{run}") if name in names] if names else []

    def add(self, chunks: DataFrame, order: str | None = None, replace_sources: bool = False) -> int:
        """Insert or replace chunks with vectors; returns how many rows were given ids.

        Rows with the same id: the last by `order`, and among equals by their text. Chunks of a document that became shorter stay, unless
        replace_sources drops all earlier chunks of the given sources.
        """
        wrong = F.raise_error(F.lit(f"a vector does not have {self.dimension} components"))
        vector = F.when(F.size("vector") == self.dimension, F.transform("vector", lambda x: x.cast("double"))).otherwise(wrong)
        new = last_of(points(chunks).withColumn("vector", vector), *([order] if order else []), "text").select(*NAMES).persist()
        try:
            run, n = self._write(new, self.version())
        finally:
            new.unpersist()
        if not n:
            return 0
        keys = ["source"] if replace_sources else ["source", "index"]
        own = self._table("places", [run], PLACES).select(*keys).distinct()
        small = n * SOURCE_BYTES <= SENT_BYTES

        def change(manifest: dict) -> dict:
            if not manifest["runs"]:
                return manifest | {"runs": [run]}
            same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
            asked = own.toDF(*[f"_{k}" for k in keys])
            old = self._live(self._table("places", manifest["runs"], PLACES), manifest).join(F.broadcast(asked) if small else asked, same, "left_semi")
            return manifest | {"deletes": self._mark(manifest, old), "runs": [*manifest["runs"], run]}

        self._commit(change)
        return n

    def delete_source(self, source: str) -> None:
        """Marks the rows of one source: the index by source finds them, and nothing else is read or written."""

        def change(manifest: dict) -> dict | None:
            found = self._live(self._table("places", manifest["runs"], PLACES).where(F.col("source").eqNullSafe(source)), manifest)
            deletes = self._mark(manifest, found)
            return None if deletes == manifest["deletes"] else manifest | {"deletes": deletes}

        self._commit(change)

    def compact(self) -> None:
        """All rows in one run and no marks: a job of its own, for a store of many small changes. Changes of others that come first start it again."""

        def change(manifest: dict) -> dict | None:
            if len(manifest["runs"]) < 2 and not manifest["deletes"]:
                return None
            run, n = self._write(self.rows(manifest), self.version())
            return manifest | {"runs": [run] if n else [], "deletes": []}

        self._commit(change)

    def reset(self) -> None:
        self._commit(lambda manifest: manifest | {"runs": [], "deletes": []})

    def drop(self) -> None:
        self.files.remove()

    def count(self) -> int:
        """From the tables of files and marks alone."""
        manifest = self.manifest()
        held = self._table("files", manifest["runs"], FILES).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        gone = self._deleted(manifest).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))).first()[0]
        return held - gone if manifest["deletes"] else held

    def sources(self) -> DataFrame:
        """Distinct sources, from the index by source."""
        manifest = self.manifest()
        return sources_of(self._live(self._table("places", manifest["runs"], PLACES), manifest)).orderBy("source")

    def page_files(self, after: str = "", size: int = 256, manifest: dict | None = None) -> list[str]:
        """Paths of the files that hold the next rows by id: those whose range begins before the end of as many whole files as have `size` live rows."""
        manifest = manifest or self.manifest()
        files = self._table("files", manifest["runs"], FILES).where(F.col("id_max") > after)
        gone = self._deleted(manifest).groupBy("file").agg(F.sum(F.bitmap_count("bits")).alias("gone"))
        files = files.join(gone, "file", "left").withColumn("live", F.when(F.col("id_min") > after, F.col("rows") - F.coalesce("gone", F.lit(0))).otherwise(0))
        # One small row a file; only those up to the end that is looked for come to the driver.
        reached, end = 0, None
        for f in files.orderBy("id_max").select("id_max", "live").toLocalIterator():
            reached, end = reached + f.live, f.id_max
            if reached >= size:
                break
        names = {r.file for r in files.where(F.col("id_min") <= (end or "")).select("file").collect()}
        return self._paths(names, manifest)

    def page(self, after: str = "", size: int = 256) -> DataFrame:
        """The next rows by id, for listings, from the few files that hold them."""
        manifest = self.manifest()
        found = self._live(self._placed([], self.page_files(after, size, manifest)), manifest)
        return found.select(*NAMES).where(F.col("id") > after).orderBy("id").limit(size)
