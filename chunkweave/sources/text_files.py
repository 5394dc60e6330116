"""Text files and JSON lines as DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.functions import text as X
from chunkweave.sources.files import Files
from chunkweave.sources.folder import TextFolder, opened, readable

Loader = Callable[[SparkSession, list[str]], DataFrame]


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def with_text(files: DataFrame, source: Column) -> DataFrame:
    """source, text, status and path from columns path and content. Invalid UTF-8 becomes U+FFFD; blank files have status 'empty'."""
    rows = files.select("path", source.alias("source"), X.newlines(F.expr("make_valid_utf8(cast(content as string))")).alias("text"))
    return rows.withColumn("status", F.when(X.is_blank(F.col("text")), "empty").otherwise("ok"))


def load_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    return with_text(spark.read.format("binaryFile").load(paths), basename(F.col("path")))


#: A loader for each suffix: the extension point for other formats.
LOADERS: dict[str, Loader] = {".txt": load_text}


def supported(name: str) -> bool:
    return any(name.lower().endswith(s) for s in LOADERS)


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """One file; a missing file, another suffix or a blank text is an error."""
    files = Files(spark, path)
    if not files.exists():
        raise FileNotFoundError(path)
    for suffix, loader in LOADERS.items():
        if path.lower().endswith(suffix):
            found = loader(spark, [path])
            if not found.where("status = 'ok'").head(1):
                raise ValueError(f"{path} is empty")
            return found
    raise ValueError(f"{path}: no loader for this suffix")


def folder_files(spark: SparkSession, folder: str, recursive: bool, names: bool = False) -> DataFrame:
    """path and content of every `*.txt`, listed and read by tasks; names: without contents."""
    spark.dataSource.register(TextFolder)
    options = {"recursive": str(recursive).lower(), "names": str(names).lower()}
    return spark.read.format("text_folder").options(**options).load(folder)


def scan_folder(spark: SparkSession, folder: str, recursive: bool = False, limit: int | None = None, relative: bool = False) -> DataFrame:
    """All `*.txt` of a folder: source, text, status, path. limit: the first so many by path.

    source is the base name, so files of the same name in several folders share it; relative=True takes the path under
    the folder instead. Where only Spark's own readers reach the folder, files without bytes and hidden ones are left out.
    """
    files = Files(spark, folder)
    if not files.is_folder():
        raise NotADirectoryError(folder)
    if readable(folder):
        rows, root = folder_files(spark, folder, recursive), opened(folder)[1]
    else:
        rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", str(recursive).lower()).load(folder)
        root = files.fs.getFileStatus(files.root).getPath().toString()
    if limit is not None:
        rows = rows.join(rows.select("path").orderBy("path").limit(limit), "path", "left_semi")
    under = F.lit(root.rstrip("/") + "/")
    return with_text(rows, F.replace(F.col("path"), under, F.lit("")) if relative else basename(F.col("path")))


def listed(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """source of every `*.txt`, blank ones included, without reading them where tasks can list the folder."""
    if readable(folder):
        return folder_files(spark, folder, recursive, names=True).select(basename(F.col("path")).alias("source")).distinct()
    return scan_folder(spark, folder, recursive).select("source").distinct()


def load_stats(documents: DataFrame) -> DataFrame:
    return documents.select("source", F.length("text").alias("n_chars"), X.n_lines(F.col("text")).alias("n_lines"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """question_id and question of JSON lines. Blank lines are skipped; a broken line is an error."""
    return spark.read.schema("question_id string, question string").option("mode", "FAILFAST").json(path)


def answered(spark: SparkSession, path: str) -> DataFrame:
    """question_id of answers written before. A missing path gives none; broken lines and lines without id are skipped."""
    if not Files(spark, path).exists():
        return spark.createDataFrame([], "question_id string")
    rows = spark.read.schema("question_id string, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record is null and question_id is not null").select("question_id").distinct()


def pending(asked: DataFrame, done: DataFrame, limit: int | None = None, order: str = "question_id") -> DataFrame:
    """Questions that are not done; of these, not of all, the first `limit`."""
    rest = asked.join(done, "question_id", "left_anti")
    return rest if limit is None else rest.orderBy(order).limit(limit)


def commit_answers(answers: DataFrame, path: str) -> None:
    """One more file of answers in a folder, with the next free number: all of them or none, and FileExistsError if another writer took it meanwhile.

    The numbered files are the log of what is done: a batch that died before its file had a name left only a hidden folder.
    """
    files, work = Files(answers.sparkSession, path), f"_work-{uuid.uuid4().hex}"
    number = 1 + max([int(n[8:-5]) for n in files.children(".") if n.startswith("answers-")], default=0)
    try:
        answers.coalesce(1).write.option("ignoreNullFields", "false").json(f"{path}/{work}")
        for part in [n for n in files.children(work) if n.startswith("part-")]:
            files.move(f"{work}/{part}", f"answers-{number:06d}.json")
    finally:
        files.remove(work)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)
