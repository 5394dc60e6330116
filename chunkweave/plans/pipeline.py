"""Ingest and ask: whole batches of documents or questions in one job each."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.functions import text as X
from chunkweave.operators import prompt
from chunkweave.operators.chunking import chunk
from chunkweave.operators.embedding import Embedder, HashedWords, complete_sources, embed
from chunkweave.operators.evaluate import candidates
from chunkweave.operators.remote import Pace
from chunkweave.operators.search import search
from chunkweave.settings import Settings
from chunkweave.sources import text_files
from chunkweave.sources.collection import Collection
from chunkweave.sources.files import Files


def report(names: DataFrame, chunks: DataFrame) -> DataFrame:
    """source and n_chunks for every name, 0 for those without chunks."""
    counts = chunks.groupBy("source").agg(F.count("*").alias("n_chunks"))
    return names.select("source").distinct().join(counts, "source", "left").select("source", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


class Pipeline:
    """Tables that a call computes once and reads again stay in memory or on disk until `release`, which every call of a command ends with."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, embedder: Embedder | None = None, generator: prompt.Generator | None = None, pace: Pace | None = None) -> None:
        self.spark, self.settings = spark, settings or Settings()
        self.embedder = embedder or HashedWords(self.settings.dimension)
        self.generator = generator or prompt.Echo()
        self.store = Collection(spark, f"{root.rstrip('/')}/{self.settings.collection}", self.embedder.dimension)
        self._held: list[DataFrame] = []
        self.pace = pace  # of a remote embedder and of a remote model

    def _once(self, rows: DataFrame) -> DataFrame:
        self._held.append(rows.persist())
        return rows

    def release(self) -> None:
        while self._held:
            self._held.pop().unpersist()

    def _embed(self, rows: DataFrame) -> DataFrame:
        return embed(rows, self.embedder, attempts=self.settings.attempts, base_delay=self.settings.base_delay, pace=self.pace)

    def ingest_documents(self, documents: DataFrame) -> DataFrame:
        """Chunk, embed and store documents (source, text, perhaps path); returns the stored chunks. The job fails as a whole if it cannot write.

        Where documents share a source, the last path wins, chunk by chunk.
        """
        order = [c for c in documents.columns if c == "path"]
        chunks = chunk(documents, self.settings.chunk_size, self.settings.chunk_overlap, tuple(order))
        stored = complete_sources(self._once(self._embed(chunks)))
        self.store.add(stored, *order)
        return stored

    def ingest_file(self, path: str) -> int:
        """Errors of the file are raised."""
        try:
            return self.ingest_documents(text_files.load_file(self.spark, path)).count()
        finally:
            self.release()

    def ingest_directory(self, folder: str, recursive: bool = False, resume: bool = False) -> DataFrame:
        """source and n_chunks for each file; blank and failed ones have 0. resume leaves out stored sources."""
        names = text_files.listed(self.spark, folder, recursive)
        found = text_files.scan_folder(self.spark, folder, recursive)
        if resume:
            done = self.store.sources()
            names, found = (x.join(done, "source", "left_anti") for x in (names, found))
            names = self._once(names)
            names.count()  # before the store changes
        return report(names, self.ingest_documents(found.where("status = 'ok'"))).orderBy("source")

    def hits(self, questions: DataFrame, top_k: int | None = None, sources: list[str] | None = None) -> DataFrame:
        """The best chunks for each question. sources: only chunks of these, read from the files that hold them."""
        asked = self._embed(questions.select("question_id", X.strip(F.col("question")).alias("text")))
        asked = asked.where("status = 'ok' and text <> ''").select("question_id", "vector")
        rows = self.store.rows() if sources is None else self.store.rows_from(sources)
        return search(rows.drop("id"), asked, top_k, self.settings.threshold, self.settings.top_k)

    def ask_many(self, questions: DataFrame, top_k: int | None = None) -> DataFrame:
        """question_id, question, text, sources, status, error. Blank questions have status 'empty'."""
        hits = self._once(self.hits(questions, top_k))
        rows = prompt.with_prompt(prompt.contexts(questions.where(~X.is_blank(F.col("question"))), hits))
        answered = prompt.answers(rows, self.generator, self.pace)
        blank = questions.where(X.is_blank(F.col("question"))).select("question_id", "question", F.lit("empty").alias("status"))
        return answered.unionByName(blank, allowMissingColumns=True)

    def ask(self, question: str, top_k: int | None = None) -> DataFrame:
        """One row, answered here and now: reading it again asks no model again."""
        if not question.strip():
            raise ValueError("the question is blank")
        one = self.spark.createDataFrame([("1", question.strip())], "question_id string, question string")
        try:
            answers = self.ask_many(one, top_k)
            return self.spark.createDataFrame(answers.collect(), answers.schema)
        finally:
            self.release()

    def bench(self, questions_path: str, output: str, top_k: int = 20, max_docs: int = 10, limit: int | None = None, resume: bool = False, english: bool = True, batch: int = 1000) -> int:
        """Answer the questions of a file and add question_id, answer and document_ids to a folder; returns how many.

        Questions are answered in batches of about `batch`, one search each. A batch's answers appear in one step, so a run that dies loses no more than
        one batch, and `resume` goes on with the questions that have no answer: none is written twice, not even by two runs at once.
        english: with English instructions, if the generator has such, else with its own.
        """
        generator = self.generator.in_english() if english and hasattr(self.generator, "in_english") else self.generator
        asked = text_files.questions(self.spark, questions_path)
        if resume:
            asked = text_files.pending(asked, text_files.answered(self.spark, output), limit)
        elif limit is not None:
            asked = asked.orderBy("question_id").limit(limit)
        asked, done = asked.persist(), 0
        try:
            batches = max(1, math.ceil(asked.count() / batch))
            for number in range(batches):
                some = asked.where(F.pmod(F.xxhash64("question_id", "question"), F.lit(batches)) == number)
                try:
                    done += self._answered(some, output, generator, top_k, max_docs, resume)
                finally:
                    self.release()
            return done
        finally:
            asked.unpersist()

    def _answered(self, asked: DataFrame, output: str, generator: prompt.Generator, top_k: int, max_docs: int, once: bool) -> int:
        """Answer one batch and commit it; once: leave out what another run answered meanwhile."""
        hits = self._once(self.hits(asked, top_k))
        rows = prompt.answers(prompt.with_prompt(prompt.contexts(asked, hits)), generator, self.pace).where("status = 'ok'")
        out = self._once(rows.select("question_id", F.col("text").alias("answer")).join(candidates(asked, hits, max_docs), "question_id"))
        while n := out.count():
            try:
                text_files.commit_answers(out, output)
                return n
            except FileExistsError:
                if once:
                    out = self._once(text_files.pending(out, text_files.answered(self.spark, output)))
        return 0

    def status(self) -> tuple[int, list[str]]:
        return self.store.count(), [r.source for r in self.store.sources().collect()]


def is_folder(spark: SparkSession, path: str) -> bool:
    return Files(spark, path).is_folder()
