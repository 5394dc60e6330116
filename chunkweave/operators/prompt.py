"""From ranked chunks to numbered contexts, prompts and answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkweave.functions import text as X
from chunkweave.operators.batches import slices
from chunkweave.operators.embedding import retry
from chunkweave.operators.remote import Caller, Pace

#: The wording of prompts and of the answer without context.
BEFORE_CONTEXT = "Extraits de documents :\n---------------------\n"
BEFORE_QUESTION = "\n---------------------\n\nQuestion : "
AFTER_QUESTION = "\n\nRéponse (en citant les extraits utilisés) :"
NO_CONTEXT = "Aucun document pertinent n'a été trouvé pour répondre à cette question."
ECHO_HEADER = "[FAUSSE RÉPONSE]\nPrompt qui serait envoyé au LLM :\n\n"
#: What a chat model is told to write if the excerpts do not hold the answer.
REFUSAL_FR = "Je ne trouve pas la réponse dans ces extraits."
REFUSAL_EN = "These excerpts do not answer the question."
#: Instructions for a chat model, one in French that asks for citations and one in English that does not.
SYSTEM_FR = (
    "Tu réponds en français, brièvement, à partir des seuls extraits fournis, et tu cites leurs numéros [1], [2]. "
    f"S'ils ne contiennent pas la réponse, écris : \"{REFUSAL_FR}\""
)
SYSTEM_EN = (
    "Answer in English, briefly, from the given excerpts alone, without describing them. "
    f"If they do not hold the answer, write: \"{REFUSAL_EN}\""
)


class Generator(Protocol):
    def generate(self, prompts: list[str], contexts: list[str]) -> list[str]: ...

    def in_english(self) -> Generator:
        """The same generator with English instructions, for questions whose reference answers are in English."""
        ...


class Echo:
    """Offline generator: a header and the first 600 characters of the context."""

    def generate(self, prompts: list[str], contexts: list[str]) -> list[str]:
        return [ECHO_HEADER + c[:600] for c in contexts]

    def in_english(self) -> Echo:
        return self


class Chat:
    """Generator over any chat model: complete(system, prompt, temperature) -> text. Failed calls are repeated with growing pauses."""

    def __init__(self, complete: Callable[[str, str, float], str | None], system: str | None = None, temperature: float = 0.1, attempts: int = 5, base_delay: float = 5.0) -> None:
        self.complete, self.system, self.temperature = complete, system or SYSTEM_FR, temperature
        self.attempts, self.base_delay = attempts, base_delay

    def in_english(self) -> Chat:
        return Chat(self.complete, SYSTEM_EN, self.temperature, self.attempts, self.base_delay)

    def generate(self, prompts: list[str], contexts: list[str]) -> list[str]:
        call = lambda p: self.complete(self.system, p, self.temperature)
        return [(retry(partial(call, p), self.attempts, self.base_delay, "the chat model") or "").strip() for p in prompts]


def contexts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """question_id, question, n_hits, context and sources for every question, with or without hits.

    hits: question_id, rank, score, source, index, text, line_start, line_end. At most top_k rows meet for a question.
    """
    cited = X.reference(F.col("source"), F.col("line_start"), F.col("line_end"))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] Source : "), cited, F.lit("\n"), F.col("text"))
    chunk = F.struct("source", "index", "text", "line_start", "line_end")
    held = hits.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block"), F.struct(chunk.alias("chunk"), "score").alias("hit")))).alias("found"))
    joined = questions.select("question_id", "question").join(held, "question_id", "left")
    return joined.select(
        "question_id", "question",
        F.coalesce(F.size("found"), F.lit(0)).alias("n_hits"),
        F.coalesce(F.array_join(F.transform("found", lambda x: x["block"]), "\n\n"), F.lit("")).alias("context"),
        F.coalesce(F.transform("found", lambda x: x["hit"]), F.array()).alias("sources"),
    )


def with_prompt(rows: DataFrame) -> DataFrame:
    """Add prompt: the context and the stripped question in their frame."""
    return rows.withColumn("prompt", F.concat(F.lit(BEFORE_CONTEXT), "context", F.lit(BEFORE_QUESTION), X.strip(F.col("question")), F.lit(AFTER_QUESTION)))


def answers(rows: DataFrame, generator: Generator, pace: Pace | None = None) -> DataFrame:
    """question_id, question, text, sources, status and error for each of rows (with prompt, context, n_hits and sources). Without hits the generator is not
    asked; a failure marks its row and leaves the others alone. Rows are answered where they are: equal or null ids play no part.

    pace: for a remote model; rows are dealt to its number of tasks, which share its rate and keep several calls in flight.
    """
    rows = rows.repartition(pace.tasks) if pace else rows
    slim = rows.select("question_id", "question", "sources", "n_hits", "context", "prompt")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller = Caller(pace) if pace else None
        ask_for = caller.call if caller else lambda call: call()

        def one(n: int, context: str, prompt: str) -> str:
            return (ask_for(lambda: generator.generate([prompt], [context])[0]) or "").strip() if n else NO_CONTEXT

        def outcome(*row: object) -> str | Exception:
            try:
                return one(*row)
            except Exception as error:  # any failure of a remote service
                return error

        for batch in slices(batches):
            rows = list(zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True))
            got = caller.all([partial(one, *row) for row in rows]) if caller else [outcome(*row) for row in rows]
            errors = [str(g) if isinstance(g, Exception) else None for g in got]
            texts = [None if isinstance(g, Exception) else g for g in got]
            status = pa.array(["ok" if e is None else "failed" for e in errors], pa.string())
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), batch.column(2), status, pa.array(errors, pa.string())]
            yield pa.record_batch(columns, ["question_id", "question", "text", "sources", "status", "error"])

    more = {name: T.StructField(name, T.StringType()) for name in ("text", "status", "error")}
    known = {f.name: f for f in slim.schema.fields}
    return slim.mapInArrow(ask, T.StructType([(more | known)[c] for c in ("question_id", "question", "text", "sources", "status", "error")]))
