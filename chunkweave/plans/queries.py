"""The registered queries of the retrieval engine, each over whole tables.

The corpus is `documents` under names like `doc_00000007__src7.txt`; questions are `benchmark` rows or what users say in
`conversations`; vectors are `embeddings`, under names like `vec_00000007`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.functions import text as X
from chunkweave.operators import evaluate, prompt
from chunkweave.operators.chunking import chunk, register
from chunkweave.operators.embedding import HashedWords, embed, hashed_counts
from chunkweave.operators.search import search
from chunkweave.plans.pipeline import report
from chunkweave.sources import collection, text_files
from chunkweave.sources.files import shared_folder
from chunkweave.sources.index import VectorIndex

Query = Callable[[SparkSession, str], DataFrame]
#: Least score of a hit for no_context_answer: some questions have no chunk this near.
NEAR = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit("__"), "source", F.lit(".txt"))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("source"), X.newlines(F.col("text")).alias("text"), "lang", F.col("source").alias("origin"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk(corpus(spark, sf_dir))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("vec_"), F.lpad(F.col("vec_id").cast("string"), 8, "0"))
    return table(spark, sf_dir, "embeddings").select("vec_id", name.alias("source"), F.lit(0).alias("index"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def named_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("source", "index", "vector")


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "vector")


def embedded(rows: DataFrame) -> DataFrame:
    return embed(rows, HashedWords()).drop("status", "error")


def hits(spark: SparkSession, sf_dir: str, top_k: int = 20, threshold: float | None = None) -> DataFrame:
    asked = embedded(benchmark(spark, sf_dir).withColumnRenamed("question", "text")).select("question_id", "vector")
    return search(embedded(chunks(spark, sf_dir)), asked, top_k, threshold)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = benchmark(spark, sf_dir)
    return evaluate.gold_sets(asked, evaluate.containing(corpus(spark, sf_dir), asked))


def retrieve_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first benchmark question against all chunks: four cited hits."""
    first = benchmark(spark, sf_dir).orderBy("question_id").limit(1).withColumnRenamed("question", "text")
    found = search(embedded(chunks(spark, sf_dir)), embedded(first).select("question_id", "vector"), 4)
    return found.select("question_id", "rank", X.reference(F.col("source"), F.col("line_start"), F.col("line_end")).alias("reference"), "score")


def load_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_files.load_stats(corpus(spark, sf_dir).where(~X.is_blank(F.col("text"))))


def suffix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = corpus(spark, sf_dir).select(F.when(F.col("lang") == "en", F.upper("source")).when(F.col("lang") == "de", F.concat("source", F.lit(".bak"))).otherwise(F.col("source")).alias("source"))
    return names.where(X.has_suffix(F.col("source")))


def doc_id_from_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("source", X.document_id(F.col("source")).alias("document_id"))


def chunk_1000_150(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk(corpus(spark, sf_dir), 1000, 150)


def chunk_300_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk(corpus(spark, sf_dir), 300, 50)


def chunk_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of all documents by SQL, with the table function."""
    register(spark)
    rows = "SELECT source, c.* FROM {documents}, LATERAL chunk_text(text, 1000, 150) AS c(index, text, line_start, line_end)"
    return spark.sql(rows, documents=corpus(spark, sf_dir))


def chunk_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    start = F.when(F.col("index") % 5 == 4, 0).otherwise(F.col("line_start"))
    return rows.select("source", "index", X.reference(F.col("source"), start, F.col("line_end")).alias("reference"))


def point_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.points(chunks(spark, sf_dir)).select("id", "source", "index")


def payload_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = embedded(collection.points(chunks(spark, sf_dir)))
    return stored.select("text", "source", "index", "line_start", "line_end")


def payload_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    holes = [F.when(F.pmod(F.length("text") + k, F.lit(5)) != 0, F.col(c)).alias(c) for k, c in enumerate(rows.columns)]
    return collection.with_defaults(rows.select(*holes))


def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(corpus(spark, sf_dir), chunks(spark, sf_dir)).select("source", F.col("n_chunks").cast("long").alias("n_chunks"))


def list_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.sources_of(chunks(spark, sf_dir)).orderBy("source")


def collection_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).agg(F.count("*").alias("n_points"))


def hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed_counts(chunks(spark, sf_dir), ["source", "index"])


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedded(chunks(spark, sf_dir))
    return found.select("source", "index", F.posexplode("vector").alias("bucket", "n")).where("n > 0").withColumn("n", F.col("n").cast("long"))


def search_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = vectors(spark, sf_dir).orderBy("vec_id").limit(1).select(F.col("vec_id").alias("question_id"), "vector")
    return search(vectors(spark, sf_dir), first).select("question_id", "rank", "source", "score")


def search_batch_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(named_vectors(spark, sf_dir), asked_vectors(spark, sf_dir), 10, sent_bytes=0).select("question_id", "rank", "source", "score")


def search_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(named_vectors(spark, sf_dir), asked_vectors(spark, sf_dir), 10, threshold=0.5, sent_bytes=0).select("question_id", "rank", "source", "score")


def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(vectors(spark, sf_dir).where("label = 3").select("source", "index", "vector"), asked_vectors(spark, sf_dir), 10, sent_bytes=0).select("question_id", "rank", "source", "score")


def rag_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("question_id", "rank", "source", "index", "score")


@contextmanager
def own_store(spark: SparkSession, dimension: int = 1) -> Iterator[collection.Collection]:
    """A store for one query; removed at the end."""
    store = collection.Collection(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", dimension)
    try:
        yield store
    finally:
        store.drop()


def storable(rows: DataFrame) -> DataFrame:
    return rows.withColumn("vector", F.array(F.lit(0.0)))


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks are stored; English documents come in again twice, with a mark before each chunk: the last wins."""
    with own_store(spark) as store:
        store.add(storable(chunks(spark, sf_dir)))
        again = chunk(corpus(spark, sf_dir).where("lang = 'en'"))
        twice = F.inline(F.array(*[F.struct(F.concat(F.lit(f"{n} "), "text").alias("text"), F.lit(n).alias("seq")) for n in (1, 2)]))
        store.add(storable(again.select("source", "index", "line_start", "line_end", twice)), order="seq")
        return store.rows().select("id", "source", "index", "text").checkpoint()


def delete_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks are stored, and those of the first source deleted."""
    name = corpus(spark, sf_dir).agg(F.min("source")).first()[0]
    with own_store(spark) as store:
        store.add(storable(chunks(spark, sf_dir)))
        store.delete_source(name)
        return store.rows().select("source", "index").checkpoint()


@contextmanager
def indexed_vectors(spark: SparkSession, sf_dir: str) -> Iterator[VectorIndex]:
    """All vectors, stored and indexed."""
    rows = vectors(spark, sf_dir)
    dimension = rows.agg(F.coalesce(F.max(F.size("vector")), F.lit(1))).first()[0]
    with own_store(spark, dimension) as store:
        store.add(rows.select("source", "index", "vector", F.lit("").alias("text"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end")))
        kept = VectorIndex(store)
        kept.build()
        yield kept


def search_threshold_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of search_threshold, from the cells of an index that can hold some."""
    with indexed_vectors(spark, sf_dir) as kept:
        return kept.within(asked_vectors(spark, sf_dir), 0.5, 10).select("question_id", "rank", "source", "score").checkpoint()


def search_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors are stored and indexed, and every twentieth asks for its best 20: how many of the exact ones the index finds."""
    asked = asked_vectors(spark, sf_dir)
    with indexed_vectors(spark, sf_dir) as kept:
        kept.tuned(20)
        near = kept.search(asked, 20).select("question_id", "source", F.lit(1).alias("found"))
        exact = search(named_vectors(spark, sf_dir), asked, 20, sent_bytes=0).select("question_id", "source")
        both = exact.join(near, ["question_id", "source"], "left").groupBy("question_id").agg(F.count("*").alias("n_exact"), F.count("found").alias("n_found"))
        return both.withColumn("recall", F.round(F.col("n_found") / F.col("n_exact"), 6)).checkpoint()


def reset_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks go into a store of their own, which is then emptied; counted before and after."""
    store = collection.Collection(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", HashedWords().dimension)
    try:
        store.add(embedded(chunks(spark, sf_dir)))
        before = store.count()
        store.reset()
        return spark.createDataFrame([("before", before), ("after", store.count())], "state string, n_points long")
    finally:
        store.drop()


def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = collection.sources_of(chunk(corpus(spark, sf_dir).where("lang <> 'fr'")))
    return corpus(spark, sf_dir).select("source").join(stored, "source", "left_anti")


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws(":", F.lpad(F.col("conv_id").cast("string"), 10, "0"), F.lpad(F.col("turn").cast("string"), 6, "0"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select(key.alias("question_id"), F.col("text").alias("question"))


def bench_resume_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = user_turns(spark, sf_dir)
    done = asked.where(F.length("question") % 3 == 0).select("question_id")
    return text_files.pending(asked, done, limit=50)


def doc_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.candidates(benchmark(spark, sf_dir), hits(spark, sf_dir)).select("question_id", F.array_join("document_ids", ",").alias("document_ids"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.scored(evaluate.candidates(benchmark(spark, sf_dir), hits(spark, sf_dir)), gold(spark, sf_dir))


def gold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold(spark, sf_dir).select("question_id", F.array_join("gold", ",").alias("gold"))


def doc_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).where("n_gold > 0").select("question_id", "n_gold", "n_found", F.round("recall", 6).alias("recall"))


def extra_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("question_id", "n_extra")


def category_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.when(F.length("question") > 200, "long").otherwise("short")
    return evaluate.category_report(scores(spark, sf_dir), benchmark(spark, sf_dir).select("question_id", category.alias("category")))


def contexts(spark: SparkSession, sf_dir: str, threshold: float | None = None) -> DataFrame:
    """Four hits at most for each question, of at least the threshold."""
    found = hits(spark, sf_dir, 4, threshold)
    return prompt.with_prompt(prompt.contexts(benchmark(spark, sf_dir), found))


def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(spark, sf_dir).select("question_id", "n_hits", "context")


def user_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(spark, sf_dir).select("question_id", "prompt")


def fake_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt.answers(contexts(spark, sf_dir), prompt.Echo()).select("question_id", "text", F.size("sources").alias("n_sources"))


def no_context_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt.answers(contexts(spark, sf_dir, NEAR), prompt.Echo()).where("size(sources) = 0").select("question_id", "text")


def excerpt_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("source", X.excerpt(F.col("text")).alias("excerpt"))


def normalize_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("source", X.collapse(F.col("text")).alias("text"))


def source_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).groupBy("origin").agg(F.count("*").alias("n_documents"))


def corpus_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = evaluate.containing(corpus(spark, sf_dir), benchmark(spark, sf_dir)).select("doc")
    return evaluate.sampled(corpus(spark, sf_dir), wanted, 100)


def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = ingest_report(spark, sf_dir)
    return done.agg(F.count("*").alias("n_documents"), F.sum("n_chunks").alias("n_chunks"), F.count_if(F.col("n_chunks") == 0).alias("n_failed"))


QUERIES = (
    load_stats, suffix_filter, doc_id_from_source, chunk_1000_150, chunk_300_50, chunk_lateral, chunk_reference, point_id, payload_projection,
    payload_defaults, ingest_report, list_sources, collection_count, hashed_embedding, embedding_vectors, search_top_k, search_batch_top_k,
    search_threshold, search_filtered, search_threshold_indexed, rag_retrieve, search_approximate, upsert_merge, delete_source, reset_store, resume_anti_join, bench_resume_limit,
    doc_candidates, gold_documents, doc_recall, extra_docs, category_report, context_block, user_prompt, fake_answer,
    no_context_answer, excerpt_200, normalize_ws, source_distribution, corpus_sample, batch_totals,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}
