"""Commands: ingest, ask, bench, status, index, compact, reset."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chunkweave import prepare
from chunkweave.functions import text as X
from chunkweave.plans.pipeline import Pipeline, is_folder
from chunkweave.settings import Settings
from chunkweave.sources.index import VectorIndex


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="chunkweave", description="Document retrieval on Spark.")
    top.add_argument("--root", default="store", help="folder of the collections")
    verbs = top.add_subparsers(dest="verb", required=True)
    ingest = verbs.add_parser("ingest", help="index a .txt file or a folder of them")
    ingest.add_argument("path")
    ingest.add_argument("-r", "--recursive", action="store_true")
    ingest.add_argument("--resume", action="store_true", help="skip indexed documents (of a folder)")
    ask = verbs.add_parser("ask", help="answer a question with its sources")
    ask.add_argument("question")
    ask.add_argument("--top-k", type=int)
    bench = verbs.add_parser("bench", help="answer a file of questions")
    bench.add_argument("--questions", required=True)
    bench.add_argument("--output", required=True)
    bench.add_argument("--top-k", type=int, default=20)
    bench.add_argument("--max-docs", type=int, default=10)
    bench.add_argument("--limit", type=int)
    bench.add_argument("--resume", action="store_true")
    bench.add_argument("--francais", action="store_true", help="keep the French instructions (English ones by default)")
    bench.add_argument("--batch", type=int, default=1000, help="questions whose answers are committed at once")
    index = verbs.add_parser("index", help="fit or complete the approximate index")
    index.add_argument("--cells", type=int)
    index.add_argument("--top-k", type=int, default=20)
    index.add_argument("--recall", type=float, default=0.95)
    verbs.add_parser("compact", help="write all rows into one run, without marks")
    verbs.add_parser("status", help="count chunks and list documents")
    verbs.add_parser("reset", help="empty the collection")
    return top


def ingest(pipeline: Pipeline, args: argparse.Namespace) -> None:
    if not is_folder(pipeline.spark, args.path):
        print(f"{args.path}: {pipeline.ingest_file(args.path)}")
        return
    rows = pipeline.ingest_directory(args.path, args.recursive, args.resume).collect()  # one small row for each file
    pipeline.release()
    print("\n".join(f"{row.source}: {row.n_chunks}" for row in rows) or f"no .txt file found in {args.path}")


def ask(pipeline: Pipeline, args: argparse.Namespace) -> None:
    cited = F.transform(
        "sources",
        lambda h: F.concat(X.reference(h["chunk"]["source"], h["chunk"]["line_start"], h["chunk"]["line_end"]), F.format_string(" (score %.3f)\n      « %s... »", h["score"], X.excerpt(h["chunk"]["text"]))),
    )
    row = pipeline.ask(args.question, args.top_k).select("question", "text", cited.alias("cited")).first()
    parts = [("Question: ", row.question), ("Answer:\n", row.text), ("Sources:\n", "\n".join(f"  [{n}] {line}" for n, line in enumerate(row.cited, 1)))]
    print("\n" + "\n\n".join(name + text for name, text in parts))


def bench(pipeline: Pipeline, args: argparse.Namespace) -> None:
    print(pipeline.bench(args.questions, args.output, args.top_k, args.max_docs, args.limit, args.resume, not args.francais, args.batch))


def status(pipeline: Pipeline, _: argparse.Namespace) -> None:
    count, names = pipeline.status()
    print(f"Collection: {pipeline.settings.collection}", f"Chunks: {count}", "Documents:", *[f"  • {n}" for n in names], sep="\n")


def index(pipeline: Pipeline, args: argparse.Namespace) -> None:
    kept = VectorIndex(pipeline.store)
    kept.build(args.cells)
    print(f"probes: {kept.tuned(args.top_k, args.recall)}" if pipeline.store.count() else "The collection is empty.")


def compact(pipeline: Pipeline, _: argparse.Namespace) -> None:
    pipeline.store.compact()
    print(f"Runs: {len(pipeline.store.manifest()['runs'])}")


def reset(pipeline: Pipeline, _: argparse.Namespace) -> None:
    pipeline.store.reset()
    print("The collection is empty.")


VERBS = {f.__name__: f for f in (ingest, ask, bench, status, index, compact, reset)}


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    try:
        spark = SparkSession.builder.appName("chunkweave").getOrCreate()
        prepare(spark)
        pipeline = Pipeline(spark, args.root, Settings.from_env())
    except (ValueError, OSError) as error:
        print(f"cannot start: {error}", file=sys.stderr)
        return 1
    VERBS[args.verb](pipeline, args)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
