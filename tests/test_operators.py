import hashlib
import re
import resource
import uuid

import numpy as np
import pytest
from chunkweave.functions import text as X
from chunkweave.operators import evaluate, prompt
from chunkweave.operators import search as search_module
from chunkweave.operators.chunking import chunk, cut
from chunkweave.operators.embedding import HashedWords, Remote, checked, complete_sources, embed, hashed_counts, retry
from chunkweave.operators.search import search
from chunkweave.settings import Settings
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def model(text, size, overlap):
    """The rules of chunking once more, by character positions."""
    out, a = [], 0
    while text.strip():
        h = min(a + size, len(text))
        e = h
        if h < len(text):
            for sep in ("\n\n", "\n", ". ", " "):
                ends = [i + len(sep) for i in range(a + size // 2, h - len(sep) + 1) if text[i : i + len(sep)] == sep]
                if ends:
                    e = ends[-1]
                    break
        seg = text[a:e]
        if piece := seg.strip():
            o = a + seg.index(piece)
            out.append((piece, text[:o].count("\n") + 1, text[: max(o, o + len(piece) - 1)].count("\n") + 1))
        if e >= len(text):
            break
        a = max(e - overlap, a + 1)
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n\x1c é😀", max_size=120), st.integers(1, 30), st.integers(0, 29))
def test_chunks_follow_the_rules(text, size, overlap):
    if overlap >= size:
        with pytest.raises(ValueError):
            chunk(None, size, overlap)
        return
    got = list(cut(text, size, overlap))
    assert got == model(text, size, overlap)
    assert all(len(p) <= size and a <= b for p, a, b in got)


def test_chunk_frame(spark):
    docs = spark.createDataFrame([("a", "x " * 400, 1), ("b", None, 2), ("c", " \n", 3), ("a", "tiny", 4)], "source string, text string, index int")
    rows = chunk(docs, 300, 50).collect()
    assert {r.source for r in rows} == {"a"} and sum(r.text == "tiny" for r in rows) == 1
    assert chunk(docs.where("false")).count() == 0


def test_text_expressions(spark):
    odd = ["", "  x y\x1c ", "a\r\nb\rc\n", "　 a  b\t​c", "ΑΣ É"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    for t, strip, collapse, words, lines, low in rows.select("t", X.strip(F.col("t")), X.collapse(F.col("t")), X.words(F.col("t")), X.n_lines(X.newlines(F.col("t"))), F.lower("t")).collect():
        assert strip == t.strip() and collapse == re.sub(r"\s+", " ", t).strip() and words == t.split() and low == t.lower()
        assert lines == t.replace("\r\n", "\n").replace("\r", "\n").count("\n") + 1
    assert len(X.PY_WS) == 29


def test_ids_references_suffixes(spark):
    rows = spark.createDataFrame([("a.txt", 0, 0, 0), ("é b.TXT", 12, 3, 3), ("d__e__f.txt", 1, 2, 9), ("x.txt.bak", 7, 4, 0)], "source string, i int, a int, z int")
    got = rows.select("source", "i", X.point_id(F.col("source"), F.col("i")), X.reference(F.col("source"), F.col("a"), F.col("z")), X.has_suffix(F.col("source")), X.document_id(F.col("source"))).collect()
    for source, i, id_, *_ in got:
        assert id_ == str(uuid.uuid5(uuid.UUID("6f9619ff-8b86-d011-b42d-00c04fc964ff"), f"{source}:{i}"))
    assert got[0][2] == "507e1e41-68b0-5e8e-8168-234738d42cdc"
    assert [r[3] for r in got] == ["a.txt", "é b.TXT (l. 3)", "d__e__f.txt (l. 2-9)", "x.txt.bak (l. 4)"]
    assert [r[4] for r in got] == [True, True, True, False] and got[2][5] == "d"


def test_hashed_words_in_three_forms(spark):
    texts = ["", "The the THE cat", "ünï   code 漢字"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source string, text string")
    counts = {(r.source, r.bucket): r.n for r in hashed_counts(rows, ["source"]).collect()}
    for r in embed(rows, HashedWords(), batch=2).collect():
        want = [0] * 64
        for w in r.text.lower().split():
            want[hashlib.md5(w.encode()).digest()[0] % 64] += 1
        assert r.vector == want and r.status == "ok" and all(counts.get((r.source, b), 0) == n for b, n in enumerate(want))


class Broken(HashedWords):
    def embed(self, texts):
        if any("bad" in t for t in texts):
            raise OSError("no service")
        return super().embed(texts)


def test_failed_batches_take_their_documents_out(spark):
    rows = spark.createDataFrame([("a", "fine"), ("a", "bad"), ("b", "good")], "source string, text string").coalesce(1)
    found = embed(rows, Broken(), batch=1)
    assert sorted((r.source, r.status) for r in found.collect()) == [("a", "failed"), ("a", "ok"), ("b", "ok")]
    assert [r.source for r in complete_sources(found).collect()] == ["b"]
    with pytest.raises(ValueError):
        checked([[1.0]], 2, 1)
    with pytest.raises(ValueError):
        checked([[1.0, 2.0]], 1, 1)


def test_retry_waits_longer_each_time():
    waits, calls = [], []

    def fails():
        calls.append(1)
        raise OSError("x")

    with pytest.raises(RuntimeError):
        retry(fails, sleep=waits.append)
    assert waits == [5, 10, 20, 40] and len(calls) == 5
    assert retry(lambda: 3) == 3


def test_search_matches_brute_force(spark, monkeypatch):
    r = np.random.default_rng(0)
    store = [(f"s{i % 40:02d}", i, [float(x) for x in r.integers(-2, 3, 6)]) for i in range(300)] + [("zero", 0, [0.0] * 6)]
    asked = [(i, [float(x) for x in r.integers(-2, 3, 6)]) for i in range(9)] + [(9, [0.0] * 6)]
    rows = spark.createDataFrame(store, "source string, index int, vector array<double>").repartition(5)
    questions = spark.createDataFrame(asked, "question_id long, vector array<double>")

    def cosine(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(np.dot(a, b)) / n, 6) + 0.0 if n else 0.0

    for k, threshold, sent in ((7, None, 1 << 20), (None, None, 0), (0, 0.3, 1 << 20), (500, 0.9, 0), (3, None, 100)):
        found = search(rows.withColumn("more", F.concat("source", F.lit("!"))), questions, k, threshold, sent_bytes=sent).collect()
        got = sorted((h.question_id, h.rank, h.source, h["index"], h.score) for h in found)
        want = []
        for q, v in asked:
            ranked = sorted((-cosine(v, w), s, i) for s, i, w in store)
            kept = [x for x in ranked if not threshold or -x[0] >= threshold][: k or 4]
            want += [(q, n + 1, s, i, -c + 0.0) for n, (c, s, i) in enumerate(kept)]
        assert got == sorted(want) and all(h.more == h.source + "!" for h in found)
    for name, value in (("BLOCK_BYTES", 100), ("GROUP_BYTES", 2000), ("TILE", 64), ("WIDTH", 16)):
        monkeypatch.setattr(f"chunkweave.operators.search.{name}", value)
    few = sorted((h.question_id, h.rank, h.source, h["index"], h.score) for h in search(rows, questions, 7, sent_bytes=0).collect())
    assert few == sorted((h.question_id, h.rank, h.source, h["index"], h.score) for h in search(rows, questions, 7).collect()) and len(few) == 70
    for sent in (0, 1 << 20):
        assert search(rows.where("false"), questions, 7, sent_bytes=sent).count() == 0 and search(rows, questions.where("false"), 7, sent_bytes=sent).count() == 0


def test_equal_rows_are_ranked_once_each_where_they_fit(spark):
    """Rows equal in all columns are hits of their own; their other columns come without multiplying them."""
    store = spark.createDataFrame([("a", 0, [1.0, 0.0], "x")] * 3 + [("a", 0, [1.0, 0.0], "y"), (None, None, [0.0, 1.0], None)], "source string, index int, vector array<double>, text string")
    asked = spark.createDataFrame([("q", [1.0, 0.1]), (None, [0.0, 1.0])], "question_id string, vector array<double>")
    for sent in (0, 1 << 20):
        got = search(store, asked, 4, sent_bytes=sent).collect()
        assert sorted(h.rank for h in got) == [1, 1, 2, 2, 3, 3, 4, 4]
        assert sorted(h.text for h in got if h.question_id == "q") == ["x", "x", "x", "y"]
        assert [(h.source, h.text) for h in got if h.question_id is None and h.rank == 1] == [(None, None)]


def test_many_questions_stay_in_bounded_tiles(spark):
    """20,000 questions against 3,000 rows: no worker takes 1 GB more than it had before."""
    r = np.random.default_rng(3)
    base = r.normal(size=(3000, 64))
    store = spark.createDataFrame([(f"s{i:05d}", 0, v.tolist()) for i, v in enumerate(base)], "source string, index int, vector array<double>").repartition(4)
    asked = spark.range(20_000).selectExpr("id as question_id", "array_repeat(double(0), 64) as vector").mapInPandas(
        lambda parts: (p.assign(vector=[(base[i % 3000] + (i // 3000) * 1e-3).tolist() for i in p["question_id"]]) for p in parts), "question_id long, vector array<double>")
    found = search(store, asked, 5, sent_bytes=0)
    top = found.where("rank = 1").select("question_id", "source").collect()
    assert len(top) == 20_000 and all(int(t.source[1:]) == t.question_id % 3000 for t in top)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    x = base / np.linalg.norm(base, axis=1, keepdims=True)
    best = search_module.improved(np.full((20_000, 5), search_module.NONE), x[np.arange(20_000) % 3000], x, np.arange(3000), 3000)
    assert (best[:, 0] != search_module.NONE).all() and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 19


def test_search_over_many_batches(spark):
    """A task keeps its best over all batches that it reads."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        store = spark.createDataFrame([(f"s{i * 37 % 100:02d}", i, [float(i % 9), 1.0], f"t{i}") for i in range(100)], "source string, index int, vector array<double>, text string").coalesce(1)
        asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "question_id long, vector array<double>")
        got = sorted((h.question_id, h.rank, h.source, h.text) for h in search(store, asked, 5).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    named = lambda rest: [(f"t{i}", s) for s, i in sorted((f"s{i * 37 % 100:02d}", i) for i in range(100) if i % 9 == rest)[:5]]
    assert got == [(q, n + 1, s, t) for q, rest in ((1, 8), (2, 0)) for n, (t, s) in enumerate(named(rest))]


def test_candidates_and_recall(spark):
    hits = spark.createDataFrame([(1, 1, "a__x"), (1, 2, "b__x"), (1, 3, "a__y"), (1, 4, "c"), (2, 1, "c__z")], "question_id long, rank int, source string")
    asked = spark.createDataFrame([(1, "q", "u"), (2, "q", "u"), (3, "q", "v")], "question_id long, question string, category string")
    ids = lambda most: {r.question_id: r.document_ids for r in evaluate.candidates(asked, hits, most).collect()}
    assert ids(10) == {1: ["a", "b", "c"], 2: ["c"], 3: []} and ids(2)[1] == ["a", "b"] and ids(0) == {1: ["a"], 2: ["c"], 3: []}
    links = spark.createDataFrame([(1, "a"), (1, "z"), (3, "k")], "question_id long, doc string")
    scores = evaluate.scored(evaluate.candidates(asked, hits, 10), evaluate.gold_sets(asked, links))
    assert {r.question_id: (r.n_gold, r.n_found, r.n_extra, r.recall) for r in scores.collect()} == {1: (2, 1, 2, 0.5), 2: (0, 0, 1, None), 3: (1, 0, 0, 0.0)}
    report = {r.category: (r.n, r.recall, r.complete, r.missed) for r in evaluate.category_report(scores, asked).collect()}
    assert report == {"u": (1, 0.5, 0, 0), "v": (1, 0, 0, 1), "all": (2, 0.25, 0, 0.5)}


def test_containing_passages(spark):
    docs = spark.createDataFrame([("a__1", "one two three"), ("b__1", "two"), ("c__1", None)], "source string, text string")
    asked = spark.createDataFrame([(1, "two"), (2, "one two"), (3, "none"), (4, "two"), (5, "")], "question_id long, question string")
    assert sorted(map(tuple, evaluate.containing(docs, asked).collect())) == [(1, "a"), (1, "b"), (2, "a"), (4, "a"), (4, "b")]
    assert evaluate.containing(docs, asked.where("false")).count() == 0


def test_containing_passages_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "PASSAGE_BYTES", 5)
    test_containing_passages(spark)


def test_prompts_and_answers(spark):
    asked = spark.createDataFrame([(1, "  why? "), (2, "none"), (3, "boom")], "question_id long, question string")
    hits = spark.createDataFrame([(1, 2, 0.5, "b", 0, "B", 0, 0), (1, 1, 0.9, "a", 1, "A", 2, 5), (3, 1, 0.1, "c", 0, "C", 1, 1)], "question_id long, rank int, score double, source string, index int, text string, line_start int, line_end int")

    class Sometimes(prompt.Echo):
        def generate(self, prompts, contexts):
            if "boom" in prompts[0]:
                raise OSError("no service")
            return super().generate(prompts, contexts)

    rows = prompt.with_prompt(prompt.contexts(asked, hits))
    one = rows.where("question_id = 1").first()
    assert one.context == "[1] Source : a (l. 2-5)\nA\n\n[2] Source : b\nB" and "\n\nQuestion : why?\n\n" in one.prompt
    got = {r.question_id: r for r in prompt.answers(rows, Sometimes()).collect()}
    assert got[1].text.endswith(one.context) and [s.chunk.source for s in got[1].sources] == ["a", "b"]
    again = prompt.answers(rows.unionByName(rows.where("question_id = 1")).unionByName(rows.where("question_id = 2").withColumn("question_id", F.lit(None).cast("long"))), Sometimes()).collect()
    assert sorted((r.question_id or 0) for r in again) == [0, 1, 1, 2, 3] and all(len(r.sources) == 2 for r in again if r.question_id == 1)
    assert got[2].text == prompt.NO_CONTEXT and got[3].status == "failed" and "no service" in got[3].error


def test_adapters_of_remote_models(spark):
    def flaky(system, text, temperature, seen=[]):  # noqa: B006
        seen.append(text)
        if len(seen) == 1:
            raise OSError("busy")
        return f"  {system[:2]} {text} {temperature} " if text else None

    assert prompt.Chat(flaky, "EN", base_delay=0).generate(["q", ""], ["", ""]) == ["EN q 0.1", ""]
    sizes = spark.createDataFrame([("a", "x" * i) for i in range(70)], "source string, text string").coalesce(1)
    found = embed(sizes, Remote(lambda texts: [[float(len(texts)), float(len(t))] for t in texts], 2)).collect()
    assert max(r.vector[0] for r in found) == 32 and sorted(r.vector[1] for r in found) == list(range(70))


def test_settings():
    assert Settings.from_env({}) == Settings() and Settings.from_env({"TOP_K": " ", "CHUNK_SIZE": "200"}).chunk_size == 200
    for wrong in ({"TOP_K": "four"}, {"CHUNK_SIZE": "100"}):
        with pytest.raises(ValueError):
            Settings.from_env(wrong)
