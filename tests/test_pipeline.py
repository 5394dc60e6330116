import hashlib
import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from chunkweave.__main__ import main
from chunkweave.operators.embedding import HashedWords
from chunkweave.operators.prompt import Echo
from chunkweave.plans.pipeline import Pipeline
from chunkweave.settings import Settings
from chunkweave.sources import text_files
from chunkweave.sources.collection import Collection
from chunkweave.sources.files import Files
from chunkweave.streaming.ingest import ingest_stream
from pyspark.sql import functions as F

REPORT = "\n".join(f"{'  ' if i % 5 == 0 else ''}Ligne {i} du rapport : résultat {i * 7} % et suite du texte." + ("\n" if i % 6 == 5 else "") for i in range(40))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/report.txt").write_text(REPORT)
    (tmp_path / "in/odd name.txt").write_bytes(b"\x78\xff\xfe\x79\xe2\x82\x7a\xf0\x9f\x98\r\nb\rc\n")
    (tmp_path / "in/blank.txt").write_text(" \n\t")
    (tmp_path / "in/none.txt").write_text("")
    (tmp_path / "in/UPPER.TXT").write_text("upper case")
    (tmp_path / "in/sub/deep.txt").write_text("﻿deep text")
    return tmp_path


def small(spark, folder):
    return Pipeline(spark, str(folder / "store"), Settings(chunk_size=300, chunk_overlap=50, top_k=2))


def test_loading(spark, folder):
    rows = {r.source: r for r in text_files.scan_folder(spark, str(folder / "in")).collect()}
    assert set(rows) == {"report.txt", "odd name.txt", "blank.txt", "none.txt"}  # no other suffix, no subfolder
    assert rows["none.txt"].status == "empty" and rows["none.txt"].text == ""
    assert rows["odd name.txt"].text == "x��y�z�\nb\nc\n" and rows["blank.txt"].status == "empty"
    deep = {r.source: r.text for r in text_files.scan_folder(spark, str(folder / "in"), recursive=True).collect()}
    assert deep["deep.txt"] == "﻿deep text"
    assert {r.source for r in text_files.scan_folder(spark, str(folder / "in"), True, relative=True).collect()} >= {"sub/deep.txt"}
    assert text_files.scan_folder(spark, str(folder / "in"), limit=2).count() == 2
    assert {r.source for r in text_files.listed(spark, str(folder / "in")).collect()} == {"report.txt", "odd name.txt", "blank.txt", "none.txt"}
    assert text_files.load_file(spark, str(folder / "in/UPPER.TXT")).first().text == "upper case"
    for name, error in (("nothing.txt", FileNotFoundError), ("blank.txt", ValueError), ("../in", ValueError)):
        with pytest.raises(error):
            text_files.load_file(spark, str(folder / "in" / name))
    with pytest.raises(NotADirectoryError):
        text_files.scan_folder(spark, str(folder / "in/report.txt"))


def test_tasks_list_and_read_a_folder(spark, folder, monkeypatch):
    """Hidden and empty files are there, each file once, in batches of bounded size; the rows are those of Spark's own reader where that sees them."""
    (folder / "in/.hidden.txt").write_text("hidden")
    (folder / "in/sub/more/_deep").mkdir(parents=True)
    for i in range(40):
        (folder / f"in/sub/more/_deep/f{i}.txt").write_text(f"text {i}")
    want = {p.name for p in (folder / "in").rglob("*.txt")} - {"UPPER.TXT"}
    for path in (str(folder / "in"), f"file://{folder}/in"):
        rows = text_files.scan_folder(spark, path, recursive=True, relative=True).collect()
        assert len(rows) == len(want) == 46 and {r.source.rsplit("/")[-1] for r in rows} == want
        assert {r.source.rsplit("/")[-1] for r in text_files.listed(spark, path, True).collect()} == want
    assert {r.text for r in rows if "_deep" in r.source} == {f"text {i}" for i in range(40)}
    (folder / "empty").mkdir()
    assert text_files.scan_folder(spark, str(folder / "empty")).count() == 0
    monkeypatch.setattr(text_files, "readable", lambda _: False)
    plain = {r.source: r.text for r in text_files.scan_folder(spark, str(folder / "in"), True).collect()}
    assert plain == {r.source: r.text for r in text_files.with_text(text_files.folder_files(spark, str(folder / "in"), True), text_files.basename(F.col("path"))).collect() if r.source in plain} and len(plain) == 4
    assert {r.source for r in text_files.listed(spark, str(folder / "in")).collect()} == {"report.txt", "odd name.txt", "blank.txt"}


def test_ingest_ask_delete(spark, folder):
    pipeline = small(spark, folder)
    n = pipeline.ingest_file(str(folder / "in/report.txt"))
    assert n > 5 and pipeline.store.count() == n
    assert pipeline.ingest_file(str(folder / "in/report.txt")) == n and pipeline.store.count() == n
    done = {r.source: r.n_chunks for r in pipeline.ingest_directory(str(folder / "in")).collect()}
    assert done == {"report.txt": n, "odd name.txt": 1, "blank.txt": 0, "none.txt": 0}
    again = {r.source: r.n_chunks for r in pipeline.ingest_directory(str(folder / "in"), recursive=True, resume=True).collect()}
    assert again == {"blank.txt": 0, "none.txt": 0, "deep.txt": 1}
    row = pipeline.ask("  quel résultat du rapport ? ").first()
    assert len(row.sources) == 2 and "[1] Source : " in row.text and row.status == "ok"
    with pytest.raises(ValueError):
        pipeline.ask(" ")
    many = spark.createDataFrame([("1", "rapport"), ("2", " ")], "question_id string, question string")
    assert {r.question_id: r.status for r in pipeline.ask_many(many).collect()} == {"1": "ok", "2": "empty"}
    pipeline.store.delete_source("report.txt")
    assert pipeline.status() == (2, ["deep.txt", "odd name.txt"])
    pipeline.store.reset()
    assert pipeline.store.count() == 0
    assert pipeline.ask("rapport").first().text.startswith("Aucun document")
    pipeline.store.drop()


def test_collection_rules(spark, tmp_path):
    root = str(tmp_path / "c")
    store = Collection(spark, root, 2)
    with pytest.raises(ValueError):
        Collection(spark, root, 3)
    row = "source string, index int, text string, line_start int, line_end int, vector array<double>, seq int"
    first = spark.createDataFrame([("a", 0, "old", 1, 1, [1.0, 2.0], 1), ("a", 1, "tail", 1, 1, [1.0, 2.0], 2), ("a", 0, "new", 1, 1, [3.0, 2.0], 3)], row)
    assert store.add(first, order="seq") == 2 and {r.text for r in store.rows().collect()} == {"new", "tail"}
    short = spark.createDataFrame([("a", 0, "short", 1, 1, [1.0, 1.0], 1)], row)
    assert store.add(short) == 1 and store.count() == 2  # the earlier tail stays
    assert store.add(short, replace_sources=True) == 1 and store.count() == 1
    assert store.add(short.where("false")) == 0 and store.page().count() == 1
    version = store.version()
    with pytest.raises(Exception, match="components"):
        store.add(spark.createDataFrame([("b", 0, "x", 1, 1, [1.0], 1)], row))
    assert store.version() == version and Collection(spark, root, 2).count() == 1


ROW = "source string, index int, text string, line_start int, line_end int, vector array<double>"


def files_of(root):
    return {str(p.relative_to(root)) for p in root.rglob("*.parquet")}


def bytes_of(root):
    return sum(p.stat().st_size for p in root.rglob("*.parquet"))


def test_a_change_writes_in_proportion(spark, tmp_path, monkeypatch):
    store = Collection(spark, str(tmp_path / "c"), 1)
    rows = lambda text, names: spark.createDataFrame([(n, i, f"{text} {n} {i} " + hashlib.md5(f"{n}{i}{text}".encode()).hexdigest() * 20, 1, 1, [1.0]) for n in names for i in range(3)], ROW)
    names = [f"n{i}" for i in range(400)]
    store.add(rows("old", names))
    before, whole = files_of(tmp_path / "c"), bytes_of(tmp_path / "c")
    store.add(rows("new", ["n7"]))
    assert before <= files_of(tmp_path / "c") and bytes_of(tmp_path / "c") - whole < whole / 10
    assert {(r.source, r.text.split()[0]) for r in store.rows().collect()} == {(n, "new" if n == "n7" else "old") for n in names}
    whole = bytes_of(tmp_path / "c")
    store.delete_source("n7")
    assert 0 < bytes_of(tmp_path / "c") - whole < 10_000
    version = store.version()
    store.delete_source("never seen")
    assert store.version() == version and store.count() == 1197 == store.rows().count()
    assert {r.source for r in store.sources().collect()} == set(names) - {"n7"}
    store.add(rows("again", ["n7", "n8"]), replace_sources=True)
    want = sorted((r.id, r.text) for r in store.rows().collect())
    assert store.count() == 1200
    store.compact()
    assert len(store.manifest()["runs"]) == 1 and not store.manifest()["deletes"]
    assert sorted((r.id, r.text) for r in store.rows().collect()) == want and store.count() == 1200
    store.compact()  # nothing to do
    monkeypatch.setattr("chunkweave.sources.collection.GRACE", 0.0)
    for i in range(2):  # old files go, those of the last manifests stay
        store.add(rows(f"turn {i}", ["n1"]))
    kept = [store.manifest(n) for n in range(store.version() - 1, store.version() + 1)]
    assert {p.name for p in (tmp_path / "c/data").iterdir()} == {r for m in kept for r in m["runs"]}
    assert len(list((tmp_path / "c/manifests").glob("[0-9]*.json"))) == 2 and store.count() == 1200


def test_pages_read_few_files(spark, tmp_path):
    store = Collection(spark, str(tmp_path / "c"), 1)
    rows = spark.createDataFrame([(f"n{i}", 0, "t", 1, 1, [1.0]) for i in range(2000)], ROW)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        store.add(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    store.delete_source("n5")
    ids, after, pages = sorted(r.id for r in store.rows().collect()), "", []
    while True:
        page = store.page(after, 100)
        found = [r.id for r in page.collect()]
        if not found:
            break
        pages.append(found)
        assert len(store.page_files(after, 100)) <= 3 and len(page.inputFiles()) <= 3
        after = found[-1]
    assert [i for p in pages for i in p] == ids and len(pages) == 20 and len(files_of(tmp_path / "c/data")) >= 12
    store.add(rows.where("source = 'n9'").withColumn("text", F.lit("new")))
    assert [r.id for r in store.page("", 5000).collect()] == ids


@pytest.mark.parametrize("step", ["mkdirs", "create", "publish", "write", "expire"])
def test_a_change_that_dies_changes_nothing(spark, tmp_path, monkeypatch, step):
    """Whatever step a job dies in, the collection opens and reads as before, or, once the manifest is there, as after."""
    root = str(tmp_path / "c")

    def dies(*_, **__):
        raise KeyboardInterrupt

    row = lambda text: spark.createDataFrame([("a", 0, text, 1, 1, [1.0])], ROW)
    target, name = {"mkdirs": (Files, "under"), "create": (Files, "create"), "publish": (Collection, "_publish"), "write": (Collection, "_placed"), "expire": (Collection, "_expire")}[step]
    with monkeypatch.context() as broken:  # while it is created
        broken.setattr(target, name, dies)
        with pytest.raises(KeyboardInterrupt):
            Collection(spark, root, 1).add(row("lost"))
    store = Collection(spark, root, 1)
    assert store.count() == 0
    store.add(row("old"))
    with monkeypatch.context() as broken:
        broken.setattr(target, name, dies)
        with pytest.raises(KeyboardInterrupt):
            store.add(row("new"))
    store = Collection(spark, root, 1)
    assert [r.text for r in store.rows().collect()] == ["new" if step == "expire" else "old"]
    store.add(row("newer"))
    assert [r.text for r in Collection(spark, root, 1).rows().collect()] == ["newer"]


def test_two_writers(spark, tmp_path, monkeypatch):
    """A name is taken once. Of two changes at a time the second comes after the first, whether they meet in a source or not."""
    root = str(tmp_path / "c")
    store, other = Collection(spark, root, 1), Collection(spark, root, 1)
    with pytest.raises(FileExistsError):
        store._publish(store.version() - 1, store.manifest())
    row = lambda name, text: spark.createDataFrame([(name, i, text, 1, 1, [1.0]) for i in range(2)], ROW)
    store.add(row("a", "first"))
    publish, turns = Collection._publish, []

    def late(self, version, manifest):
        """Before the change of one is published, the other's is."""
        if self is store and not turns:
            turns.append(1)
            other.add(row("b", "other"))
            other.add(row("a", "other"))
        publish(self, version, manifest)

    monkeypatch.setattr(Collection, "_publish", late)
    store.add(row("a", "last"))
    assert sorted((r.source, r["index"], r.text) for r in store.rows().collect()) == [("a", 0, "last"), ("a", 1, "last"), ("b", 0, "other"), ("b", 1, "other")]
    turns.clear()
    store.delete_source("a")
    assert sorted({(r.source, r.text) for r in store.rows().collect()}) == [("b", "other")] and store.count() == 2
    turns.clear()
    store.compact()
    assert store.count() == store.rows().count() == 4


def test_many_writers_at_once(spark, tmp_path):
    root = str(tmp_path / "c")
    Collection(spark, root, 1)
    add = lambda n: Collection(spark, root, 1).add(spark.createDataFrame([(f"s{n}", 0, "t", 1, 1, [1.0])], ROW))
    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(add, range(6))) == [1] * 6
    assert {r.source for r in Collection(spark, root, 1).sources().collect()} == {f"s{n}" for n in range(6)}


def test_of_equal_names_the_last_path_wins(spark, folder):
    (folder / "in/sub/report.txt").write_text("another report")
    pipeline = small(spark, folder)
    pipeline.ingest_directory(str(folder / "in"), recursive=True)
    texts = {r["index"]: r.text for r in pipeline.store.rows().where("source = 'report.txt'").collect()}
    assert texts[0] == "another report" and len(texts) > 5 and "Ligne" in texts[1]


class Flaky(HashedWords):
    """Fails the first call of each process for a text."""

    seen: set = set()

    def embed(self, texts):
        if not self.seen & set(texts):
            self.seen.update(texts)
            raise OSError("too many requests")
        return super().embed(texts)


def test_a_call_that_fails_once_is_repeated(spark, folder):
    pipeline = Pipeline(spark, str(folder / "store"), Settings(chunk_size=300, chunk_overlap=50, base_delay=0.0), Flaky())
    done = {r.source: r.n_chunks for r in pipeline.ingest_directory(str(folder / "in")).collect()}
    assert done["report.txt"] > 5 and done["odd name.txt"] == 1
    assert len(pipeline.ask("rapport").first().sources) == 4


class Counted(Echo):
    """Writes down each call."""

    def __init__(self, path):
        self.path = path

    def generate(self, prompts, contexts):
        with open(self.path, "a") as f:
            f.write("x" * len(prompts))
        return super().generate(prompts, contexts)

    def in_english(self):
        return English(self.path)


class English(Counted):
    def generate(self, prompts, contexts):
        super().generate(prompts, contexts)
        return ["in English"] * len(prompts)


class Logged(HashedWords):
    """Writes down how many texts each call takes."""

    def __init__(self, path):
        super().__init__()
        self.path = path

    def embed(self, texts):
        with open(self.path, "a") as f:
            f.write("x" * len(texts))
        return super().embed(texts)


def test_each_chunk_is_embedded_once(spark, folder):
    pipeline = Pipeline(spark, str(folder / "store"), Settings(chunk_size=300, chunk_overlap=50), Logged(str(folder / "calls")))
    done = pipeline.ingest_directory(str(folder / "in")).collect()
    assert len((folder / "calls").read_text()) == sum(r.n_chunks for r in done) > 5


def test_a_question_costs_one_call(spark, folder, monkeypatch):
    calls, held = folder / "calls", {*spark.sparkContext._jsc.getPersistentRDDs()}
    pipeline = Pipeline(spark, str(folder / "store"), Settings(chunk_size=300, chunk_overlap=50), generator=Counted(str(calls)))
    pipeline.ingest_directory(str(folder / "in"))
    answer = pipeline.ask("rapport")
    assert answer.first().status == "ok" and answer.count() == 1 and answer.selectExpr("explode(sources)").count() == 4
    assert calls.read_text() == "x"
    assert {*spark.sparkContext._jsc.getPersistentRDDs()} <= held
    (folder / "q.jsonl").write_text('{"question_id": "q", "question": "rapport"}')
    for english, text in ((True, "in English"), (False, "[FAUSSE RÉPONSE]")):
        pipeline.bench(str(folder / "q.jsonl"), str(folder / f"out{english}"), english=english)
        assert [json.loads(x)["answer"][:10] for p in (folder / f"out{english}").glob("answers-*.json") for x in p.read_text().splitlines()] == [text[:10]]


def test_exports():
    import chunkweave

    assert all(getattr(chunkweave, name) for name in chunkweave.__all__)
    with pytest.raises(AttributeError):
        chunkweave.nothing  # noqa: B018


def test_bench_and_resume(spark, folder):
    pipeline = small(spark, folder)
    pipeline.ingest_directory(str(folder / "in"))
    lines = [{"question_id": f"q{i}", "question": f"résultat {i}", "more": 1} for i in range(5)]
    (folder / "q.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\n")
    out = str(folder / "out")
    assert pipeline.bench(str(folder / "q.jsonl"), out, limit=2, resume=True) == 2
    (folder / "out/part-broken.json").write_text('{"question_id": "q2", "answer": \n\n{"answer": "no id"}\n')
    assert pipeline.bench(str(folder / "q.jsonl"), out, limit=2, resume=True) == 2
    assert pipeline.bench(str(folder / "q.jsonl"), out, resume=True) == 1
    rows = [json.loads(x) for p in (folder / "out").glob("answers-*.json") for x in p.read_text().splitlines()]
    assert sorted(r["question_id"] for r in rows) == ["q0", "q1", "q2", "q3", "q4"]
    assert all(set(r) == {"question_id", "answer", "document_ids"} and 1 <= len(r["document_ids"]) <= 10 for r in rows)
    assert text_files.answered(spark, str(folder / "missing")).count() == 0
    (folder / "bad.jsonl").write_text("{broken")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        text_files.questions(spark, str(folder / "bad.jsonl")).collect()


def answers_in(out):
    return [json.loads(x)["question_id"] for p in out.glob("answers-*.json") for x in p.read_text().splitlines()]


def test_a_bench_that_dies_goes_on(spark, folder, monkeypatch):
    """After some batches the run dies, before or after a commit; the next one writes the rest, and nothing twice."""
    pipeline = small(spark, folder)
    pipeline.ingest_file(str(folder / "in/report.txt"))
    (folder / "q.jsonl").write_text("\n".join(json.dumps({"question_id": f"q{i:02d}", "question": f"résultat {i}"}) for i in range(24)))
    commit, turns, out = text_files.commit_answers, [], folder / "out"

    def dies(answers, path):
        turns.append(1)
        if len(turns) == 3:
            raise KeyboardInterrupt
        commit(answers, path)
        if len(turns) == 5:
            raise KeyboardInterrupt

    monkeypatch.setattr(text_files, "commit_answers", dies)
    held = []
    for _ in range(2):
        with pytest.raises(KeyboardInterrupt):
            pipeline.bench(str(folder / "q.jsonl"), str(out), resume=True, batch=6)
        held.append(len(answers_in(out)))
        assert len(set(answers_in(out))) == held[-1] and not list(out.glob("_work*/*.json"))
    assert 0 < held[0] < held[1] < 24
    assert pipeline.bench(str(folder / "q.jsonl"), str(out), resume=True, batch=6) == 24 - held[1]
    assert sorted(answers_in(out)) == [f"q{i:02d}" for i in range(24)]
    assert pipeline.bench(str(folder / "q.jsonl"), str(out), resume=True, batch=6) == 0


def test_two_benches_at_once_write_no_answer_twice(spark, folder, monkeypatch):
    pipeline = small(spark, folder)
    pipeline.ingest_file(str(folder / "in/report.txt"))
    (folder / "q.jsonl").write_text("\n".join(json.dumps({"question_id": f"q{i}", "question": f"résultat {i}"}) for i in range(6)))
    named, other = Files._named, []

    def late(self, new, name):
        if name.startswith("answers-") and not other:
            other.append(1)
            assert small(spark, folder).bench(str(folder / "q.jsonl"), str(folder / "out"), limit=4, resume=True) == 4
        named(self, new, name)

    monkeypatch.setattr(Files, "_named", late)
    assert pipeline.bench(str(folder / "q.jsonl"), str(folder / "out"), resume=True) == 2
    assert sorted(answers_in(folder / "out")) == [f"q{i}" for i in range(6)]


def test_search_in_some_sources_reads_their_files(spark, folder):
    pipeline = small(spark, folder)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pipeline.ingest_directory(str(folder / "in"), recursive=True).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        pipeline.release()
    asked = spark.createDataFrame([("1", "résultat du rapport"), ("2", "deep text")], "question_id string, question string")
    some = pipeline.store.rows_from(["deep.txt", "no such"])
    assert {r.source for r in some.collect()} == {"deep.txt"} and len(some.inputFiles()) == 1 < len(pipeline.store.rows().inputFiles())
    got = {(h.question_id, h.source, h["index"], h.score) for h in pipeline.hits(asked, 3, ["deep.txt"]).collect()}
    whole = {(h.question_id, h.source, h["index"], h.score) for h in pipeline.hits(asked, 100).collect()}
    assert got == {h for h in whole if h[1] == "deep.txt"}
    assert pipeline.hits(asked, 3, ["no such"]).count() == 0
    pipeline.release()


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"corpus": "c", "graine": 0, "attendus": ["a"], "repartition": {"x": 1}}, indent=1))
    assert text_files.manifest(spark, str(tmp_path / "m.json")).first().attendus == ["a"]


def test_stream_ingests_new_files(spark, folder):
    pipeline = small(spark, folder)
    for _ in range(2):
        query = ingest_stream(spark, pipeline, str(folder / "in"), str(folder / "checkpoint"))
        assert query.awaitTermination(120)
    assert set(pipeline.status()[1]) == {"report.txt", "odd name.txt"}
    (folder / "in/later.txt").write_text("later text")
    ingest_stream(spark, pipeline, str(folder / "in"), str(folder / "checkpoint")).awaitTermination(120)
    assert "later.txt" in pipeline.status()[1]


def test_commands(spark, folder, capsys, monkeypatch):
    root = ["--root", str(folder / "store")]
    assert main([*root, "ingest", str(folder / "in"), "-r"]) == 0
    assert main([*root, "ingest", str(folder / "in/UPPER.TXT")]) == 0
    assert main([*root, "ask", "rapport", "--top-k", "1"]) == 0
    assert main([*root, "status"]) == 0
    assert main([*root, "index", "--cells", "2", "--top-k", "3"]) == 0 and main([*root, "compact"]) == 0
    shown = capsys.readouterr().out
    assert "report.txt: " in shown and "[1] " in shown and "UPPER.TXT" in shown and " (score 0." in shown and "probes: " in shown and "Runs: 1" in shown
    assert main([*root, "reset"]) == 0
    monkeypatch.setenv("TOP_K", "x")
    assert main([*root, "status"]) == 1
