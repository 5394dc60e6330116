import re

import numpy as np
import pytest
from chunkweave.operators.search import search
from chunkweave.sources import index
from chunkweave.sources.collection import Collection
from chunkweave.sources.index import VectorIndex

ROW = "source string, index int, text string, line_start int, line_end int, vector array<double>"


def clustered(n=1200, clusters=20, d=16, seed=2):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(clusters, d))
    return [(centers[i % clusters] + 0.15 * r.normal(size=d)).tolist() for i in range(n)]


def rows_of(spark, vectors, first=0):
    return spark.createDataFrame([(f"s{first + i:05d}", 0, "t", 1, 1, v) for i, v in enumerate(vectors)], ROW)


def recall(store, kept, asked, k, **options):
    exact = {(h.question_id, h.source) for h in search(store.rows().drop("id"), asked, k).collect()}
    got = kept.search(asked, k, **options).collect()
    assert len({(h.question_id, h.rank) for h in got}) == len(got) and max(h.rank for h in got) == k
    return len({(h.question_id, h.source) for h in got} & exact) / len(exact), got


def test_index_finds_nearly_all_in_few_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "ROWS", 50)  # cells in several parts
    vectors = clustered()
    store = Collection(spark, str(tmp_path / "c"), 16)
    store.add(rows_of(spark, vectors))
    asked = spark.createDataFrame([(i, vectors[i]) for i in range(0, 1200, 20)], "question_id long, vector array<double>")
    kept = VectorIndex(store)
    kept.build(cells=20)
    probes = kept.tuned(10)
    share, got = recall(store, kept, asked, 10)
    assert share >= 0.95 and probes <= 5
    exact = {(h.question_id, h.source): h.score for h in search(store.rows().drop("id"), asked, 10).collect()}
    assert all(abs(h.score - exact[h.question_id, h.source]) < 2e-6 for h in got if (h.question_id, h.source) in exact)
    one = spark.createDataFrame([("q", vectors[3])], "question_id string, vector array<double>")
    cells = kept.model(store.manifest()).probed(np.array([vectors[3]]), 2)[0].tolist()
    plan = kept._codes(store.manifest(), cells)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN", plan)  # folders of other cells are not read
    assert kept.search(one, 3, probes=2).first().score == pytest.approx(1.0)


def test_index_follows_its_collection(spark, tmp_path):
    """Deleted rows fall out, rows that came later are found exactly, and a build takes them in; so after a compaction."""
    vectors = clustered(400)
    store = Collection(spark, str(tmp_path / "c"), 16)
    VectorIndex(store).build()  # nothing there
    nobody = spark.createDataFrame([(1, vectors[0])], "question_id long, vector array<double>")
    assert not VectorIndex(store).search(nobody).collect() and not VectorIndex(store).within(nobody, 0.5).collect()
    store.add(rows_of(spark, vectors[:300]))
    kept = VectorIndex(store)
    kept.build(cells=8)
    kept.tuned(5, 1.0)
    asked = spark.createDataFrame([(i, vectors[i]) for i in (0, 7, 350)], "question_id long, vector array<double>")
    assert recall(store, kept, asked, 5)[0] >= 0.9
    store.delete_source("s00007")
    store.add(rows_of(spark, vectors[300:], 300))
    for turn in range(3):
        share, got = recall(store, kept, asked, 5)
        assert share >= 0.9 and "s00007" not in {h.source for h in got}
        assert {h.question_id: h.source for h in got if h.rank == 1}[350] == "s00350"
        if turn == 0:
            kept.build()
            assert set(store.manifest()["index"]["runs"]) == set(store.manifest()["runs"])
        if turn == 1:
            store.compact()
            kept.build()
    assert len(store.manifest()["index"]["runs"]) == 1


def exactly(store, asked, threshold, k):
    return {(h.question_id, h.rank, h.source, round(h.score, 5)) for h in search(store.rows().drop("id"), asked, k, threshold).collect()}


def hits_of(found):
    rows = found.collect()
    got = {(h.question_id, h.rank, h.source, round(h.score, 5)) for h in rows}
    assert len(got) == len(rows)
    return got


def test_threshold_search_by_rings_is_exact(spark, tmp_path, monkeypatch):
    """Ties, zeros, null vectors, deleted and late rows: the same hits as a scan; of 20 clusters few cells are reached, and no other folder is read."""
    monkeypatch.setattr(index, "ROWS", 50)
    monkeypatch.setattr(index, "QUESTIONS", 7)  # questions in several blocks
    vectors = clustered() + [[0.0] * 16, clustered()[5], clustered()[5]]
    store = Collection(spark, str(tmp_path / "c"), 16)
    store.add(rows_of(spark, vectors))
    kept = VectorIndex(store)
    kept.build(cells=20)
    named = [(i, vectors[i]) for i in range(5, 1200, 60)] + [(-1, [0.0] * 16), (-2, None), (-3, [-x for x in vectors[0]])]
    asked = spark.createDataFrame(named, "question_id long, vector array<double>")
    for threshold, k in ((0.95, 10), (0.5, 100), (0.01, 3), (1.0, 4), (1.5, 4)):
        assert hits_of(kept.within(asked, threshold, k)) == exactly(store, asked, threshold, k), (threshold, k)
    one = asked.where("question_id = 5")
    assert kept.reached(one, 0.95).count() <= 5 and kept.reached(one, 0.01).count() > 5
    with pytest.raises(ValueError):
        kept.within(asked, 0.0)
    store.delete_source("s00005")
    store.add(rows_of(spark, vectors[:40], 5000))  # not indexed yet
    got = hits_of(kept.within(asked, 0.9, 10))
    assert got == exactly(store, asked, 0.9, 10) and any(h[2] >= "s05000" for h in got) and "s00005" not in {h[2] for h in got}
    store._expire()
    assert set(store.files.children("index")) >= {f"{i}-rings" for i in store.manifest()["index"]["runs"].values()}


def test_files_of_a_cell_are_sorted_by_angle(spark, tmp_path):
    store = Collection(spark, str(tmp_path / "c"), 16)
    store.add(rows_of(spark, clustered(400)))
    kept = VectorIndex(store)
    kept.build(cells=4)
    manifest = store.manifest()
    rows = kept._codes(manifest, None).select("cell", "angle", "_metadata.file_name", "_metadata.row_index").collect()
    by_file = {}
    for r in sorted(rows, key=lambda r: r.row_index):
        by_file.setdefault((r.cell, r.file_name), []).append(r.angle)
    assert len(rows) == 400 and all(a == sorted(a) for a in by_file.values())


def test_many_questions_meet_groups_of_cells(spark, tmp_path, monkeypatch):
    """Many questions find what an exact search of all cells finds; their vectors travel once for each group of cells, not once for each cell."""
    monkeypatch.setattr(index, "SENT_BYTES", 0)
    vectors = clustered()
    store = Collection(spark, str(tmp_path / "c"), 16)
    store.add(rows_of(spark, vectors))
    kept = VectorIndex(store)
    kept.build(cells=20)
    asked = spark.createDataFrame([(i, vectors[i]) for i in range(0, 1200, 5)], "question_id long, vector array<double>")
    assert hits_of(kept.search(asked, 10, probes=20)) == exactly(store, asked, None, 10)
    assert recall(store, kept, asked, 10, probes=5)[0] >= 0.95
    monkeypatch.setattr(index, "ROWS", 50)
    monkeypatch.setattr(index, "QUESTIONS", 100)
    monkeypatch.setattr(index, "HELD", 20)
    assert hits_of(kept.search(asked, 10, probes=20)) == exactly(store, asked, None, 10)
    assert kept.reached(asked, 0.01).columns == ["question_id", "cell"]
