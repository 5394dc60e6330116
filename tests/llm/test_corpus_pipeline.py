"""Each stage of the pipeline on its own input, against brute force."""

import hashlib
import os
import random
from collections import Counter

import corpus_pipeline
import pytest
from chunkweave.llm import budget_mix, quality_rules
from chunkweave.llm.common import shared_folder
from chunkweave.llm.tokens import default_vocabulary, word_ids
from pyspark.sql import functions as F

from .cases import found_words
from .test_quality import brute as counts
from .test_simhash import jaccard
from .test_substring import brute as substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def given():
    r = random.Random(11)
    v = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(900)]
    say = lambda n: " ".join(r.choice(v) for _ in range(n))
    passage = say(60)
    texts = [say(r.choice([10, 60, 90, 200])) for _ in range(90)]
    texts += [t + " tail" for t in texts[:15]] + texts[15:25]  # near and exact copies
    texts += [say(50) + "\n" + passage + "\n" + say(50) for _ in range(12)]
    texts += [" ".join(w + "***" for w in say(70).split()) for _ in range(40)]
    texts += [None, "", "same words here " * 40, say(5000)]
    return [(i, t, r.choice(["en", "de"]), r.choice(["src0", "src0", "src0", "src1", None]), len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = given()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int("***" not in (t or "")), 0) for i, t, *_ in rows if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        after = spark.read.parquet(f"{folder}/stage{k}")
        out.append((docs, after))
        docs = after
    return folder, out


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "repeated passages", "mix to weights", "best-fit packing"]
    for before, after in stages[1][:-1]:
        assert before.columns == after.columns


def test_quality_stage(stages):
    before, after = stages[1][0]
    fine = lambda t: (lambda s: s[0] >= 50 and 100 * s[4] <= 50 * s[0] and "***" not in t)(counts(t)) if t else False
    assert bag(after) == Counter(tuple(r) for r in before.collect() if fine(r.text))


def test_near_duplicate_stage(stages):
    before, after = (x.collect() for x in stages[1][1])
    assert len({r.doc_id for r in after}) == len(after) < len(before)
    assert all(jaccard(a.text, b.text) < 0.8 for i, a in enumerate(after) for b in after[:i])
    ids = {r.doc_id for r in after}
    assert all(any(jaccard(r.text, k.text) >= 0.8 and k.doc_id < r.doc_id for k in after) for r in before if r.doc_id not in ids)


def test_passage_stage(stages):
    before, after = (x.collect() for x in stages[1][2])
    want = {i: (n - gone, sha) for i, n, gone, sha in substrings([tuple(r) for r in before])}
    assert {r.doc_id: (len(found_words(r.text)), hashlib.sha256(" ".join(found_words(r.text)).encode()).hexdigest()) for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)
    assert any(a != len(found_words(r.text)) for r in before for a, _ in [want[r.doc_id]])


def test_mix_stage(stages):
    before, after = stages[1][3]
    times = {r.doc_id: r.times for r in budget_mix.mixed(before, budget_mix.n_words(F.col("text"))).collect()}
    assert Counter(r.doc_id for r in after.collect()) == Counter({i: n for i, n in times.items() if n})
    assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in before.collect()}


def test_mix_stage_meets_its_targets(stages):
    """Against targets filled up here: sources in order weigh 1, 2, 3, 1, ...; none gets more than 3 times its words."""
    before, after = (x.collect() for x in stages[1][3])
    size, taken, copies = Counter(), Counter(), Counter()
    for r in before:
        size[r.source] += len(found_words(r.text))
    for r in after:
        taken[r.source] += len(found_words(r.text))
        copies[r.doc_id] += 1
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, rest, left = {}, set(order), sum(size.values())
    while over := [s for s in rest if left * weight[s] / sum(weight[x] for x in rest) >= 3 * size[s]]:
        target |= {s: 3 * size[s] for s in over}
        rest -= set(over)
        left = sum(size.values()) - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
    shortest = min(len(found_words(r.text)) for r in before if found_words(r.text))
    assert all(abs(taken[s] - target[s]) <= shortest for s in order)
    assert max(copies.values()) <= 3
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_packing_stage_and_whole_run(spark, stages):
    folder, out = stages
    before, after = out[4]
    encoder = word_ids(default_vocabulary()).whole
    want = Counter()
    for r in before.collect():
        n = len(encoder.encode(r.text or "", add_special_tokens=False).ids) + 1
        want.update((r.doc_id, k, min(4096, n - at)) for k, at in enumerate(range(0, n, 4096)))
    assert Counter((r.doc_id, r.piece, r.length) for r in after.collect()) == want
    assert corpus_pipeline.ORACLE_SQL is None
    whole = corpus_pipeline.run(spark, folder)
    assert Counter((r.doc_id, r.piece, r.length) for r in whole.collect()) == want


def test_further_columns_and_no_leftovers(spark, stages, tmp_path):
    """Columns whose names need quoting pass through every stage but the last; run() leaves its result alone behind."""
    folder, _ = stages
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id % 2 = 0 or doc_id > 110")
    docs = docs.withColumns({"my col": F.col("doc_id") + 1, "a.b": F.lit("x"), "node": F.lit(2.5), "row": F.array("lang"), "size": F.lit("s")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        after = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert after.columns == docs.columns
        assert after.where(F.col("`my col`") != F.col("doc_id") + 1).count() == 0 and after.where("`a.b` = 'x'").count() == after.count() > 0
        docs = after
    shared = shared_folder(spark)
    left = lambda: {n for n in os.listdir(shared.removeprefix("file:")) if n.startswith(("working-", "pipeline-"))}
    before = left()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= docs.count()
    assert len(left() - before) == 1


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rules_read_as_conditions(spark):
    expression = quality_rules.verdict([[("symbol_share", ">", 0.1), ("upper_share", "<=", 0.5)], [("mean_length", ">", 20.0)]])
    assert str(expression).count("WHEN") == 2
