import random
import re

import pytest
from chunkweave.llm import quality_rules as q

from .cases import documents, found_words, key, rows


def brute(text):
    t = text or ""
    w = found_words(t)
    spans = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    held = set()
    for i, s in enumerate(spans):
        if spans.count(s) > 1 if len(spans) < 400 else s in (spans[i - 1 : i] + spans[i + 1 : i + 2]) or spans.count(s) > 1:
            held |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if found_words(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(held))


@pytest.mark.parametrize("place", [24, 61, 3])
def test_counts_match_brute_force(spark, monkeypatch, place):
    """61 leaves three bits of hash, so that unequal windows clash; 3 leaves room for eight windows."""
    monkeypatch.setattr(q, "PLACE", place)
    given = rows() + [(50, "a b c a b c a b", "en", "s", 1, "", 1, "", 0.0), (51, "a a a a", None, None, 1, "", 1, "", 0.0), (52, "x y z\nx y z\n\n x\nx y z ü|<#", None, None, 1, "", 1, "", 0.0)]
    got = q.judged(q.document_stats(documents(spark, given)), []).collect()
    want = []
    for r in given:
        s = brute(r[1])
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        want.append((r[0], *s, failed, not failed))
    mine = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got]
    assert sorted(mine, key=key) == sorted(want, key=key)


def corpus(n, seed):
    r = random.Random(seed)
    out, labels = [], []
    for i in range(n):
        w = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(80)]
        bad = r.random() < 0.3
        if bad:
            w = [x + "***" for x in w] if r.random() < 0.5 else [x.upper() + "!!" for x in w]
        out.append((i, " ".join(w), "en", "s", 1, "", 1, "", 0.0))
        labels.append((i, None if i % 97 == 0 else int(not bad), 0, bad))
    return out, labels


def test_learns_on_some_and_judges_others(spark):
    given, labels = corpus(600, 1)
    known = spark.createDataFrame([x[:3] for x in labels] + [(None, 1, 0), (10**6, 0, 0), labels[5][:3]], "doc_id long, quality int, toxic int")
    rules = q.learn_from(q.document_stats(documents(spark, given)), known)
    assert 1 <= len(rules) <= 8
    given, labels = corpus(400, 2)
    got = {r.doc_id: r for r in q.judged(q.document_stats(documents(spark, given)), rules).collect()}
    bad = [i for i, *_, bad in labels if bad]
    assert sum(not got[i].kept for i in bad) >= 0.95 * len(bad)
    assert all(got[i].kept for i, *_, bad in labels if not bad)
    assert all((got[i].rule is None) == got[i].kept for i in got)
    kept = q.kept_documents(documents(spark, given), rules)
    assert kept.columns == documents(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {i for i in got if got[i].kept}


@pytest.mark.parametrize("least", [0.4, 0.05])
def test_finds_a_rare_kind_of_bad_documents(spark, least):
    """An eighth of the bad documents has many symbols, the others none; clean ones have some."""
    r = random.Random(4)
    given = []
    for i in range(4000):
        good = i % 4 > 0
        rare = not good and i % 32 == 0
        share = round(r.uniform(least, 0.4) if rare else r.uniform(0, 0.02) if good else 0.0, 3)
        given.append((share, 0.0, 0.0, 0.0, 0.0, 5.0, int(good), int(i % 3 == 2), rare))
    labelled = spark.createDataFrame(given, ", ".join(f"{f} double" for f in q.FEATURES) + ", good int, fold int, rare boolean")
    assert all(len(c) < q.BINS for c in q.cut_points(labelled).values())
    assert any(0.02 < c < least for c in q.cut_points(labelled)["symbol_share"])
    rules = q.learn(labelled)
    caught = lambda x: any(all((x > c) == (op == ">") for f, op, c in rule if f == "symbol_share") for rule in rules)
    assert all(caught(x[0]) for x in given if x[-1])
    assert not any(caught(x[0]) for x in given if x[0] and not x[-1])


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert q.learn_from(q.document_stats(documents(spark)), none) == []
    assert q.learn_from(q.document_stats(documents(spark, [])), none) == []
    assert q.judged(q.document_stats(documents(spark, [])), []).count() == 0
