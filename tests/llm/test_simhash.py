import random

import numpy as np
import pytest
import xxhash
from chunkweave.llm import simhash
from pyspark.sql import functions as F

from .cases import documents, found_words, key, rows


def fingerprint(text, shingle):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = found_words(low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """Brute force over all pairs of different fingerprints."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("shingle", [3, 5])
def test_matches_brute_force(spark, shingle):
    given = rows()
    fps = [fingerprint(r[1], shingle) for r in given]
    part = components(fps)
    first = {}
    for r, f in zip(given, fps, strict=True):
        if r[0] is not None:
            first[part[f]] = min(first.get(part[f], r[0]), r[0])
    want = sorted(((r[0], f"{f:016x}", first.get(part[f])) for r, f in zip(given, fps, strict=True)), key=key)
    got = simhash.near_duplicates(documents(spark), shingle=shingle)
    assert sorted(map(tuple, got.collect()), key=key) == want


def test_hash_is_sparks_own(spark):
    rows = [(s,) for s in ("", "a", "one two three", "été 漢字 " * 9)]
    for s, h in spark.createDataFrame(rows, "s string").select("s", F.xxhash64("s")).collect():
        assert xxhash.xxh64_intdigest(s.encode(), 42) == h % 2**64


def test_links_of_crowded_fingerprints(spark):
    r = random.Random(5)
    fps = set()
    for _ in range(12):
        center = r.getrandbits(64)
        fps |= {center ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, 4))}) for _ in range(60)}
    fps |= {r.getrandbits(64) for _ in range(200)} | {0, 1, 3, 2**64 - 1, 2**64 - 2}
    signed = [(f - 2**64 if f >> 63 else f,) for f in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"))
    labels = {n % 2**64: x % 2**64 for n, x in simhash.min_labels(links).collect()}
    mine = {}
    for f in fps:
        mine.setdefault(labels.get(f, f), set()).add(f)
    want = {}
    for f, c in components(fps).items():
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))
    assert all((a ^ b) % 2**64 and ((a ^ b) % 2**64).bit_count() <= 4 for a, b in links.collect())


def jaccard(a, b, shingle=5):
    sets = []
    for t in (a, b):
        w = found_words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_keep_one_of_each_group(spark):
    r = random.Random(3)
    given = rows()
    for i in range(20):
        w = [f"w{r.randrange(5000)}" for _ in range(120)]
        given.append((5000 + i, " ".join(w), "en", "s", 1, "", 1, "", 0.0))
        for j in range(3):
            v = w.copy()
            v[r.randrange(120)] = "changed"
            given.append((6000 + 10 * i + j, " ".join(v), "en", "s", 1, "", 1, "", 0.0))
    docs = documents(spark, given)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    texts = [k.text for k in kept]
    assert all(jaccard(a, b) < 0.8 for i, a in enumerate(texts) for b in texts[:i])
    assert all(any(jaccard(g[1], t) >= 0.8 for t in texts) for g in given)
    assert {5000 + i for i in range(20)} <= {k.doc_id for k in kept} and not any((k.doc_id or 0) >= 6000 for k in kept)
    for k in kept:  # the smallest id of equal texts stays
        same = [g[0] for g in given if g[1] == k.text]
        assert k.doc_id == min((x for x in same if x is not None), default=None)


@pytest.mark.parametrize("block", [1 << 18, 3000])
def test_copies_edited_apart_meet_their_original(spark, monkeypatch, block):
    """Each copy resembles the original, but hardly any other copy. Blocks of 3000 shingles cut the buckets."""
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    r = random.Random(8)
    w = [f"w{r.randrange(5000)}" for _ in range(120)]
    texts = [" ".join(w)]
    for i in range(300):
        v = w.copy()
        for at in r.sample(range(10, 110), 2):
            v[at] = f"new{i}x{at}"
        texts.append(" ".join(v))
    assert all(jaccard(t, texts[0]) >= 0.8 for t in texts) and jaccard(texts[1], texts[2]) < 0.8
    kept = simhash.keep_one(documents(spark, [(i, t, "en", "s", 1, "", 1, "", 0.0) for i, t in enumerate(texts)]))
    assert [k.doc_id for k in kept.collect()] == [0]


@pytest.mark.parametrize(("block", "spread"), [(1 << 18, 64), (3000, 64), (3000, 1)])
def test_family_without_its_original(spark, monkeypatch, block, spread):
    """Copies with one to three words changed; the text they come from is not there. What stays is one of each component, as all pairs say."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SPREAD", spread)
    r = random.Random(3)
    w = [f"w{r.randrange(9000)}" for _ in range(120)]
    texts = []
    for _ in range(160):
        v = w.copy()
        for at in r.sample(range(120), r.choice([1, 2, 2, 2, 3])):
            v[at] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(v))
    root = list(range(len(texts)))

    def top(i):
        return i if root[i] == i else top(root[i])

    links = [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts[:i]) if jaccard(a, b) >= 0.8]
    for i, j in links:
        a, b = top(i), top(j)
        root[max(a, b)] = min(a, b)
    kept = simhash.keep_one(documents(spark, [(i, t, "en", "s", 1, "", 1, "", 0.0) for i, t in enumerate(texts)]))
    assert len(links) > 200 and sorted(k.doc_id for k in kept.collect()) == sorted({top(i) for i in range(len(texts))})


def test_unlike_members_of_a_bucket_do_not_meet(spark, monkeypatch):
    """4,000 sets that share a third of their shingles, all in one bucket, and two stragglers that resemble a member each: linear in rows, and no link is lost."""
    monkeypatch.setattr(simhash, "BLOCK", 1000)
    r = np.random.default_rng(4)
    common = r.integers(-(1 << 62), 1 << 62, 20)
    sets = [np.unique(np.concatenate((common, r.integers(-(1 << 62), 1 << 62, 40)))) for _ in range(4000)]
    for i in (7, 3000):
        sets.append(np.unique(np.concatenate((sets[i][3:], r.integers(-(1 << 62), 1 << 62, 2)))))
    held = spark.createDataFrame([(i, [1], [int(x) for x in s]) for i, s in enumerate(sets)], "node long, keys array<long>, held array<long>").checkpoint()
    led = held.selectExpr("node", "bigint(size(held)) as size", "1L as key")
    groups, compared = [], simhash.compared
    monkeypatch.setattr(simhash, "compared", lambda members, *rest: groups.append(members.count()) or compared(members, *rest))
    links = simhash.rest_links(led, held, spark.createDataFrame([], "node long, label long"), 0.8).collect()
    assert {tuple(sorted((x.a, x.b))) for x in links} == {(7, 4000), (3000, 4001)} and sum(groups) < 200


def test_equal_rows_stay_once(spark):
    """Many copies of one row, rows of one id and text that differ elsewhere, and columns that need quoting or cannot be hashed."""
    given = [(None, "one text", 1, {"a": 1})] * 50 + [(7, "two words here", i, {"a": i}) for i in range(20)] + [(7, "two words here", 3, {"a": 3})] * 5
    docs = spark.createDataFrame(given, "doc_id long, text string, `my col` int, `a.b` map<string,int>")
    kept = simhash.keep_one(docs).collect()
    assert sorted(k.text for k in kept) == ["one text", "two words here"] and kept[0]["a.b"] is not None
    assert [k.doc_id for k in sorted(kept, key=lambda k: k.text)] == [None, 7]


def test_counts_never_overstate(monkeypatch):
    """The distance of counts by hash is at most the number of shingles that one of two sets has alone."""
    rng = simhash.np.random.default_rng(1)
    for _ in range(200):
        sets = [simhash.np.unique(rng.integers(0, 300, rng.integers(1, 200))) for _ in range(2)]
        a, b = simhash.counters(sets).astype(int)
        assert abs(a - b).sum() <= len(set(sets[0].tolist()) ^ set(sets[1].tolist()))


def test_empty_table(spark):
    none = documents(spark, [])
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
