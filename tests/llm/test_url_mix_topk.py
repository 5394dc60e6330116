import random
import re
from collections import Counter

import numpy as np
import pytest
from chunkweave.llm import budget_mix, cover_tree, url_filter
from pyspark.sql import functions as F

from .cases import documents, found_words, key, rows

URLS = [
    "http://A.Example.org/es/1?x=1#f", "https://example.org/en/12", "https://xexample.org/en/1", "http://org/", "http://a.org", "HTTP://b.COM/fr/x", "http://com/de/", "http://com.net/de/",
    "no url", "", None, "://", "x://y", "a://b://c/d", "http://Évil.COM/de/é?q#z", "http://www.x.net/p/?utm_source=a&b=2&a=1#t", "https://x.net/p?a=1&b=2", "http://m.x.net/p.html", "http://x.net/q",
    "http://a.b\nc.org/es\n/1", "http://x.net#frag", "http://x.net?q=1",
]


def judge(url, listed):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for v, at, under in url_filter.RULES:
        if (host == at or host.endswith("." + at)) and path.startswith(under) and (best is None or len(at + under) > len(best[0])):
            best = (at + under, v)
    return host, path, best and best[0], best[1] if best else "block" if listed else "allow"


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_urls_match_brute_force(spark, most):
    given = [(i, u, "html") for i, u in enumerate(URLS)] + [(None, URLS[0], None), (3, URLS[3], "x"), (3, URLS[3], "x")]
    pages = spark.createDataFrame(given, "page_id long, url string, html string").withColumn("listed", F.lit(5)).withColumn("key", F.lit("k"))
    listed = spark.createDataFrame([("x.net/p?a=1&b=2",), ("x.net/p",), ("none.example/z",)], "key string")
    got = url_filter.judged(url_filter.addresses(pages, []), listed, broadcast_bytes=most).collect()
    bad = {URLS[15], URLS[16], URLS[17]}
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(((i, *judge(u, u in bad)) for i, u, _ in given), key=key)
    assert all(r.bloom_hit for r in got if r.listed)


def test_bloom_filter_has_no_misses_and_few_false_hits(spark):
    listed = spark.range(4000).select(F.concat(F.lit("site/"), "id").alias("key"))
    bloom, blocks = url_filter.bloom_filter(listed, 4000)
    assert blocks == 250
    assert url_filter.possible(listed, bloom, blocks).where("not bloom_hit").count() == 0
    others = spark.range(4000).select(F.concat(F.lit("other/"), "id").alias("key"))
    assert url_filter.possible(others, bloom, blocks).where("bloom_hit").count() < 200


def test_listed_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "an IDIOT"), (2, "http://www.a.net/x/", "idiot"), (3, "http://b.net", "fine idiots"), (4, None, "idiot"), (5, "http://c.net", None)], "page_id long, url string, html string")
    rows = url_filter.addresses(pages, ["idiot"])
    assert [r.key for r in url_filter.listed_urls(rows).collect()] == ["a.net/x"]
    none = url_filter.addresses(pages.where("false"), ["idiot"])
    assert url_filter.judged(none, url_filter.listed_urls(none)).count() == 0
    assert url_filter.judged(url_filter.addresses(pages, []), url_filter.listed_urls(none)).where("verdict = 'allow'").count() == 5


def test_marks_are_learnt_from_labels(spark):
    docs = documents(spark, [(i, t, "en", "s", 1, "x", 1, "y", 0.5) for i, t in [(1, "you Fool, the"), (2, "the FOOL and twit"), (3, "the twit"), (4, "the good"), (5, "good the"), (6, "twit the"), (7, None), (None, "fool"), (8, "fool unlabelled"), (1, "fool again")]])
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 0), (5, 0), (6, 0), (7, 0), (9, 1), (2, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    assert url_filter.learned_marks(docs, labels, share=2, odds=3) == ["fool"]
    assert url_filter.learned_marks(docs, labels, share=2, odds=1) == ["fool", "the", "twit"]
    assert url_filter.learned_marks(docs, labels.where("false")) == [] and url_filter.learned_marks(docs.where("false"), labels) == []


def water(sizes, repeats=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weight.items() if s not in full}
        left = total - sum(full.values())
        share = {s: left * w / sum(rest.values()) for s, w in rest.items()} if rest else {}
        over = [s for s in share if share[s] >= repeats * sizes[s]]
        if not over:
            return full | share
        full |= {s: repeats * sizes[s] for s in over}


def test_mix_meets_its_targets(spark):
    given = rows()
    for seed in range(3):
        r = random.Random(seed)
        given = given + [(2000 + 100 * seed + i, "w " * r.randint(1, 60), "en", r.choice(["src0"] * 6 + ["b", "Z", "ü"]), 1, "", 1, "", 0.0) for i in range(100)]
    docs = documents(spark, given)
    got = budget_mix.mixed(docs, budget_mix.n_words(F.col("text"))).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((g[0], len(found_words(g[1]))) for g in given)
    sizes = Counter()
    for g in given:
        sizes[g[3]] += len(found_words(g[1]))
    want = {sizes[s]: t for s, t in water(sizes).items()}
    assert len(want) == len(sizes)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source_size]) and r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"])
        taken[r.source_size] += r.taken
    for source, total in sizes.items():
        target = want[total]
        passes = min(3, int(target // total)) if total else 0
        reach = 1
        for g in given:
            if g[3] == source and passes < 3:
                reach |= reach << len(found_words(g[1]))
        nearest = min(abs(passes * total + i - target) for i in range(total + 1) if reach >> i & 1)
        assert abs(taken[total] - target) <= nearest + 1, source
    again = budget_mix.mixed(docs.repartition(7), budget_mix.n_words(F.col("text"))).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    copies = budget_mix.mix(docs)
    assert copies.columns == docs.columns
    assert Counter(r.doc_id for r in copies.collect()) == Counter({k: v for k, v in sum((Counter({r.doc_id: r.times}) for r in got), Counter()).items() if v})
    assert budget_mix.mixed(documents(spark, []), budget_mix.n_words(F.col("text"))).count() == 0


def test_reruns_of_a_mix_agree_without_ids(spark):
    """Null and repeated ids, equal sizes, different texts, equal rows: the same texts as often, however the rows lie."""
    given = [(None if i % 3 else 7, f"text number {i % 150}", "en", "a" if i % 4 else "b", 1, "", 1, "", 0.0) for i in range(400)]
    given += [(5, "same row here", "en", "c", 1, "", 1, "", 0.0)] * 90
    docs = documents(spark, given)
    bags = [Counter(map(tuple, budget_mix.mix(docs.repartition(n)).collect())) for n in (1, 3, 8)]
    assert bags[0] == bags[1] == bags[2] and len({b for b in bags[0].values()}) > 1
    taken = Counter(r.text for r in budget_mix.mix(docs, weights=(3, 2, 1), repeats=3).collect())
    assert 0 < taken["same row here"] < 270 and taken["same row here"] % 90  # some of the equal rows once more than others
    times = [r.times for r in budget_mix.mixed(docs, budget_mix.n_words(F.col("text")), (3, 2, 1)).where("doc_id = 5").collect()]
    assert len(times) == 90 and sum(times) == taken["same row here"]


def test_fit_is_exact_where_it_can_be():
    r = np.random.default_rng(0)
    for _ in range(300):
        sizes = np.unique(r.integers(1, 60, r.integers(1, 6)))
        counts = r.integers(1, 5, len(sizes))
        budget = int(r.integers(0, (sizes * counts).sum() + 3))
        take = budget_mix.fit(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        sums = {0}
        for s, c in zip(sizes.tolist(), counts.tolist(), strict=True):
            sums = {x + s * k for x in sums for k in range(c + 1)}
        assert abs(int((take * sizes).sum()) - budget) <= max(min(abs(x - budget) for x in sums), int(sizes.max()) // 2)
    sizes, counts = np.arange(1, 3000), np.full(2999, 400)
    for budget in (10, 123_456_789, int((sizes * counts).sum()) - 1):
        assert int((budget_mix.fit(sizes, counts, budget) * sizes).sum()) == budget


def scaled(x):
    """Python's whole numbers have no range: floor(64 x), held at that of a double."""
    y = 64.0 * float(x)
    return int(np.floor(y)) if np.isfinite(y) else int(np.copysign(np.finfo("f8").max, y))


def top(vectors, k=20):
    """Every row is a candidate; rows that repeat a query's id share one ranking."""
    whole = [(i, [scaled(x) for x in v]) for i, v, *_ in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    scored = {}
    for i, v in whole:
        if i % 20 == 0:
            scored.setdefault(i, []).extend((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w, strict=True)))), j) for j, w in whole if j != i and len(w) == len(v))
    return sorted((i, n + 1, j, -s) for i, found in scored.items() for n, (s, j) in enumerate(sorted(found)[:k]))


def test_top_k_matches_brute_force(spark, monkeypatch):
    r = np.random.default_rng(4)
    given = [(int(i), (r.normal(size=6) * r.choice([0.1, 1, 3]) + (i % 5)).tolist(), 1) for i in r.permutation(700)]
    given += [(1000 + i, [0.5] * 6, 1) for i in range(400)] + [(2000, [1.0, 2.0], 1), (2001, [3.0, 4.0], 1), (2020, [], 1), (2040, [1e11] * 6, 1), (2100, [1e307] * 6, 1), (2101, [-1e308, 1.0, 0, 0, 0, 0], 1), (2120, [1e200, -1e200, 1, 1, 1, 1], 1)]
    given += [(None, [1.0] * 6, 1), (2002, None, 1), (2060, [1.0, None, 1, 1, 1, 1], 1), (2080, [float("nan")] * 6, 1), (2003, [float("inf")] * 6, 1), (20, [9.0] * 6, 1), (20, [9.0] * 6, 1)]
    given += [(1, [8.0] * 6, 1), (1, [7.5] * 6, 1), (3, [1.0, -1.0], 1), (40, [0.25] * 6, 1), (40, [0.25] * 6, 1)]
    given = [(i, v if v is None else [x if x is None else float(x) for x in v], n) for i, v, n in given]
    for name, value in (("BLOCK", 100), ("CHUNK", 20), ("SAMPLE", 200), ("TOGETHER", 3), ("TASKS", 4)):
        monkeypatch.setattr(cover_tree, name, value)
    rows = spark.createDataFrame(given, "vec_id long, embedding array<double>, score int").withColumn("v", F.lit(1)).withColumn("node", F.lit("x"))
    got = cover_tree.search(rows, F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == top(given)
    assert cover_tree.search(rows.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def clustered(seed=1, n=3000, d=8, clusters=25):
    r = np.random.default_rng(seed)
    return np.floor(64 * (r.normal(size=(clusters, d))[r.integers(0, clusters, n)] * 4 + 0.2 * r.normal(size=(n, d))))


@pytest.mark.parametrize("x", [clustered(), np.random.default_rng(1).normal(size=(2000, 3)), np.zeros((50, 4)), np.full((40, 2), 1e200), np.arange(300.0).reshape(-1, 1)])
def test_levels_cover_and_are_apart(x):
    tree, order = cover_tree.cover_tree(x)
    assert sorted(order) == list(range(len(x)))
    again = cover_tree.Tree.unpacked(tree.packed())
    assert all((getattr(again, f) == getattr(tree, f)).all() for f in ("levels", "center", "radius", "start", "stop", "first", "last", "scale"))
    x = x[order]
    before: set[int] = set()
    for level, scale in enumerate(tree.scale):
        nodes = range(tree.levels[level], tree.levels[level + 1])
        centers = tree.center[list(nodes)]
        assert before <= set(centers.tolist())  # nets are nested
        before = set(centers.tolist())
        apart = np.linalg.norm(x[centers][:, None] - x[centers][None], axis=2)[np.triu_indices(len(centers), 1)]
        assert (apart > scale).all()  # separation
        if np.isfinite(scale):
            assert (np.linalg.norm(x[:, None] - x[centers][None], axis=2).min(axis=1) <= scale + 1e-9).all()  # covering
        assert tree.start[nodes[0]] == 0 and tree.stop[nodes[-1]] == len(x)
        for node in nodes:
            rows = x[tree.start[node] : tree.stop[node]]
            if np.isfinite(tree.radius[node]):
                assert np.linalg.norm(rows - x[tree.center[node]], axis=1).max() <= tree.radius[node] + 1e-9
            for child in range(tree.first[node], tree.last[node]):
                assert tree.start[node] <= tree.start[child] < tree.stop[child] <= tree.stop[node]
                assert np.linalg.norm(x[tree.center[child]] - x[tree.center[node]]) <= scale + 1e-9


def test_search_prunes_where_there_are_clusters():
    x = clustered()
    tree, order = cover_tree.cover_tree(x)
    x = x[order]
    asked = np.sort(np.random.default_rng(2).choice(len(x), 200, replace=False))
    above, turn = cover_tree.query_tree(x[asked])
    asked = asked[turn]
    best = cover_tree.Best(20, np.full(200, -np.inf))
    ids = np.arange(len(x))
    scored = cover_tree.dual_search(best, above, x[asked], asked, tree, x, ids)
    for q, scores, found in zip(asked, best.scores, best.ids, strict=True):
        want = sorted((-s, i) for i, s in enumerate((x @ x[q]).tolist()) if i != q)[:20]
        assert [(-s, i) for s, i in zip(scores, found, strict=True)] == want
    assert scored < 0.1 * 200 * len(x)
