import hashlib
import random
from collections import Counter

import pytest
from chunkweave.llm import substring

from .cases import documents, found_words, key, rows


def brute(given, k=13):
    first = {}
    for r in given:
        w = found_words(r[1])
        at = float("inf") if r[0] is None else r[0]
        for i in range(len(w) - k + 1):
            span = tuple(w[i : i + k])
            first[span] = min(first.get(span, at), at)
    out = []
    for r in given:
        w = found_words(r[1])
        at = float("inf") if r[0] is None else r[0]
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < at:
                gone |= set(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=key)


def more(seed=1):
    """Common lines and passages in many documents, ids that carry several texts, and a long text."""
    r = random.Random(seed)
    v = ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 6))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(v) for _ in range(n))
    line, passage = say(9), say(70)
    out = []
    for i in range(150):
        t = say(r.choice([5, 30, 60]))
        if i % 2:
            t += "\n" + line
        if i % 3 == 0:
            t = say(7) + " " + passage + "\t" + t
        if i % 7 == 0:
            t = passage[: r.randint(100, 300)] + "  " + t
        out.append((3000 + i // 2 if i < 20 else 4000 - i, t, "en", "s", 1, "", 1, "", 0.0))
    out.append((1, say(3000) + " " + passage, "en", "s", 1, "", 1, "", 0.0))
    out.append((2, " ".join([say(15)] * 20), "en", "s", 1, "", 1, "", 0.0))
    return out


@pytest.mark.parametrize("crowd", [10**9, 64, 3])
def test_matches_brute_force(spark, monkeypatch, crowd):
    given = rows() + more()
    monkeypatch.setattr(substring, "CROWD", crowd)
    if crowd < 10**9:
        monkeypatch.setattr(substring, "BUCKET", 4000)
    got = substring.deduplicated(documents(spark, given), with_rows=False)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=key) == brute(given)


def test_scan_in_segments(monkeypatch):
    monkeypatch.setattr(substring, "SEGMENT", 50)
    monkeypatch.setattr(substring, "GROUP", 500)
    texts = [r[1] and r[1].encode() for r in more()]
    spans = Counter()
    for scan, rows_, bases in substring.scans(texts, 13):
        least, first, n = scan.super_kmers()
        assert n.sum() == len(scan.windows)
        for f, m, text in zip(first, n, scan.packed(first, n), strict=True):
            line = scan.line[f]
            for j in range(m):
                spans[(rows_[line], f - scan.first[line] + bases[line] + j)] += 1
        found = [scan.packed(first[i : i + 1], n[i : i + 1])[0].split() for i in range(len(first))]
        assert all(len(w) == m + 12 for w, m in zip(found, n, strict=True))
    want = Counter((i, j) for i, t in enumerate(texts) for j in range(len((t or b"").split()) - 12))
    assert spans == want


def test_kept_text_keeps_its_shape(spark):
    given = rows() + more()
    got = substring.deduplicated(documents(spark, given)).collect()
    for r in got:
        assert hashlib.sha256(" ".join(found_words(r.text)).encode()).hexdigest() == r.kept_sha256
        if not r.n_removed:
            assert r.text == r.row.text
    assert len(got) == len(given) and any(r.n_removed for r in got)


def test_empty_table(spark):
    assert substring.deduplicated(documents(spark, [])).count() == 0


def test_many_rows_without_id(spark):
    """Rows without id, copies of one text among them, are each cut by themselves; column names need quoting."""
    r = random.Random(5)
    say = lambda n: " ".join(r.choice("abcdefghijklmnop") * r.randint(1, 4) for _ in range(n))
    passage, copy = say(30), say(40)
    given = [(7, passage, 1, 0.5, "x"), (8, copy, 1, 0.5, "x")]
    given += [(None, copy if i % 3 == 0 else f"{say(15)} {passage} {say(14)}", i, 0.5, "x") for i in range(3000)]
    docs = spark.createDataFrame(given, "doc_id long, text string, `my col` int, `a.b` double, row string")
    got = substring.deduplicated(docs).collect()
    assert sorted(((g.doc_id, g.n_words, g.n_removed, g.kept_sha256) for g in got), key=key) == brute(given)
    assert sorted(g.row["my col"] for g in got) == sorted(g[2] for g in given)
    assert got[0].row["a.b"] == 0.5
