import hashlib
import random

import numpy as np
import pytest
from chunkweave.llm import prefix_free

from . import cases

LAST = (1 << 63) - 1


def brute_force(rows, k):
    """rows: doc_id, text. doc_id, n_bytes, n_removed, n_spans, hash of what stays, in the order of the rows."""
    least = {}
    for d, text in rows:
        t, d = (text or "").encode(), LAST if d is None else d
        for i in range(len(t) - k + 1):
            s = t[i : i + k]
            least[s] = min(least.get(s, LAST), d)
    out = []
    for d, text in rows:
        t, order = (text or "").encode(), LAST if d is None else d
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - k + 1):
            if least[t[i : i + k]] < order:
                gone[i + 1 : i + 1 + k] = True
        kept = bytes(b for b, g in zip(t, gone[1:], strict=False) if not g)
        out.append((d, len(t), len(t) - len(kept), int((np.diff(gone.astype("i1")) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=cases.key)


def found(spark, rows, k, parts=3):
    docs = cases.documents(spark, [(d, text, "en", "s", 1, "x", 1, "y", 0.5) for d, text in rows])
    result = prefix_free.deduplicated(docs.repartition(parts), k).collect()
    for r in result:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s.length for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in result], key=cases.key)


@pytest.mark.parametrize("k", [50, 12])
def test_cuts_are_those_of_brute_force(spark, k):
    rows = [(r[0], r[1]) for r in cases.rows()]
    assert found(spark, rows, k) == brute_force(rows, k)
    assert sum(r[2] > 0 for r in brute_force(rows, k)) > 15


def test_runs_periods_and_shared_ids(spark):
    r = random.Random(4)
    passage = "".join(r.choice("abcdé ") for _ in range(300))
    rows = [(1, "X" * 3000), (2, "y" + "X" * 200), (3, "ab" * 500), (4, "ba" * 70 + passage), (4, passage), (4, passage), (5, passage[7:] * 2), (5, "z" + passage[:60] + "z")]
    rows += [(None, passage + "q"), (None, "q" + passage), (None, "n" * 80), (None, "n" * 80), (6, "n" * 49), (7, None), (8, "")] + [(9, passage[:49])] * 3
    rows += [(10 + i, "".join(r.choice("ab") for _ in range(400))) for i in range(20)]
    assert found(spark, rows, 50) == brute_force(rows, 50)
    assert found(spark, rows, 20, 1) == brute_force(rows, 20)


def test_crowded_triggers_and_many_buckets(spark, monkeypatch):
    """Triggers that are crowded, windows with no other, small buckets and lines that cut long texts."""
    for name, value in (("BUCKET", 3000), ("CROWD", 3), ("CROWDED", 1 << 20)):
        monkeypatch.setattr(prefix_free, name, value)
    r = random.Random(6)
    common = [" of the common words ", " and the other words ", " in some of the "]
    rows = [(i, "".join(r.choice(common) + r.choice("abcdefgh") * r.randint(0, 9) for _ in range(r.randint(0, 40)))) for i in range(150)]
    assert found(spark, rows, 50) == brute_force(rows, 50)


def test_long_texts_are_cut_into_lines(monkeypatch):
    monkeypatch.setattr(prefix_free, "SEGMENT", 97)
    r = random.Random(8)
    text = bytes(r.choice(b"abc") for _ in range(1000))
    starts = []
    for parse, _, bases in prefix_free.parses([text], 50):
        line = np.searchsorted(parse.stops, parse.windows, "right")
        starts += (parse.windows - parse.first[line] + bases[line]).tolist()
    assert starts == list(range(951))


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    """With a hash of few bits most classes hold different windows."""
    monkeypatch.setattr(prefix_free.Parse, "hashes", lambda self, a, b: (self.sums[b] - self.sums[a]) * self.down[a] % np.uint64(7))
    r = random.Random(9)
    lines = [bytes(r.choice(b"ab") for _ in range(40)) for _ in range(12)]
    doc = np.arange(12)[::-1].copy()
    parse = prefix_free.Parse(lines, 8)
    line = np.searchsorted(parse.stops, parse.windows, "right")
    spans = [parse.buf[a : a + 8] for a in parse.windows.tolist()]
    least = {}
    for s, d in zip(spans, doc[line].tolist(), strict=True):
        least[s] = min(least.get(s, 99), d)
    assert prefix_free.covered_windows(parse, doc).tolist() == [d > least[s] for s, d in zip(spans, doc[line].tolist(), strict=True)]


def test_empty(spark):
    assert found(spark, [], 50) == [] and found(spark, [(1, None)], 50) == brute_force([(1, None)], 50)
