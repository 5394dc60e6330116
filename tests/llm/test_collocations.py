import random
import re
from collections import Counter

import numpy as np
import pytest
from chunkweave.llm import collocations

from . import cases

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, threshold, most, share=80):
    """rows: lang, text. The contract, said with counters."""
    counts, total = {}, Counter()
    for lang, text in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for n in range(1, 5):
                own.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, own in counts.items():
        candidates = {p: f for p, f in own.items() if len(p) > 1 and f >= threshold}
        found = []
        for p, a in candidates.items():
            inside = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * f >= share * a and inside(q) for q, f in candidates.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def found(spark, rows, threshold, most=2000):
    docs = cases.documents(spark, [(i, text, lang, "s", 1, "x", 1, "y", 0.5) for i, (lang, text) in enumerate(rows)])
    return sorted(tuple(r) for r in collocations.collocations(docs.repartition(3), threshold, most).collect())


def texts(seed, n=500):
    r = random.Random(seed)
    words = [*"abcdef", "Été", "漢字", "X", "x", "k", "İ", "don't"]
    out = []
    for _ in range(n):
        t = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " \x0b", " "]) for _ in range(r.choice([0, 1, 5, 60, 200])))
        out.append((r.choice(["en", "en", "de", None, "und"]), t))
    return [*out, out[3], out[3], ("en", None), (None, None), ("de", ""), ("fr", "a b " * 5000), ("es", " ,. \n"), ("fr", "y" * 70_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_are_those_of_brute_force(spark, seed):
    rows = texts(seed)
    assert found(spark, rows, 30) == brute_force(rows, 30, 2000)
    assert len(brute_force(rows, 30, 2000)) > 20


def test_small_summaries_and_partitions(spark, monkeypatch):
    """Many hash partitions, counters that have to be taken off, several blocks of survivors, and a table with false hits."""
    for name, value in (("FLUSH", 700), ("MASS", 3000), ("HELD", 100), ("BLOCK", 200), ("TABLE", 1 << 13)):
        monkeypatch.setattr(collocations, name, value)
    rows = texts(3)
    assert found(spark, rows, 12, 40) == brute_force(rows, 12, 40)


def test_summary_keeps_every_frequent_slot():
    r = np.random.default_rng(1)
    stream = np.concatenate((r.integers(0, 1 << 40, 200_000), np.repeat(np.arange(500), 30))).astype("u8")
    r.shuffle(stream)
    summary = collocations.Summary(len(stream) // 30 + 1)
    for some in np.array_split(stream, 40):
        summary.add(*np.unique(some, return_counts=True))
    summary.merge()
    assert len(summary.keys) <= summary.capacity and 0 < summary.lost < 30
    assert set(range(500)) <= set(summary.keys[summary.counts + summary.lost >= 30].tolist())


def test_empty(spark):
    assert found(spark, [], 30) == [] and found(spark, [("en", None)], 30) == []
