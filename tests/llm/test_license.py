import re
from collections import Counter

from chunkweave.llm import license_scan as ls

from .cases import documents, key, rows

TEXTS = [
    "Some code.\nReleased under the MIT License.",
    "UNDER THE MIT LICENSE under the mit license x under-the/mit_license",
    "Licensed under the Apache License, Version 2.0. cc by nc",
    "Licensed under CC BY-NC 4.0.",
    "under the MIT licence; apache version 2 license; under the mİt license; under the mit licensé",
    "This work is licensed under the GNU General Public License, version 3.",
    "mit mit mit license under the the under the mit license" + " mit" * 50 + " gnu apache cc by nc nc cc by nc",
    "Redistribution and use in source and binary forms, with or without modification, are permitted. All rights reserved",
    "K\u212a under the mit license", "cc by nc cc by nc\x00cc\x7fby{nc}", "apache\u00a0license version 2",
]


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, score = [], 0.0
    for k, t in enumerate(ls.BASE + ls.MORE):
        b, p, a = t.before.split(), t.phrase.split(), t.after.split()
        for s in range(len(w) - len(p) + 1):
            if w[s : s + len(p)] == p:
                places.append((k, s))
                at = [(s - len(b) + j, x) for j, x in enumerate(b)] + [(s + len(p) + j, x) for j, x in enumerate(a)]
                hits = sum(0 <= i < len(w) and w[i] == x for i, x in at)
                score = max(score, (len(p) + hits) / (len(p) + len(b) + len(a)))
    base = [s for k, s in places if k < len(ls.BASE)]
    names = lambda ks: ",".join(sorted({(ls.BASE + ls.MORE)[k].label for k in ks}))
    return (len(w), len(base), min(base, default=None), max(base, default=None), names(k for k, _ in places if k < len(ls.BASE)), names(k for k, _ in places), round(score, 9))


def test_scan_matches_brute_force(spark):
    given = rows() + [(1000 + i, t, "en", "s", 1, "", 1, "", 0.0) for i, t in enumerate(TEXTS)]
    got = ls.license_scan(documents(spark, given)).collect()
    mine = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in got]
    assert sorted(mine, key=key) == sorted(((r[0], *brute(r[1])) for r in given), key=key)
    assert max(r.n_base for r in got) >= 3
    for r in got:
        assert sum(p.label in {t.label for t in ls.BASE} for p in r.places) == r.n_base


MIT_BODY = next(t for t in ls.MORE if t.label == "mit")
NAMED = {t.label: t for t in ls.MORE if t.label.startswith("bsd")}


def whole(t):
    return f"{t.before} {t.phrase} {t.after}"


def test_notices_are_told_apart(spark):
    """BSD-2 from BSD-3 by the clause that only one has; MIT by its body alone; edited notices score less than whole ones."""
    two, three, mit = whole(NAMED["bsd-2-clause"]), whole(NAMED["bsd-3-clause"]), whole(MIT_BODY)
    gpl = next(t for t in ls.MORE if t.label == "gpl-2" and "foundation" in t.phrase)
    texts = [f"Copyright (c) X\n{two}", f"Copyright (c) X\n{three}", f"-- {mit.upper()} --", mit.replace("merge", "mince").replace("sublicense", "sub"), f"// {whole(gpl)}", ls.ENDORSE, MIT_BODY.phrase]
    docs = documents(spark, [(i, t, "en", "s", 1, "", 1, "", 0.0) for i, t in enumerate(texts)])
    got = sorted(ls.license_scan(docs).collect(), key=lambda r: r.doc_id)
    assert [r.labels for r in got] == ["bsd-2-clause", "bsd-3-clause", "mit", "mit", "gpl-2", "", "mit"]
    assert all(r.n_base == 0 and r.base_labels == "" for r in got)
    assert [r.score for r in got[:3]] == [1.0, 1.0, 1.0] and got[4].score == 1.0 and got[5].score == 0.0
    assert 0.9 < got[3].score < 1.0 and got[6].score < 0.3


def test_frequencies_and_postings(spark):
    docs = documents(spark, [(i, t, "en", "s", 1, "", 1, "", 0.0) for i, t in enumerate(TEXTS)])
    found = ls.document_frequencies(docs, ls.BASE)
    want = Counter(w for t in TEXTS for w in set(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower().replace("i̇", "é"))) if w in found)
    assert {w: n for w, n in found.items() if w != "mit"} == {w: want[w] for w in found if w != "mit"}
    assert ls.postings(ls.BASE[2], {"cc": 5, "by": 9, "nc": 1}) == [("nc", 2), ("cc", 0)]


def test_lowering_makes_no_ascii_letters(spark):
    points = [(i, chr(i)) for i in range(1, 0x3000) if not 0xD800 <= i < 0xE000]
    for i, c, low in spark.createDataFrame(points, "i int, c string").select("i", "c", ls.lowered("c")).collect():
        assert low == c.lower() if i < 128 else not re.search("[A-Za-z0-9]", low), hex(i)


def test_empty_table(spark):
    assert ls.license_scan(documents(spark, [])).count() == 0
