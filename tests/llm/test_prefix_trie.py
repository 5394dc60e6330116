import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from chunkweave.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, id int, n double"


def brute_force(rows):
    """rows: conv_id, turn, role, text. The contract, said with dictionaries of tuples."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[c].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    out = []
    for node, cs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in below)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        ends = sorted(c for c in cs if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(cs), len(node), parent, len(cs), len(children), len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA).repartition(3)
    return sorted([tuple(r) for r in prefix_trie.conversation_trie(table).collect()], key=str)


def conversations(seed, n=60):
    r = random.Random(seed)
    texts = ["a", "b", "ñandú", "", None, "x y z", "0:ab"]
    rows = []
    for c in [*range(0, n), *range(170, 200), 250, 305, -3, -100, -250]:
        for t in range(r.choice([0, 1, 1, 2, 3, 4, 7, 9])):
            rows.append((c, t if r.random() < 0.95 else None, r.choice(["user", "assistant", None]), r.choice(texts)))
    rows += [(5, 0, "user", "a"), (5, 0, "user", "a"), (None, 0, "user", "a"), (7, None, None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_that_of_brute_force(spark, seed):
    rows = conversations(seed)
    assert found(spark, rows) == brute_force(rows)


def test_deep_conversations_over_several_segments(spark, monkeypatch):
    """With segments of 4 turns the recursion over segments has levels of its own."""
    monkeypatch.setattr(prefix_trie, "SEGMENT", 4)
    r = random.Random(5)
    common = [("user", r.choice("abc")) for _ in range(40)]
    rows = []
    for c in range(0, 40):
        turns = common[: r.choice([3, 4, 8, 12, 15, 16, 31, 33])] + [("user", r.choice("ab")) for _ in range(r.choice([0, 1, 4, 9]))]
        rows += [(c, t, *turn) for t, turn in enumerate(turns)]
    assert found(spark, rows) == brute_force(rows)


def test_many_copies_of_one_conversation(spark, monkeypatch):
    """Strings of ids are cut, and those of one node lie in several tasks."""
    monkeypatch.setattr(prefix_trie, "PACKED", 64)
    rows = [(c, t, "user", "same") for c in range(0, 900) for t in range(2)]
    assert found(spark, rows) == brute_force(rows)


def test_empty(spark):
    assert found(spark, [(None, 1, "user", "a")]) == []
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_names_follow_the_prefix_alone():
    keys = [bytes([k]) * 16 for k in range(23)]
    names = prefix_trie.prefix_names(prefix_trie.ROOT, keys)
    assert len(set(names)) == 24 and names[:10] == prefix_trie.prefix_names(prefix_trie.ROOT, keys[:9])
