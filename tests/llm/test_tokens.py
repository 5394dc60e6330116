import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from chunkweave.llm import length_histogram as lh
from chunkweave.llm import packing
from chunkweave.llm.tokens import default_vocabulary, word_ids
from pyspark.sql import functions as F

from .cases import documents, key, rows, texts


@pytest.fixture(scope="module")
def whole():
    return word_ids(default_vocabulary()).whole


def ids(whole, text):
    return whole.encode(text or "", add_special_tokens=False).ids


def test_words_encode_like_whole_texts(whole):
    odd = ["don't a<|endoftext|>b c", "é ́x É́ a\x1cb\x1f c\x85d e　f", "½ª º µ×÷ ǅ Straße ΑΣ 12a3 'S're", "$$$ a!! | *** ñ"]
    for t in texts(3) + odd:
        got = ids(whole, t)
        assert word_ids(default_vocabulary()).text(t) == struct.pack(f"<{len(got)}I", *got), t


def test_histogram_matches_brute_force(spark, whole):
    docs = documents(spark)
    counted = lh.token_counts(docs)
    lengths = [len(ids(whole, r[1])) + 1 for r in rows()]
    assert Counter(r.n_tokens for r in counted.collect()) == Counter(lengths)
    hist = lh.length_histogram(counted).collect()
    assert {r.length for r in hist} == set(lengths)
    for r in hist:
        assert r.n_docs == lengths.count(r.length)
        assert r.docs_over == sum(x > r.length for x in lengths) and r.docs_up_to + r.docs_over == len(lengths)
        assert r.tokens_over == sum(x for x in lengths if x > r.length) and r.tokens_up_to + r.tokens_over == sum(lengths)
        assert r.truncated_tokens == sum(min(x, r.length) for x in lengths)


def test_limits_and_quantiles(spark, whole):
    lengths = sorted(len(ids(whole, r[1])) + 1 for r in rows())
    hist = lh.length_histogram(lh.token_counts(documents(spark)))
    for r in lh.totals_at(hist, [1, 50, 100_000]).collect():
        assert r.docs_fit == sum(x <= r["limit"] for x in lengths)
        assert r.tokens_fit == sum(x for x in lengths if x <= r["limit"])
        assert r.truncated_tokens == sum(min(x, r["limit"]) for x in lengths)
    for r in lh.quantiles(hist, [0.1, 0.5, 1.0]).collect():
        assert r.length == next(x for x in lengths if sum(y <= x for y in lengths) >= r.share * len(lengths))


def test_empty_tables(spark):
    none = documents(spark, [])
    assert lh.length_histogram(lh.token_counts(none)).count() == 0
    assert packing.packed_documents(none).count() == 0


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_is_whole_and_fits(spark, whole, capacity):
    got = packing.packed_documents(documents(spark), capacity).collect()
    want = []
    for r in rows():
        full = [*ids(whole, r[1]), 1]
        for k, at in enumerate(range(0, len(full), capacity)):
            cut = full[at : at + capacity]
            want.append((r[0], k, at, len(cut), zlib.crc32(struct.pack(f"<{len(cut)}I", *cut))))
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r["offset"], r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= -(-sum(r.length for r in got) // capacity) + max(2, len(bins) // 20)


def test_pieces_can_keep_their_ids(spark, whole):
    for r in packing.token_pieces(documents(spark), 32, with_ids=True).collect():
        assert len(r.ids) == r.length and zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids)) == r.ids_crc32


def test_exchange_between_partitions(spark):
    r = np.random.default_rng(1)
    lengths = r.integers(20, 46, 400).tolist()
    pieces = spark.createDataFrame([(i, 0, 0, int(x), i) for i, x in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = packing.pack(pieces, 100, per_partition=20).collect()
    assert sorted(x.doc_id for x in packed) == list(range(400))
    once = packing.pack(pieces, 100, per_partition=20, rounds=0).collect()
    assert len({x.sequence_id for x in packed}) < len({x.sequence_id for x in once})
    fill = Counter()
    for x in packed:
        fill[x.sequence_id] += x.length
    assert max(fill.values()) <= 100


def test_equal_pieces_are_dealt_to_many_partitions(spark):
    pieces = spark.range(60_000).selectExpr("7L as doc_id", "0 as piece", "0L as start", "40L as length", "1L as ids_crc32")
    for rounds, most in ((0, 1300), (3, 64_000)):
        packed = packing.pack(pieces, 100, per_partition=1000, rounds=rounds).groupBy((F.col("sequence_id") / (1 << 32)).cast("long").alias("part"))
        sizes = [r["count"] for r in packed.count().collect()]
        assert sum(sizes) == 60_000 and max(sizes) <= most, rounds


def test_lower_bound_is_a_bound():
    r = np.random.default_rng(2)
    for _ in range(200):
        lengths = r.integers(1, 101, r.integers(0, 40))
        _, _, bins = packing.best_fit_decreasing(lengths, 100)
        assert -(-lengths.sum() // 100) <= packing.lower_bound(lengths, 100) <= bins
    assert packing.lower_bound(np.array([51] * 9), 100) == 9
    assert packing.lower_bound(np.array([34] * 9), 100) == 5
