import zlib
from collections import Counter

import pytest
from chunkweave.llm import hilbert
from pyspark.sql import functions as F

from .cases import documents, key, rows


@pytest.mark.parametrize("dims", [2, 3])
def test_neighbours_on_the_curve_are_neighbours_in_space(spark, dims):
    side = 1 << hilbert.BITS
    cells = spark.range(side**dims).select("id", *[F.pmod(F.floor(F.col("id") / side**i), F.lit(side)).cast("int").alias(f"d{i}") for i in range(dims)])
    got = sorted(hilbert.with_curve(cells, [f"d{i}" for i in range(dims)]).collect(), key=lambda r: r.curve)
    assert [r.curve for r in got] == list(range(side**dims))
    points = [r[1 : 1 + dims] for r in got]
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(points, points[1:], strict=False))


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards_are_whole_gapless_and_even(spark, law):
    given = rows()
    got = hilbert.hilbert_shards(documents(spark), 8, law).collect()
    want = [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in given]
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=key) == sorted(want, key=key)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r)
    assert set(by_shard) <= set(range(8))
    for held in by_shard.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    flat = [r for s in sorted(by_shard) for r in sorted(by_shard[s], key=lambda r: r.slot)]
    assert [r.curve for r in flat] == sorted(r.curve for r in got)
    if law == "rows":
        n = [len(by_shard.get(s, [])) for s in range(8)]
        assert max(n) - min(n) <= 1
    else:
        total, largest = sum(x[1] for x in want), max(x[1] for x in want)
        assert all(abs(sum(r["size"] for r in by_shard.get(s, [])) - total / 8) <= largest for s in range(8))


def test_hot_cell_is_cut_in_many_buckets(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    got = hilbert.hilbert_shards(docs, 8, "rows")
    assert sorted(Counter(r.shard for r in got.collect()).values()) == [625] * 8
    assert hilbert.shard_ranges(got).count() == 8


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_copies_of_one_id_and_text_are_dealt_to_parts(spark, law, monkeypatch):
    monkeypatch.setattr(hilbert, "BUCKET", 50)
    held = []
    real = hilbert.with_parts
    monkeypatch.setattr(hilbert, "with_parts", lambda *a: held.append(real(*a)) or held[-1])
    copies = [(None, "same", "s", "en")] * 900 + [(7, "a copy", "s", "en")] * 600 + [(8, "other", "t", None)] * 130
    given = copies + [(i, f"text {i % 40}", f"s{i % 3}", "en") for i in range(900)]
    df = spark.createDataFrame(given, "doc_id long, text string, source string, lang string").repartition(9)
    got = hilbert.hilbert_shards(df, 8, law).collect()
    rows, names = held[0]
    assert names == ["bucket", "turn", "part"]
    assert max(r["count"] for r in rows.groupBy(*names).count().collect()) <= 150
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((d, zlib.crc32(t.encode())) for d, t, _, _ in given)
    by_shard = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert all(slots == list(range(len(slots))) for slots in by_shard.values())
    flat = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in flat] == sorted(r.curve for r in got)
    if law == "rows":
        assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    else:
        sizes = [sum(r["size"] for r in got if r.shard == s) for s in range(8)]
        assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)


def test_ranges_of_raw_names_prune(spark):
    """A reader who wants one source opens at most 3 of 8 shards (median) by the least and greatest names in each."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ranges = hilbert.shard_ranges(hilbert.hilbert_shards(docs, 8, "bytes")).collect()
    names = sorted(r[0] for r in docs.select("source").distinct().collect())
    reads = sorted(sum(r.name0_min <= n <= r.name0_max for r in ranges) for n in names)
    assert len(names) >= 10 and reads[0] >= 1
    assert reads[len(reads) // 2] <= 3
    assert sum(r["rows"] for r in ranges) == docs.count()


def test_ranges_keep_the_order_of_names(spark):
    names = [f"n{i:04d}" for i in range(700)] * 2 + ["n0350"] * 700 + [None] * 5
    df = spark.createDataFrame([(n,) for n in names], "s string").repartition(7)
    cuts = hilbert.cuts_of(df, F.col("s"), 15)
    assert [c for _, c in cuts] == sorted({c for _, c in cuts}) and 1 <= cuts[0][1] and cuts[-1][1] <= 15
    got = sorted((r.s or "", r.cell) for r in df.select("s", hilbert.by_cuts(F.col("s"), cuts).alias("cell")).collect())
    assert [c for _, c in got] == sorted(c for _, c in got)
    assert {c for n, c in got if not n} == {0} and min(c for n, c in got if n) == 1
    assert Counter(c for n, c in got if n and n != "n0350").most_common(1)[0][1] <= 2 * 1400 / 15


def test_empty_table_and_unknown_law(spark):
    assert hilbert.hilbert_shards(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        hilbert.hilbert_shards(documents(spark), law="else")
