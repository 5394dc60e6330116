"""Collocations: frequent phrases of 2 to 4 words by how far they exceed their parts, counted exactly for each language.

1. One pass hashes every run of 1 to `MOST` words within a piece, its language included, to a slot of a hash partition. What a task has seen of
   a partition goes there as a summary of counts, delta-coded. A slot that reaches the threshold within one summary is frequent for certain and leaves the
   stream. The headers of all summaries come first in a partition, so its remaining mass is known before its counts.
2. Each partition merges its summaries by Misra and Gries: more than mass / threshold counters, and whenever there are more,
   the first one beyond is taken off all. A frequent slot loses less than the threshold in all, so every one survives; partitions are many enough for the counters to fit.
3. The second pass counts the phrases, as texts, whose slot survives; slots go to all tasks as a bit table of bounded size, in several blocks where they are many.
   Packed counts meet in hash partitions of phrases, whose sums are exact; false survivors fall to the threshold.
4. Scores, the part of longer phrases and ranks are joins and aggregations over frequent phrases alone.

Every part of a frequent phrase is frequent, so the second pass has the counts of all parts as well.

Defined results: null texts have no words and a null lang is `und`; repeated rows count each; ids play no part; texts are taken whole; an empty
table, or one without frequent phrases, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.llm.common import checkpointed, col
from chunkweave.llm.substring import mixed, powers

MOST = 4
#: Where pieces and words end: fixed values.
CUTS, BLANK = b".,;:!?\n\x0b\x0c\r", b" \t"
RUNS = re.compile(rb"[ \t]{2,}|\t")
#: Bytes of text scanned at once, slots in a summary, occurrences in a hash partition, and different phrases that are held before they are sent.
GROUP, FLUSH, MASS, HELD = 1 << 20, 1 << 22, 1 << 25, 1 << 19
#: Bits of the table of survivors, and slots that it holds at most.
TABLE, BLOCK = 1 << 28, 1 << 22
KIND = np.zeros(256, "u1")
KIND[list(BLANK)], KIND[list(CUTS)] = 1, 2
U = np.uint64


class Scan:
    """Words of some texts, the hash of every run of words, and where runs stay within a piece. langs: a number for each text."""

    def __init__(self, texts: list[bytes], langs: list[int]) -> None:
        buf = b"\n".join(texts)
        self.buf = RUNS.sub(b" ", buf) if b"  " in buf or b"\t" in buf else buf
        raw = np.frombuffer(self.buf, "u1")
        kind = KIND[raw]
        solid = np.concatenate(([0], kind == 0, [0])).astype("i1")
        turn = np.diff(solid)
        self.starts, self.ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        self.piece = np.cumsum(kind == 2, dtype="i4")[self.starts]
        lengths = np.fromiter((len(t) if self.buf is buf else len(RUNS.sub(b" ", t)) for t in texts), "i8", len(texts))
        first = np.searchsorted(self.starts, np.concatenate(([0], np.cumsum(lengths + 1)[:-1])))
        self.lang = np.repeat(np.array(langs, "i8"), np.diff(np.append(first, len(self.starts))))
        up, down = powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, "u8")
        np.cumsum((raw.astype("u8") + U(1)) * up[: len(raw)], out=sums[1:])
        self.words = mixed((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def runs(self, seeds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """n, first words and hashes of the runs of n words, for each n. seeds: by number of language."""
        whole = np.zeros(len(self.words), "u8")
        for n in range(1, MOST + 1):
            size = len(self.words) - n + 1
            if size <= 0:
                return
            whole = whole[:size] * U(0xFF51AFD7ED558CCD) + self.words[n - 1 :]
            at = np.flatnonzero(self.piece[:size] == self.piece[n - 1 :])
            yield n, at, mixed(whole[at] + seeds[self.lang[at]] + U(n))

    def strings(self, at: np.ndarray, n: int) -> list[bytes]:
        buf = self.buf
        return [buf[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at + n - 1].tolist(), strict=True)]


class Langs:
    """Numbers and seeds for the languages that a task meets."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.number: dict[str, int] = {}
        self.seeds = np.empty(0, "u8")

    def of(self, names: list[str]) -> list[int]:
        for name in names:
            if name not in self.number:
                self.number[name] = len(self.names)
                self.names.append(name)
                self.seeds = np.append(self.seeds, U(xxhash.xxh64_intdigest(name.encode())))
        return [self.number[n] for n in names]


def scans(batch: pa.RecordBatch, langs: Langs) -> Iterator[Scan]:
    """Scans of about GROUP bytes of a batch with columns lang and text; only A-Z are lowered."""
    texts: list[bytes] = []
    own: list[str] = []
    held = 0
    for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
        if text:
            texts.append(text.lower())
            own.append(name)
            held += len(text)
        if held >= GROUP:
            yield Scan(texts, langs.of(own))
            texts, own, held = [], [], 0
    if texts:
        yield Scan(texts, langs.of(own))


def slots_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The partition in the upper half, 32 bits of the hash in the lower one."""
    return (((hashes >> U(32)) % U(buckets)) << U(32)) | (hashes & U(0xFFFFFFFF))


def planes(x: np.ndarray) -> bytes:
    """Gaps of sorted numbers of 32 bits, byte by byte, which compresses well."""
    return np.diff(x, prepend=x.dtype.type(0)).astype("<u4").view("u1").reshape(-1, 4).T.tobytes()


def from_planes(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, "u1", 4 * n).reshape(4, n).T).view("<u4").ravel(), dtype="u8")


SUMMARY = "bucket int, body int, mass long, n int, data binary"


def summaries(batches: Iterator[pa.RecordBatch], buckets: int, threshold: int, flush: int) -> Iterator[pa.RecordBatch]:
    """For each partition a header (its mass, and slots that are frequent for certain) and a body (the other slots and their counts)."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    langs, found, held = Langs(), [], 0

    def sent() -> pa.RecordBatch:
        slot, n = np.unique(np.concatenate(found), return_counts=True)
        rows = []
        bucket, key = (slot >> U(32)).astype("i8"), (slot & U(0xFFFFFFFF)).astype("u4")
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            sure = n[a:b] >= threshold
            rows.append((int(bucket[a]), 0, int(n[a:b][~sure].sum()), int(sure.sum()), squeeze(planes(key[a:b][sure]))))
            rest = n[a:b][~sure].astype("<u2" if threshold <= 1 << 16 else "<u8")
            rows.append((int(bucket[a]), 1, 0, len(rest), squeeze(planes(key[a:b][~sure]) + rest.tobytes())))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "body", "mass", "n", "data"])

    for batch in batches:
        for scan in scans(batch, langs):
            for _, _, hashes in scan.runs(langs.seeds):
                found.append(slots_of(hashes, buckets))
                held += len(hashes)
            if held >= flush:
                yield sent()
                found, held = [], 0
    if held:
        yield sent()


class Summary:
    """Counters of Misra and Gries. `lost` is how much any slot may have lost."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.empty(0, "u8"), np.empty(0, "i8")
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.held += len(keys)
        if self.held >= max(self.capacity, 1 << 18):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.held = [], 0
        if not len(keys):
            return
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        if len(keys) > self.capacity:
            beyond = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            stay = counts > beyond
            keys, counts = keys[stay], counts[stay] - beyond
            self.lost += beyond
        self.keys, self.counts = keys, counts


def survivors(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Slots that may be frequent. Rows of a partition come together, headers first."""
    open_ = zstandard.ZstdDecompressor().decompress
    bucket, mass, sure, summary = None, 0, [], None

    def closed() -> pa.RecordBatch:
        keys = np.concatenate(sure) if sure else np.empty(0, "u8")
        if summary is not None:
            summary.merge()
            keys = np.concatenate((keys, summary.keys[summary.counts + summary.lost >= threshold]))
        return pa.record_batch([pa.array((np.unique(keys) | U(bucket << 32)).view("i8"))], ["slot"])

    for batch in batches:
        for own, body, more, n, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if own != bucket:
                if bucket is not None:
                    yield closed()
                bucket, mass, sure, summary = own, 0, [], None
            raw = open_(data)
            keys = from_planes(raw, n)
            if not body:
                mass += more
                sure.append(keys)
                continue
            summary = summary or Summary(mass // threshold + 1)
            summary.add(keys, np.frombuffer(raw, "<u2" if threshold <= 1 << 16 else "<u8", n, 4 * n).astype("i8"))
    if bucket is not None:
        yield closed()


def bit_table(slots: np.ndarray) -> np.ndarray:
    table = np.zeros(TABLE >> 3, "u1")
    at = mixed(slots.view("u8")) % U(TABLE)
    np.bitwise_or.at(table, (at >> U(3)).astype("i8"), (1 << (at & U(7)).astype("u1")).astype("u1"))
    return table


COUNTS = "bucket int, lang string, k int, phrases binary, n binary"


def counted(batches: Iterator[pa.RecordBatch], buckets: int, table: object, totals: bool, most: int) -> Iterator[pa.RecordBatch]:
    """Packed counts, by partition, lang and k, of the phrases whose slot is in the table; totals: also the number of all words, as an empty phrase with k = 0."""
    langs, known = Langs(), table.value
    squeeze = zstandard.ZstdCompressor(level=1).compress
    counts: dict[tuple[int, int], Counter] = {}

    def sent() -> pa.RecordBatch:
        rows = []
        for (lang, k), own in counts.items():
            phrases, n = list(own), np.fromiter(own.values(), "<i8", len(own))
            bucket = np.fromiter(map(zlib.crc32, phrases), "i8", len(phrases)) % buckets
            order = np.argsort(bucket, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                rows.append((int(bucket[at[0]]), langs.names[lang], k, squeeze(b"\n".join([phrases[i] for i in at.tolist()])), squeeze(n[at].tobytes())))
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "lang", "k", "phrases", "n"])

    for batch in batches:
        for scan in scans(batch, langs):
            if totals:
                for lang, n in enumerate(np.bincount(scan.lang).tolist()):
                    if n:
                        counts.setdefault((lang, 0), Counter())[b""] += n
            for k, at, hashes in scan.runs(langs.seeds):
                bit = mixed(slots_of(hashes, buckets)) % U(8 * len(known))
                at = at[(known[(bit >> U(3)).astype("i8")] >> (bit & U(7)).astype("u1")) & 1 == 1]
                own = scan.lang[at]
                for lang in np.unique(own).tolist():
                    counts.setdefault((lang, k), Counter()).update(scan.strings(at[own == lang], k))
            if sum(map(len, counts.values())) >= most:
                yield sent()
                counts = {}
    if counts:
        yield sent()


def summed(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """lang, phrase, k and f of the frequent phrases of a partition. Rows come by partition, lang and k; a phrase has one partition."""
    open_ = zstandard.ZstdDecompressor().decompress
    group, held = None, Counter()

    def closed() -> pa.RecordBatch:
        _, lang, k = group
        found = [(p, n) for p, n in held.items() if n >= threshold or not k]
        phrases = pa.array([p for p, _ in found], pa.binary()).cast(pa.string())
        return pa.record_batch([pa.array([lang] * len(found), pa.string()), phrases, pa.array([k] * len(found), pa.int32()), pa.array([n for _, n in found], pa.int64())], ["lang", "phrase", "k", "f"])

    for batch in batches:
        for *own, phrases, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if own != group:
                if group is not None:
                    yield closed()
                group, held = own, Counter()
            for phrase, more in zip(open_(phrases).split(b"\n"), np.frombuffer(open_(n), "<i8").tolist(), strict=True):
                held[phrase] += more
    if group is not None:
        yield closed()


def frequent_phrases(docs: DataFrame, threshold: int = 30, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, phrase, k (its number of words, 1 to MOST) and f (at least threshold); with k = 0 the number of all words of a lang."""
    rows = docs.select(F.coalesce(col(lang_col), F.lit("und")).alias("lang"), col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(MOST * size / 6 / MASS))  # a word and its blank are about six bytes; only the size of tasks depends on it
    sent = rows.mapInArrow(partial(summaries, buckets=buckets, threshold=threshold, flush=FLUSH), SUMMARY)
    sent = sent.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "body")
    slots = checkpointed(sent.mapInArrow(partial(survivors, threshold=threshold), "slot long"))
    blocks = max(1, math.ceil(slots.count() / BLOCK))
    number = F.pmod(F.xxhash64("slot"), F.lit(blocks))
    found = []
    for block in range(blocks):
        own = slots.where(number == block).toArrow()["slot"].to_numpy()
        table = docs.sparkSession.sparkContext.broadcast(bit_table(own))
        each = rows.mapInArrow(partial(counted, buckets=buckets, table=table, totals=block == 0, most=HELD), COUNTS)
        each = each.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "lang", "k")
        found.append(each.mapInArrow(partial(summed, threshold=threshold), "lang string, phrase string, k int, f long"))
    # A phrase can pass the tables of several blocks by chance: each block gives its whole count.
    return checkpointed(found[0] if blocks == 1 else reduce(DataFrame.unionByName, found).distinct())


def collocations(docs: DataFrame, threshold: int = 30, most: int = 2000, share: int = 80, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: for each lang the first `most` phrases by score.

    A phrase is left out if a longer one that holds it has at least `share` per cent of its count.
    """
    counts = frequent_phrases(docs, threshold, lang_col, text_col)
    known = counts.where("k > 0")
    phrases = known.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    ends = phrases.select("lang", "phrase", "k", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    sides = F.inline(F.array(F.struct(F.lit(True).alias("left"), part(1, F.col("cut")).alias("part")), F.struct(F.lit(False).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("part"))))
    ends = ends.select("lang", "phrase", "a", "cut", sides).join(known.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    halves = ends.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    least = halves.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("least"))
    # Runs of 2 words and more within longer phrases.
    spans = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda at: F.array_join(F.slice("w", at, n), " ")))))
    within = phrases.where("k > 2").select("lang", F.col("a").alias("longer"), spans.alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = checkpointed(least.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)))
    kept = kept.select("lang", "phrase", "a", "least.l", "least.r", "least.score")
    order = (F.desc("score"), F.desc("a"), "phrase")
    # Shares of a lang come first, eight times fewer from turn to turn, so that no task ranks more than some `most` phrases.
    shares = max(1, math.ceil(kept.count() / (8 * most)))
    while True:
        share_of = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(shares))).orderBy(*order)
        kept = kept.withColumn("rank", F.row_number().over(share_of).cast("long")).where(F.col("rank") <= most)
        if shares == 1:
            break
        shares = math.ceil(shares / 8)
    total = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return kept.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
