"""Exact substring deduplication by super-k-mers of words.

A window is `k` consecutive words of one document; its minimiser is the least hash among its runs of `MMER` words.
1. One pass counts minimisers in each batch; only those that repeat are summed, to find the crowded ones. From then on these
   come last in the order of minimisers, so that a window takes one only if it has no other.
2. Consecutive windows with the same minimiser travel as one packed string to the minimiser's bucket. A bucket gets
   compressed blobs of about `BUCKET` bytes of strings in all, and is a partition of its own, so tasks do not grow with the input.
3. In a bucket, strings whose minimiser stands alone are left out. The windows of the others are sorted by hash;
   equal neighbours are compared byte for byte. All but those in the smallest document are marked.
4. Windows of crowded minimisers alone travel by themselves, as one row for each different window and `ALONE` places of such: their smallest
   document is found by an aggregation, and a join, which can be split where it is skewed, marks the others.
5. Marks are gathered by document and applied to the whole texts.

Windows are judged on the input. Marks carry a hash of the document's text, by which they are gathered, and one of the words they
cover, so documents that share an id, or have none, neither mix nor meet.

Defined results: null and empty texts have no words; null ids count as larger than all others; rows that repeat an id
don't remove each other's words; a document that is wholly covered keeps an empty text; an empty table gives an empty
result; other columns are ignored or, by `deduplicated`, kept. Ids have to be whole numbers, or strings of such.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkweave.llm.common import checkpointed, col, sealed

MMER = 3
#: Bytes of packed strings in a bucket, of text scanned at once, and of packed strings held before they are sent.
BUCKET, GROUP, FLUSH = 24 << 20, 1 << 20, 32 << 20
#: Rows whose marks are applied, and whose texts are sent, at once.
APPLIED = 256
#: Words of a long document that are scanned at once.
SEGMENT = 100_000
#: Crowded minimisers are at most so many, and each has more runs than this.
CROWDED, CROWD = 1 << 20, 64
#: Places of windows of crowded minimisers that are gathered before they are sent.
ALONE = 200_000
LAST = (1 << 63) - 1
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_powers = np.ones((2, 1), "u8")


def powers(n: int) -> np.ndarray:
    """Powers of an odd number and of its inverse modulo 2**64."""
    global _powers
    if _powers.shape[1] < n:
        base = 0x5851F42D4C957F2D
        grown = np.empty((2, n), "u8")
        for row, b in zip(grown, (base, pow(base, -1, 1 << 64)), strict=True):
            row[:] = b
            row[0] = 1
            np.multiply.accumulate(row, out=row)
        _powers = grown
    return _powers


class Crowd:
    """The crowded minimisers; a table of their last bits answers most lookups."""

    TOP = U(1 << 63)

    def __init__(self, values: np.ndarray) -> None:
        self.values, self.mask = np.sort(values), U((1 << 22) - 1)
        self.table = np.zeros(1 << 22, bool)
        self.table[self.values & self.mask] = True

    def last(self, least: np.ndarray) -> np.ndarray:
        """Values with the top bit set for crowded ones."""
        if not len(self.values):
            return least
        at = np.flatnonzero(self.table[least & self.mask])
        near = np.minimum(np.searchsorted(self.values, least[at]), len(self.values) - 1)
        out = least.copy()
        out[at[self.values[near] == least[at]]] |= self.TOP
        return out


NONE = Crowd(np.empty(0, "u8"))


class Scan:
    """Word bounds, word hashes and valid windows of lines of words that single spaces separate."""

    def __init__(self, lines: list[bytes], k: int) -> None:
        self.buf, self.k = b"\n".join(lines), k
        raw = np.frombuffer(self.buf, "u1")
        self.ends = np.append(np.flatnonzero((raw == 32) | (raw == 10)), len(raw))
        self.starts = np.concatenate(([0], self.ends[:-1] + 1))
        up, down = powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, "u8")
        np.cumsum((raw.astype("u8") + U(1)) * up[: len(raw)], out=sums[1:])
        self.words = mixed((sums[self.ends] - sums[self.starts]) * down[self.starts])
        self.line = np.concatenate(([0], np.cumsum(raw[self.ends[:-1]] == 10)))
        self.first = np.searchsorted(self.line, np.arange(len(lines)))  # first word of each line
        self.windows = np.flatnonzero(self.line[: 1 - k] == self.line[k - 1 :])

    def combined(self, n: int) -> np.ndarray:
        """A hash of each run of n words."""
        size = len(self.words) - n + 1
        out = np.zeros(size, "u8")
        for j in range(n):
            out = out * U(0xFF51AFD7ED558CCD) + self.words[j : j + size]
        return mixed(out)

    def minimisers(self, crowd: Crowd = NONE) -> np.ndarray:
        """The least hash (63 bits) of MMER words in each window, crowded ones last, with the top bit set."""
        m = crowd.last(self.combined(MMER) >> U(1))
        have, want = 1, self.k - MMER + 1
        while have < want:
            step = min(have, want - have)
            m = np.minimum(m[:-step], m[step:])
            have += step
        return m[self.windows]

    def super_kmers(self, crowd: Crowd = NONE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Minimiser, first window and number of windows of each run of windows."""
        least, at = self.minimisers(crowd), self.windows
        if not len(at):
            return least, at, at
        cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]))))
        return least[cut], at[cut], np.diff(np.append(cut, len(at)))

    def packed(self, first: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The words from each first window to the end of its n-th."""
        buf, a, z = self.buf, self.starts[first].tolist(), self.ends[first + n + self.k - 2].tolist()
        return [buf[i:j] for i, j in zip(a, z, strict=True)]


def scans(texts: list[bytes | None], k: int) -> Iterator[tuple[Scan, np.ndarray, np.ndarray]]:
    """Scans of about GROUP bytes, with the row and the first word's number of each line."""
    lines: list[bytes] = []
    rows: list[int] = []
    bases: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        found = text.split() if text else []
        for base in range(0, len(found) - k + 1, SEGMENT):
            lines.append(b" ".join(found[base : base + SEGMENT + k - 1]))
            rows.append(i)
            bases.append(base)
            held += len(lines[-1])
        if held >= GROUP:
            yield Scan(lines, k), np.array(rows), np.array(bases)
            lines, rows, bases, held = [], [], [], 0
    if lines:
        yield Scan(lines, k), np.array(rows), np.array(bases)


def raw_texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()


def count_minimisers(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Minimisers that repeat in a batch, with counts; under null the number of runs and of their bytes."""
    for batch in batches:
        found, size = [np.empty(0, "u8")], 0
        for scan, _, _ in scans(raw_texts(batch), k):
            least, first, n = scan.super_kmers()
            size += int((scan.ends[first + n + k - 2] - scan.starts[first]).sum())
            found.append(least)
        every = np.concatenate(found)
        least, n = np.unique(every, return_counts=True)
        least, n = least[n > 1], n[n > 1]
        yield pa.record_batch([pa.array([None, *least.view("i8").tolist()], pa.int64()), pa.array([len(every), *n.tolist()], pa.int64()), pa.array([size] + [0] * len(n), pa.int64())], ["least", "n", "size"])


class Outbox:
    """Packed strings by bucket, sent as compressed blobs."""

    schema = "bucket int, packs binary, refs binary"

    def __init__(self, buckets: int) -> None:
        self.buckets, self.size = buckets, 0
        self.packs: list[bytes] = []
        self.refs: list[np.ndarray] = []

    def add(self, packs: list[bytes], least: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> None:
        self.packs += packs
        self.refs.append(np.stack([mixed(least).view("i8"), doc, tag, start]))
        self.size += sum(map(len, packs))

    def sent(self) -> Iterator[pa.RecordBatch]:
        if not self.packs:
            return
        least, doc, tag, start = np.concatenate(self.refs, axis=1)
        bucket = (least.view("u8") % U(self.buckets)).astype("i8")
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        squeeze = zstandard.ZstdCompressor(level=3).compress
        out: list[list] = [[], [], []]
        for at in np.split(order, cuts):
            refs = (least[at].view("u8") >> U(32)).astype("<u4").tobytes() + places(doc[at], tag[at], start[at])
            for column, value in zip(out, (int(bucket[at[0]]), squeeze(b"\n".join([self.packs[i] for i in at.tolist()])), squeeze(refs)), strict=True):
                column.append(value)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "packs", "refs"])
        self.packs, self.refs, self.size = [], [], 0


def places(doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> bytes:
    return np.diff(doc, prepend=0).astype("<i8").tobytes() + tag.astype("<i4").tobytes() + start.astype("<i4").tobytes()


def places_of(raw: bytes, n: int, at: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, tag and start of n places."""
    return np.cumsum(np.frombuffer(raw, "<i8", n, at)), np.frombuffer(raw, "<i4", n, at + 8 * n), np.frombuffer(raw, "<i4", n, at + 12 * n)


def whole_numbers(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]


def pack_super_kmers(batches: Iterator[pa.RecordBatch], k: int, buckets: int, crowded: np.ndarray) -> Iterator[pa.RecordBatch]:
    box, crowd = Outbox(buckets), Crowd(crowded)
    for batch in batches:
        ids, tags = whole_numbers(batch)
        for scan, rows, bases in scans(raw_texts(batch), k):
            least, first, n = scan.super_kmers(crowd)
            light = least < Crowd.TOP
            least, first, n = least[light], first[light], n[light]
            line = scan.line[first]
            box.add(scan.packed(first, n), least, ids[rows[line]], tags[rows[line]], first - scan.first[line] + bases[line])
            if box.size >= FLUSH:
                yield from box.sent()
    yield from box.sent()


def single_windows(batches: Iterator[pa.RecordBatch], k: int, crowded: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows whose minimisers are all crowded: their words, the smallest and largest document of some places, and these."""
    crowd = Crowd(crowded)
    held: dict[bytes, list[tuple[int, int, int]]] = {}
    n = 0

    def sent() -> pa.RecordBatch:
        refs, low, high = [], [], []
        for found in held.values():
            doc, tag, start = np.array(found, "i8").T
            refs.append(places(doc, tag, start))
            low.append(int(doc.min()))
            high.append(int(doc.max()))
        return pa.record_batch([pa.array(list(held), pa.binary()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(refs, pa.binary())], ["span", "low", "high", "refs"])

    for batch in batches:
        ids, tags = whole_numbers(batch)
        for scan, rows, bases in scans(raw_texts(batch), k):
            at = scan.windows[scan.minimisers(crowd) >= Crowd.TOP]
            line = scan.line[at]
            spans = scan.packed(at, np.ones(len(at), "i8"))
            for span, *place in zip(spans, ids[rows[line]].tolist(), tags[rows[line]].tolist(), (at - scan.first[line] + bases[line]).tolist(), strict=True):
                held.setdefault(span, []).append(tuple(place))
            n += len(at)
            if n >= ALONE:
                yield sent()
                held, n = {}, 0
    if held:
        yield sent()


def marks_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places (in columns span, least, refs) in documents larger than the smallest one, as marks."""
    for batch in batches:
        found = [np.empty((4, 0), "i8")]
        for span, least, refs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            doc, tag, start = places_of(refs, len(refs) // 16)
            later = doc > least
            found.append(np.stack([doc[later], tag[later], start[later], np.full(later.sum(), check_of(span))]))
        doc, tag, start, check = np.concatenate(found, axis=1)
        columns = [pa.array(doc), pa.array(tag.astype("i4")), pa.array(start.astype("i4")), pa.array(np.ones(len(doc), "i4")), pa.array(check)]
        yield pa.record_batch(columns, ["doc", "tag", "start", "n", "check"])


def check_of(span: bytes) -> int:
    """Hash of words joined by single spaces, the same as Spark's xxhash64."""
    h = xxhash.xxh64_intdigest(span, 42)
    return h - (1 << 64) if h >> 63 else h


def marked_windows(scan: Scan, doc: np.ndarray) -> np.ndarray:
    """For each window, whether its words also start in a smaller document. doc: by line."""
    at = scan.windows
    hashes, docs = scan.combined(scan.k)[at], doc[scan.line[at]]
    order = np.lexsort((docs, hashes))
    same = np.concatenate(([False], hashes[order][1:] == hashes[order][:-1]))
    marked = np.zeros(len(at), bool)
    repeats = same | np.append(same[1:], False)
    near = order[repeats]
    head: dict[bytes, int] = {}
    later = []
    for again, span, d in zip(same[repeats].tolist(), scan.packed(at[near], np.ones(len(near), "i8")), docs[near].tolist(), strict=True):
        if not again:
            head = {}
        later.append(head.setdefault(span, d) < d)  # equal hashes: the bytes decide; documents come in order
    marked[near] = later
    return marked


MARKS = "doc long, tag int, start int, n int, check long"


def marks_of(bucket: pd.DataFrame, k: int) -> pd.DataFrame:
    """Marks (doc, tag, start, n windows, check) of one bucket."""
    open_ = zstandard.ZstdDecompressor().decompress
    packs: list[bytes] = []
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for blob, refs in zip(bucket["packs"], bucket["refs"], strict=True):
        lines, raw = open_(blob).split(b"\n"), open_(refs)
        n = len(lines)
        packs += lines
        for part, values in zip(parts, (np.frombuffer(raw, "<u4", n), *places_of(raw, n, 4 * n)), strict=True):
            part.append(values)
    least, doc, tag, start = (np.concatenate(p) for p in parts)
    order = np.argsort(least, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(least[order]) != 0)))
    # Groups of one string, or of strings of one document, are left out.
    size = np.diff(np.append(first, len(order)))
    low, high = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
    out = []
    chunk: list[int] = []
    held = 0

    def judged() -> None:
        lines = np.array(chunk)
        scan = Scan([packs[i] for i in chunk], k)
        at = scan.windows[marked_windows(scan, doc[lines])]
        if len(at):
            cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1] + 1)))
            at, n = at[cut], np.diff(np.append(cut, len(at)))
            line = scan.line[at]
            out.append((doc[lines][line], tag[lines][line], start[lines][line] + at - scan.first[line], n, np.array([check_of(s) for s in scan.packed(at, n)], "i8")))

    for i in np.flatnonzero(low < high).tolist():
        group = order[first[i] : first[i] + size[i]].tolist()
        chunk += group
        held += sum([len(packs[j]) for j in group])
        if held >= GROUP:
            judged()
            chunk, held = [], 0
    if chunk:
        judged()
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, "i8")] * 5
    return pd.DataFrame(dict(zip(("doc", "tag", "start", "n", "check"), columns, strict=True))).astype({"doc": "i8", "tag": "i4", "start": "i4", "n": "i4", "check": "i8"})


def repeated_windows(docs: DataFrame, k: int = 13) -> DataFrame:
    """Marks: doc, tag, start, n, check. docs: columns doc (long), tag (int) and text, no nulls in the first two.

    The n windows from word `start` on of a document also start in a smaller document; check is a hash of their words.
    """
    counted = docs.mapInArrow(partial(count_minimisers, k=k), "least long, n long, size long")
    counted = checkpointed(counted.groupBy("least").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).where(F.col("least").isNull() | (F.col("n") > CROWD)))
    runs, size = counted.where("least is null").select(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, math.ceil(size / BUCKET))
    most = max(CROWD, runs // (8 * buckets), runs // CROWDED)
    crowded = np.array([r.least for r in counted.where(F.col("least").isNotNull() & (F.col("n") > most)).select("least").collect()], "i8").view("u8")
    sent = docs.mapInArrow(partial(pack_super_kmers, k=k, buckets=buckets, crowded=crowded), Outbox.schema)

    def judged(bucket: pd.DataFrame) -> pd.DataFrame:
        return marks_of(bucket, k)

    marks = sent.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInPandas(judged, MARKS)
    if len(crowded):
        alone = checkpointed(docs.mapInArrow(partial(single_windows, k=k, crowded=crowded), "span binary, low long, high long, refs binary"))
        least = alone.groupBy("span").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most")
        found = alone.join(least.select("span", "least"), "span").where("high > least").select("span", "least", "refs")
        marks = marks.unionByName(found.mapInArrow(marks_alone, MARKS))
    return marks


def applied(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Replace column marks by n_words, n_removed, kept_sha256 and the text by the kept text."""
    for batch in (whole.slice(at, APPLIED) for whole in batches for at in range(0, whole.num_rows, APPLIED)):
        names = batch.schema.names
        counts: list[list] = [[], [], []]
        texts = []
        for text, marks in zip(batch.column(names.index("text")).cast(pa.binary()).to_pylist(), batch.column(names.index("marks")).to_pylist(), strict=True):
            found = (text or b"").split()
            gone = np.zeros(len(found), bool)
            for m in marks or []:
                end = m["start"] + m["n"] + k - 1
                if end <= len(found) and check_of(b" ".join(found[m["start"] : end])) == m["check"]:
                    gone[m["start"] : end] = True
            keep = [w for w, g in zip(found, gone.tolist(), strict=True) if not g] if gone.any() else found
            for column, value in zip(counts, (len(found), len(found) - len(keep), hashlib.sha256(b" ".join(keep)).hexdigest()), strict=True):
                column.append(value)
            texts.append(cut(text, gone) if len(keep) < len(found) else text)
        columns = {n: batch.column(n) for n in names if n not in ("text", "marks")}
        columns |= {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_words": pa.array(counts[0], pa.int64())}
        columns |= {"n_removed": pa.array(counts[1], pa.int64()), "kept_sha256": pa.array(counts[2], pa.string())}
        yield pa.RecordBatch.from_pydict(columns)


def cut(text: bytes, gone: np.ndarray) -> bytes:
    """The kept stretches of a text as they stand, one to a line."""
    spans = [m.span() for m in WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True]))))
    return b"\n".join(text[spans[a][0] : spans[z - 1][1]] for a, z in zip(edges[::2], edges[1::2], strict=True))


def deduplicated(docs: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text", with_rows: bool = True) -> DataFrame:
    """row (all columns of docs, if asked for), doc_id, text (what is kept), n_words, n_removed and kept_sha256."""
    ident = col(id_col).cast("long")
    order = F.coalesce(ident, F.lit(LAST)).alias("doc")
    tag = F.xxhash64(col(text_col)).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("tag")
    marks = repeated_windows(docs.select(order, tag, col(text_col).alias("text")), k)
    # Copies of a row give equal marks, so sets stay as small as a text allows.
    marks = marks.groupBy(F.col("doc").alias("marked"), F.col("tag").alias("marked_tag")).agg(F.collect_set(F.struct("start", "n", "check")).alias("marks"))
    rows = docs.select(*([sealed(docs)] if with_rows else []), ident.alias("doc_id"), order, tag, col(text_col).alias("text"))
    rows = rows.join(marks.hint("shuffle_hash"), (F.col("doc") == F.col("marked")) & (F.col("tag") == F.col("marked_tag")), "left").drop("doc", "tag", "marked", "marked_tag")
    more = {"text": T.StringType(), "n_words": T.LongType(), "n_removed": T.LongType(), "kept_sha256": T.StringType()}
    schema = T.StructType([f for f in rows.schema if f.name not in ("text", "marks")] + [T.StructField(n, t) for n, t in more.items()])
    return rows.mapInArrow(partial(applied, k=k), schema)
