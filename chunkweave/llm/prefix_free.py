"""Exact deduplication of byte strings by prefix-free parsing.

A string of `k` bytes that also starts in a smaller document is removed, byte by byte, from the larger one.
1. A rolling hash triggers: the `WIDTH` bytes of least hash in a window of k bytes. Windows in a row with one trigger make a phrase, which reaches
   from the first of them to the end of the last. What triggers depends on the window's bytes alone, so equal windows lie at the same distance from
   equal triggers, and no window lies in phrases of two triggers. One pass counts different phrases by trigger; crowded triggers come last in the order of hashes.
2. Each task parses its texts into a dictionary of different phrases and a parse, the places of each. Of the places of a phrase only those in its smallest
   document go on with the phrase, to the bucket of its trigger; those in larger documents are covered already. So a repetitive corpus sends its
   dictionary, not its text.
3. A bucket merges the dictionaries. Places of a phrase beyond its smallest document are covered. The windows of different phrases of one trigger are put in
   suffix order, as far as k bytes tell them apart: equal neighbours, compared byte for byte, form one class, and those in a larger document than the class's smallest are covered.
4. Windows whose triggers are all crowded travel alone: an aggregation finds their smallest document, a join that can be split marks the others.
5. Marks go in packed form to their documents, whose texts stream past them and are cut.

Strings are judged on the input and never cross documents. A mark carries a hash of the bytes it covers, so that it takes no effect on another text of the same id.

Defined results: a null or empty text has no bytes; null ids count as larger than all others and do not cover each other; rows that repeat an id
don't cover each other; texts shorter than k bytes stay; an empty table gives an empty result; other columns are
ignored. What is kept is bytes: a cut may fall within a character. Ids have to be whole numbers, or strings of such.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.llm.common import checkpointed, col
from chunkweave.llm.substring import CROWD, CROWDED, LAST, NONE, Crowd, mixed, powers

#: Bytes of a trigger.
WIDTH = 8
#: Bytes scanned at once, bytes of a long text in one line, bytes of phrases in a bucket and of texts in a partition, and of what a task holds before it sends.
GROUP, SEGMENT, BUCKET, FLUSH = 1 << 20, 1 << 20, 24 << 20, 32 << 20
#: A trigger's phrases in a batch are counted if they are more; places of windows alone that are gathered before they are sent.
FEW, ALONE = 3, 200_000
U = np.uint64


class Parse:
    """Lines of bytes one after the other: rolling sums, windows that stay within a line, and phrases."""

    def __init__(self, lines: list[bytes], k: int) -> None:
        self.buf, self.k = b"".join(lines), k
        raw = np.frombuffer(self.buf, "u1")
        up, self.down = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, "u8")
        np.cumsum((raw.astype("u8") + U(1)) * up[: len(raw)], out=self.sums[1:])
        size = np.fromiter(map(len, lines), "i8", len(lines))
        self.stops = np.cumsum(size)
        self.first = self.stops - size
        good = np.ones(max(0, len(raw) - k + 1), bool)
        over = (self.stops[:, None] - 1 - np.arange(k - 1)).ravel()
        good[over[(over >= 0) & (over < len(good))]] = False
        self.windows = np.flatnonzero(good)

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the bytes from a to b, wherever these stand."""
        return mixed((self.sums[b] - self.sums[a]) * self.down[a])

    def triggers(self, crowd: Crowd = NONE) -> np.ndarray:
        """The least hash of WIDTH bytes in each window; crowded ones last, with the top bit set."""
        size = len(self.buf) - WIDTH + 1
        if size < self.k - WIDTH + 1:
            return np.empty(0, "u8")
        m = crowd.last(mixed((self.sums[WIDTH:] - self.sums[:-WIDTH]) * self.down[:size]) >> U(1))
        have, want = 1, self.k - WIDTH + 1
        while have < want:
            step = min(have, want - have)
            m = np.minimum(m[:-step], m[step:])
            have += step
        return m[self.windows]

    def phrases(self, crowd: Crowd = NONE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Trigger, first byte and number of windows of each phrase. A run of bytes that repeats is cut, so phrases are short."""
        least, at = self.triggers(crowd), self.windows
        if not len(at):
            return least, at, at
        new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])))
        turn = np.arange(len(at))
        cut = np.flatnonzero((turn - np.maximum.accumulate(np.where(new, turn, 0))) % (self.k - WIDTH + 1) == 0)
        return least[cut], at[cut], np.diff(np.append(cut, len(at)))

    def strings(self, first: np.ndarray, stop: np.ndarray) -> list[bytes]:
        buf = self.buf
        return [buf[a:b] for a, b in zip(first.tolist(), stop.tolist(), strict=True)]


def lines_of(texts: list[bytes | None], over: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Lines of about GROUP bytes in all, with the text's number and the place of the first byte of each. Long texts are cut into lines that share `over` bytes."""
    lines: list[bytes] = []
    rows: list[int] = []
    bases: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        for base in range(0, len(text or b""), SEGMENT):
            lines.append(text[base : base + SEGMENT + over])
            rows.append(i)
            bases.append(base)
            held += len(lines[-1])
            if held >= GROUP:
                yield lines, np.array(rows), np.array(bases)
                lines, rows, bases, held = [], [], [], 0
    if lines:
        yield lines, np.array(rows), np.array(bases)


def parses(texts: list[bytes | None], k: int) -> Iterator[tuple[Parse, np.ndarray, np.ndarray]]:
    for lines, rows, bases in lines_of(texts, k - 1):
        yield Parse(lines, k), rows, bases


def raw_texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()


def count_phrases(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Triggers with more than FEW different phrases in a batch, with counts; under null the number of different phrases and of their bytes."""
    for batch in batches:
        least, whole, size = [np.empty(0, "u8")], [np.empty(0, "u8")], [np.empty(0, "i8")]
        for parse, _, _ in parses(raw_texts(batch), k):
            found, first, n = parse.phrases()
            least.append(found)
            whole.append(parse.hashes(first, first + n + k - 1))
            size.append(n + k - 1)
        once = np.unique(np.concatenate(whole), return_index=True)[1]
        found, n = np.unique(np.concatenate(least)[once], return_counts=True)
        found, n = found[n > FEW], n[n > FEW]
        total = int(np.concatenate(size)[once].sum())
        yield pa.record_batch([pa.array([None, *found.view("i8").tolist()], pa.int64()), pa.array([len(once), *n.tolist()], pa.int64()), pa.array([total] + [0] * len(n), pa.int64())], ["least", "n", "size"])


def squeezed(*arrays: np.ndarray) -> bytes:
    """Columns of numbers, byte by byte, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(a.view("u1").reshape(len(a), -1).T).tobytes() for a in arrays))


def opened(blob: bytes, n: int, kinds: tuple[str, ...]) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, "u1", n * width, at).reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


#: doc, as gaps, tag, start, windows and check of a mark.
MARK = ("<i8", "<u2", "<u4", "<u4", "<u8")


class Marks:
    """Marks gathered by the partition of their documents."""

    def __init__(self, dests: int) -> None:
        self.dests = dests
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, doc: np.ndarray, tag: np.ndarray, start: np.ndarray, n: np.ndarray, check: np.ndarray) -> None:
        if len(doc):
            self.held.append((doc.astype("i8"), tag.astype("i8"), start.astype("i8"), n.astype("i8"), check))
            self.n += len(doc)

    def rows(self) -> list[tuple[int, bytes]]:
        """Partition and packed marks."""
        if not self.held:
            return []
        doc, tag, start, n, check = (np.concatenate(c) for c in zip(*self.held, strict=True))
        dest = dest_of(doc, tag, self.dests)
        order = np.lexsort((start, doc, dest))
        out = []
        for at in np.split(order, np.flatnonzero(np.diff(dest[order])) + 1):
            columns = (np.diff(doc[at], prepend=0), tag[at], start[at], n[at], check[at])
            out.append((int(dest[at[0]]), len(at).to_bytes(8, "little") + squeezed(*(c.astype(kind) for c, kind in zip(columns, MARK, strict=True)))))
        self.held, self.n = [], 0
        return out


def marks_in(body: bytes) -> tuple[np.ndarray, ...]:
    doc, *rest = opened(body[8:], int.from_bytes(body[:8], "little"), MARK)
    return np.cumsum(doc), *(c.astype("i8") for c in rest[:-1]), rest[-1]


def dest_of(doc: np.ndarray, tag: np.ndarray, dests: int) -> np.ndarray:
    return (mixed(mixed(doc.view("u8")) + tag.astype("u8")) % U(dests)).astype("i8")


SENT = "bucket int, dest int, packs binary, refs binary"


def sent_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "dest", "packs", "refs"])


class Dictionary:
    """The different phrases of some texts and their places."""

    def __init__(self, buckets: int, dests: int) -> None:
        self.buckets, self.marks = buckets, Marks(dests)
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.parse: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, phrases: list[bytes], *columns: np.ndarray) -> None:
        """columns: trigger, doc, tag, start, windows and hash of each phrase."""
        self.parse.append((np.fromiter(map(self.number.__getitem__, phrases), "i8", len(phrases)), *columns))
        self.size += sum(map(len, phrases))

    def sent(self) -> list[tuple]:
        """Phrases with their places in the smallest document, by bucket; marks of the other places, by the partition of the document."""
        if not self.parse:
            return []
        phrase, least, doc, tag, start, n, check = (np.concatenate(c) for c in zip(*self.parse, strict=True))
        low = np.full(len(self.number), LAST)
        np.minimum.at(low, phrase, doc)
        later = doc > low[phrase]
        self.marks.add(doc[later], tag[later], start[later], n[later], check[later])
        rows = [(dest % self.buckets, dest, None, body) for dest, body in self.marks.rows()]
        phrase, least, doc, tag, start = (c[~later] for c in (phrase, least, doc, tag, start))
        key = mixed(least)
        bucket = (key % U(self.buckets)).astype("i8")
        order = np.lexsort((phrase, bucket))
        texts = list(self.number)
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            head = np.flatnonzero(np.diff(phrase[at], prepend=-1))
            own = [texts[i] for i in phrase[at[head]].tolist()]
            sizes, places = np.fromiter(map(len, own), "<u4", len(own)), np.diff(np.append(head, len(at))).astype("<u4")
            first = squeezed(sizes, (key[at[head]] >> U(32)).astype("<u4"), places)
            refs = squeezed(np.diff(doc[at], prepend=0).astype("<i8"), tag[at].astype("<u2"), start[at].astype("<u4"))
            rows.append((int(bucket[at[0]]), -1, squeeze(b"".join(own)), b"".join([len(own).to_bytes(8, "little"), len(at).to_bytes(8, "little"), len(first).to_bytes(8, "little"), first, refs])))
        self.clear()
        return rows


def tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (null last), tag (some bits of the text's hash, which spread rows of one id), none (whether the id is null) and text."""
    ident = col(id_col).cast("long")
    tag = F.xxhash64(col(text_col)).bitwiseAND(F.lit(0xFFFF)).cast("int")
    return docs.select(F.coalesce(ident, F.lit(LAST)).alias("doc"), tag.alias("tag"), ident.isNull().alias("none"), col(text_col).alias("text"))


def parsed(batches: Iterator[pa.RecordBatch], k: int, buckets: int, dests: int, crowded: np.ndarray) -> Iterator[pa.RecordBatch]:
    held, crowd = Dictionary(buckets, dests), Crowd(crowded)
    for batch in batches:
        docs, tags = (batch.column(i).to_numpy() for i in (0, 1))
        for parse, rows, bases in parses(raw_texts(batch), k):
            least, first, n = parse.phrases(crowd)
            light = least < Crowd.TOP
            least, first, n = least[light], first[light], n[light]
            line = np.searchsorted(parse.stops, first, "right")
            stop = first + n + k - 1
            held.add(parse.strings(first, stop), least, docs[rows[line]], tags[rows[line]], first - parse.first[line] + bases[line], n, parse.hashes(first, stop))
            if held.size >= FLUSH:
                yield sent_rows(held.sent())
    if rows := held.sent():
        yield sent_rows(rows)


def alone(batches: Iterator[pa.RecordBatch], k: int, crowded: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows whose triggers are all crowded: their bytes, the smallest and largest document of some places, and these."""
    crowd = Crowd(crowded)
    held: dict[bytes, list[tuple[int, ...]]] = {}
    n = 0

    def sent() -> pa.RecordBatch:
        low, high, refs = [], [], []
        for places in held.values():
            doc, tag, start, check = np.array(places, object).T
            doc = doc.astype("i8")
            low.append(int(doc.min()))
            high.append(int(doc.max()))
            refs.append(len(doc).to_bytes(8, "little") + squeezed(np.diff(doc, prepend=0), tag.astype("<u2"), start.astype("<u4"), np.ones(len(doc), "<u4"), check.astype("<u8")))
        return pa.record_batch([pa.array(list(held), pa.binary()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(refs, pa.binary())], ["span", "low", "high", "refs"])

    for batch in batches:
        docs, tags = (batch.column(i).to_numpy() for i in (0, 1))
        for parse, rows, bases in parses(raw_texts(batch), k):
            at = parse.windows[parse.triggers(crowd) >= Crowd.TOP]
            line = np.searchsorted(parse.stops, at, "right")
            columns = (docs[rows[line]], tags[rows[line]], at - parse.first[line] + bases[line], parse.hashes(at, at + k))
            for span, *place in zip(parse.strings(at, at + k), *(c.tolist() for c in columns), strict=True):
                held.setdefault(span, []).append(tuple(place))
            n += len(at)
            if n >= ALONE:
                yield sent()
                held, n = {}, 0
    if held:
        yield sent()


def marks_alone(batches: Iterator[pa.RecordBatch], dests: int) -> Iterator[pa.RecordBatch]:
    """Marks of the places (columns least and refs) in documents larger than the smallest one."""
    marks = Marks(dests)
    for batch in batches:
        for least, refs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            doc, *rest = marks_in(refs)
            marks.add(doc[doc > least], *(c[doc > least] for c in rest))
        if marks.n >= ALONE:
            yield mark_rows(marks.rows())
    if rows := marks.rows():
        yield mark_rows(rows)


def mark_rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["dest", "body"])


def covered_windows(parse: Parse, doc: np.ndarray) -> np.ndarray:
    """For each window, whether its bytes also start in a line of a smaller document. doc: by line."""
    at, k = parse.windows, parse.k
    docs = doc[np.searchsorted(parse.stops, at, "right")]
    hashes = parse.hashes(at, at + k)
    order = np.argsort(hashes)
    first = np.flatnonzero(np.concatenate(([True], hashes[order][1:] != hashes[order][:-1])))
    size = np.diff(np.append(first, len(order)))
    covered = np.zeros(len(at), bool)
    covered[order] = docs[order] > np.repeat(np.minimum.reduceat(docs[order], first), size)
    # Equal hashes: the bytes of each covered window are compared with those of the first of its class.
    raw = np.lib.stride_tricks.sliding_window_view(np.frombuffer(parse.buf, "u1"), k)
    head = np.empty(len(at), "i8")
    head[order] = np.repeat(order[first], size)
    asked = np.flatnonzero(np.repeat(size, size)[np.argsort(order)] > 1)
    for some in np.array_split(asked, len(asked) // 50_000 + 1):
        for i in some[(raw[at[some]] != raw[at[head[some]]]).any(axis=1)].tolist():
            same = np.flatnonzero(hashes == hashes[i])
            smallest: dict[bytes, int] = {}
            for j in same.tolist():
                span = parse.buf[at[j] : at[j] + k]
                smallest[span] = min(smallest.get(span, LAST), int(docs[j]))
            for j in same.tolist():
                covered[j] = docs[j] > smallest[parse.buf[at[j] : at[j] + k]]
    return covered


def judged(bucket: pd.DataFrame, k: int, dests: int) -> pd.DataFrame:
    """dest and body: packed marks of one bucket, and those that pass through it."""
    passing = bucket[bucket["dest"] >= 0]
    open_ = zstandard.ZstdDecompressor().decompress
    marks = Marks(dests)
    packs, sizes, keys, places, docs, tags, starts = [], [], [], [], [], [], []
    for pack, refs in zip(*(bucket.loc[bucket["dest"] < 0, c] for c in ("packs", "refs")), strict=True):
        n, m, cut = (int.from_bytes(refs[i : i + 8], "little") for i in (0, 8, 16))
        packs.append(open_(pack))
        for columns, found in (((sizes, keys, places), opened(refs[24 : 24 + cut], n, ("<u4",) * 3)), ((docs, tags, starts), opened(refs[24 + cut :], m, ("<i8", "<u2", "<u4")))):
            for column, values in zip(columns, found, strict=True):
                column.append(np.cumsum(values) if column is docs else values.astype("i8"))
    if packs:
        text = b"".join(packs)
        size, key, many, doc, tag, start = (np.concatenate(c) for c in (sizes, keys, places, docs, tags, starts))
        stop, after = np.cumsum(size), np.cumsum(many)
        own = doc[after - many]  # all places of a phrase, from one task, are in one document
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
        apart = np.minimum.reduceat(own[order], first) < np.maximum.reduceat(own[order], first)
        members = order[np.repeat(apart, np.diff(np.append(first, len(order))))]
        # One trigger after the other, some at once; a trigger's phrases stay together.
        ends = np.cumsum(size[members])
        new = np.flatnonzero(np.diff(key[members], append=-1))
        cuts = new[np.flatnonzero(np.diff((ends[new] // GROUP), prepend=-1))] + 1 if len(new) else new
        for some in np.split(members, cuts):
            if len(some):
                judge(marks, text, some, stop - size, stop, own, (after - many, many, doc, tag, start), k)
    rows = [*zip(passing["dest"].tolist(), passing["refs"].tolist(), strict=True), *marks.rows()]
    return pd.DataFrame(rows, columns=["dest", "body"]).astype({"dest": "i4"})


def judge(marks: Marks, text: bytes, some: np.ndarray, begin: np.ndarray, stop: np.ndarray, own: np.ndarray, refs: tuple[np.ndarray, ...], k: int) -> None:
    """Add the marks of some phrases, all those of their triggers."""
    at, many, doc, tag, start = refs
    number: dict[bytes, int] = defaultdict(count().__next__)
    phrase = np.fromiter((number[text[a:b]] for a, b in zip(begin[some].tolist(), stop[some].tolist(), strict=True)), "i8", len(some))
    parse = Parse(list(number), k)
    low = np.full(len(number), LAST)
    np.minimum.at(low, phrase, own[some])

    def add(entry: np.ndarray, skip: np.ndarray, n: np.ndarray) -> None:
        """Marks of n windows, from the skip-th on, at all places of these entries (numbers in some)."""
        m = many[some[entry]]
        each = np.repeat(np.arange(len(entry)), m)
        place = np.repeat(at[some[entry]] - np.cumsum(m) + m, m) + np.arange(m.sum())
        a = parse.first[phrase[entry]] + skip
        marks.add(doc[place], tag[place], start[place] + skip[each], n[each], parse.hashes(a, a + n + k - 1)[each])

    later = np.flatnonzero(own[some] > low[phrase])
    add(later, np.zeros(len(later), "i8"), (stop - begin)[some[later]] - k + 1)
    # A window of a phrase's smallest document may also start in another phrase.
    window = parse.windows[covered_windows(parse, low)]
    if len(window):
        line = np.searchsorted(parse.stops, window, "right")
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(window) != 1) | (np.diff(line) != 0))))
        line, skip, n = line[cut], (window - parse.first[line])[cut], np.diff(np.append(cut, len(window)))
        rest = np.flatnonzero(own[some] == low[phrase])
        rest = rest[np.argsort(phrase[rest], kind="stable")]
        a, b = np.searchsorted(phrase[rest], line), np.searchsorted(phrase[rest], line, "right")
        each = np.repeat(np.arange(len(line)), b - a)
        entry = rest[np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange(len(each))]
        add(entry, skip[each], n[each])


TEXT = ("<i8", "u1", "<u2", "<u8", "<u4")


def packed_texts(batches: Iterator[pa.RecordBatch], dests: int) -> Iterator[pa.RecordBatch]:
    """dest and body: texts of about FLUSH bytes by partition. Equal rows travel once, with their number."""
    held: dict[tuple, int] = {}
    size = 0

    def sent() -> pa.RecordBatch:
        keys = list(held)
        doc, tag, none = (np.array([key[i] for key in keys], "i8") for i in range(3))
        copies = np.fromiter(held.values(), "i8", len(held))
        dest = dest_of(doc, tag, dests)
        order = np.argsort(dest, kind="stable")
        rows = []
        for at in np.split(order, np.flatnonzero(np.diff(dest[order])) + 1):
            texts = [keys[i][3] for i in at.tolist()]
            columns = (np.diff(doc[at], prepend=0), none[at], tag[at], np.fromiter(map(len, texts), "i8", len(texts)), copies[at])
            head = squeezed(*(c.astype(kind) for c, kind in zip(columns, TEXT, strict=True)))
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            rows.append((int(dest[at[0]]), len(at).to_bytes(8, "little") + len(head).to_bytes(8, "little") + head + body))
        return mark_rows(rows)

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(3)]
        for *key, text in zip(*columns, raw_texts(batch), strict=True):
            key = (*key, text or b"")
            if key not in held:
                size += len(key[3]) + 64
            held[key] = held.get(key, 0) + 1
            if size >= FLUSH:
                yield sent()
                held, size = {}, 0
    if held:
        yield sent()


class Cut:
    """The marks of one partition, to be taken from its texts."""

    def __init__(self, bodies: list[bytes], k: int) -> None:
        self.k = k
        found = [marks_in(b) for b in bodies]
        doc, tag, start, n, check = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, "i8"),) * 5
        key = mixed(mixed(doc.view("u8")) + tag.astype("u8"))
        order = np.lexsort((start, key))
        self.doc, self.key, self.start, self.n, self.check = (c[order] for c in (doc, key, start, n, check))

    def spans(self, doc: np.ndarray, tag: np.ndarray, texts: list[bytes]) -> list[list[tuple[int, int]]]:
        """Where each text is cut: maximal runs of bytes, as start and end."""
        k, key = self.k, mixed(mixed(doc.view("u8")) + tag.astype("u8"))
        a, b = np.searchsorted(self.key, key), np.searchsorted(self.key, key, "right")
        row = np.repeat(np.arange(len(texts)), b - a)
        at = np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange(len(row))
        stop = self.start[at] + self.n[at] + k - 1
        fits = (self.doc[at] == doc[row]) & (stop <= np.fromiter(map(len, texts), "i8", len(texts))[row])
        row, at, stop = row[fits], at[fits], stop[fits]
        # The text has to hold what the mark was made for.
        place, good, done = self.start[at], np.zeros(len(at), bool), 0
        asked = np.isin(np.arange(len(texts)), row)
        line_key = row * (1 << 40) + place // SEGMENT * SEGMENT
        for lines, rows, bases in lines_of([t if y else None for t, y in zip(texts, asked.tolist(), strict=True)], 2 * k):
            parse = Parse(lines, k)
            end = np.searchsorted(line_key, rows[-1] * (1 << 40) + bases[-1], "right")
            some = slice(done, end)
            line = np.searchsorted(rows * (1 << 40) + bases, line_key[some])
            first = parse.first[line] + place[some] - bases[line]
            good[some] = parse.hashes(first, first + stop[some] - place[some]) == self.check[at[some]]
            done = end
        row, place, stop = row[good], place[good], stop[good]
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if len(row):
            # A run ends where the next start lies beyond all ends so far; texts are kept apart by a distance that none reaches.
            far = np.maximum.accumulate(stop + row * (1 << 40))
            new = np.concatenate(([True], place[1:] + row[1:] * (1 << 40) > far[:-1]))
            head = np.flatnonzero(new)
            for r, s, e in zip(row[head].tolist(), place[head].tolist(), (far[np.append(head[1:], len(row)) - 1] - row[head] * (1 << 40)).tolist(), strict=True):
                out[r].append((s, e))
        return out


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut_texts(batches: Iterator[pa.RecordBatch], k: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a partition come together, marks (body 0) before texts."""
    names = [f.split()[0] for f in OUT.split(", ")] + ["spans", "kept"] * with_text
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.binary()] * with_text
    dest, bodies, cut = None, [], None
    for batch in batches:
        for own, is_text, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if own != dest:
                dest, bodies, cut = own, [], None
            if not is_text:
                bodies.append(body)
                continue
            cut, bodies = cut or Cut(bodies, k), []
            n, size = (int.from_bytes(body[i : i + 8], "little") for i in (0, 8))
            doc, none, tag, length, copies = opened(body[16 : 16 + size], n, TEXT)
            doc, length = np.cumsum(doc), length.astype("i8")
            whole, ends = zstandard.ZstdDecompressor().decompress(body[16 + size :]), np.cumsum(length).tolist()
            texts = [whole[e - m : e] for e, m in zip(ends, length.tolist(), strict=True)]
            columns: list[list] = [[] for _ in kinds]
            held = 0
            for i, (text, spans) in enumerate(zip(texts, cut.spans(doc, tag, texts), strict=True)):
                edges = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]) if spans else text
                row = [None if none[i] else int(doc[i]), len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()]
                row += [[{"start": a, "length": b - a} for a, b in spans], kept] * with_text
                for _ in range(int(copies[i])):
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    held += 100 + len(kept) * with_text
                    if held >= FLUSH:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
                        columns, held = [[] for _ in kinds], 0
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs within remove their shuffle files when they end, for what they wrote is a checkpoint."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def marks_of(docs: DataFrame, k: int, dests: int) -> DataFrame:
    """dest and body: packed marks of all documents (doc, tag, none, text)."""
    counted = docs.select("doc", "text").mapInArrow(partial(count_phrases, k=k), "least long, n long, size long")
    counted = checkpointed(counted.groupBy("least").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).where(F.col("least").isNull() | (F.col("n") > CROWD)))
    runs, size = counted.where("least is null").select(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, math.ceil(size / BUCKET))
    most = max(CROWD, runs // (8 * buckets), runs // CROWDED)
    crowded = np.array([r.least for r in counted.where(F.col("least").isNotNull() & (F.col("n") > most)).select("least").collect()], "i8").view("u8")
    sent = docs.mapInArrow(partial(parsed, k=k, buckets=buckets, dests=dests, crowded=crowded), SENT)

    def bucket_marks(bucket: pd.DataFrame) -> pd.DataFrame:
        return judged(bucket, k, dests)

    with shuffles_removed(docs.sparkSession):
        marks = checkpointed(sent.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInPandas(bucket_marks, "dest int, body binary"))
    if len(crowded):
        single = checkpointed(docs.mapInArrow(partial(alone, k=k, crowded=crowded), "span binary, low long, high long, refs binary"))
        least = single.groupBy("span").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most")
        found = single.join(least.select("span", "least"), "span").where("high > least").select("least", "refs")
        marks = marks.unionByName(found.mapInArrow(partial(marks_alone, dests=dests), "dest int, body binary"))
    return marks


def deduplicated(docs: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, spans (start, length) and kept (bytes), for each row of docs."""
    rows = tagged(docs, id_col, text_col)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    dests = max(1, math.ceil(size / BUCKET))
    marks = marks_of(rows, k, dests).select("dest", F.lit(0).alias("is_text"), "body")
    texts = rows.mapInArrow(partial(packed_texts, dests=dests), "dest int, body binary").select("dest", F.lit(1).alias("is_text"), "body")
    both = marks.unionByName(texts).repartitionById(dests, F.col("dest")).sortWithinPartitions("dest", "is_text")
    return both.mapInArrow(partial(cut_texts, k=k, with_text=with_text), OUT + ", spans array<struct<start: long, length: long>>, kept binary" * with_text)
