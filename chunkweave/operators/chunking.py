"""Documents to overlapping chunks that know their lines.

A chunk ends at the last separator in the second half of its window, the strongest kind of separator first; without one
it ends at the window. The next one starts `overlap` characters before that end. Chunks are stripped; blank ones take no
index. The work is narrow: one document gives many rows, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from chunkweave.functions.text import PY_WS
from chunkweave.operators.batches import slices

#: From the strongest separator to the weakest: fixed values.
SEPARATORS = ("\n\n", "\n", ". ", " ")
#: Characters whose places are listed, and whose chunks are sent, at once.
GROUP = 1 << 18
CHUNK = "source string, index int, text string, line_start int, line_end int"
#: Whether a code point is not blank; those beyond the table are not.
SOLID = np.ones(max(map(ord, PY_WS)) + 2, bool)
SOLID[[ord(c) for c in PY_WS]] = False


def check_sizes(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError(f"overlap ({overlap}) must be under the chunk size ({size})")


def places(found: np.ndarray, after: int = 0) -> memoryview:
    """Where it is true, moved on by `after`: eight bytes each, which a search by halves reads one at a time."""
    return memoryview(np.flatnonzero(found) + after)


class Layout:
    """Where some texts, one after the other, can be cut, where they are not blank, and where their lines end: listed once for all of them, so that
    overlapping windows look nothing up twice."""

    def __init__(self, texts: list[str]) -> None:
        self.text = "\0".join(texts)  # kept apart, so that no separator reaches from one into the next
        codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum(np.fromiter(map(len, texts), "i8", len(texts)) + 1) - 1
        self.spans = list(zip([0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True)) if texts else []
        self.solid = places(SOLID[np.minimum(codes, len(SOLID) - 1)])
        self.lines = places(codes == 10)
        self.cuts = []  # for each separator the places after it
        for separator in SEPARATORS:
            hit = np.ones(max(0, len(codes) - len(separator) + 1), bool)
            for i, c in enumerate(separator):
                hit &= codes[i : i + len(hit)] == ord(c)
            self.cuts.append((len(separator), places(hit, len(separator))))

    def chunks(self, begin: int, stop: int, size: int, overlap: int) -> Iterator[tuple[str, int, int]]:
        """Text, first and last line of each chunk of the text from begin to stop."""
        solid, lines, text = self.solid, self.lines, self.text
        above = bisect_left(lines, begin) - 1
        start, low = begin, bisect_left(solid, begin)
        known = [bisect_right(cuts, begin) for _, cuts in self.cuts]  # each separator's first cut beyond the start
        while low < len(solid) and solid[low] < stop:
            end = start + size
            if end < stop:
                for kind, (width, cuts) in enumerate(self.cuts):
                    k = bisect_right(cuts, end, known[kind], min(known[kind] + size, len(cuts)))
                    if k > known[kind] and cuts[k - 1] >= start + size // 2 + width:
                        end = cuts[k - 1]
                        break
            else:
                end = stop
            high = bisect_left(solid, end, low, min(low + size, len(solid)))
            if low < high:
                first, last = solid[low], solid[high - 1]
                line = bisect_left(lines, first)
                yield text[first : last + 1], line - above, bisect_left(lines, last, line) - above
            if end == stop:
                return
            start = max(end - overlap, start + 1)
            low = bisect_left(solid, start, low, min(low + size, len(solid)))
            known = [bisect_right(cuts, start, k, min(k + size, len(cuts))) for k, (_, cuts) in zip(known, self.cuts, strict=True)]


def cut(text: str, size: int, overlap: int) -> Iterator[tuple[str, int, int]]:
    """Each chunk's text, first and last line."""
    layout = Layout([text])
    return layout.chunks(0, len(text), size, overlap)


def groups(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers and texts of those that hold something, some GROUP characters at a time."""
    rows: list[int] = []
    held: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        if text:
            rows.append(row)
            held.append(text)
            size += len(text)
        if size >= GROUP:
            yield rows, held
            rows, held, size = [], [], 0
    if rows:
        yield rows, held


def chunk(documents: DataFrame, size: int = 1000, overlap: int = 150, keep: tuple[str, ...] = ()) -> DataFrame:
    """source, index (from 0), text, line_start, line_end and the columns `keep`. documents: columns source and text; null texts give no rows."""
    check_sizes(size, overlap)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for numbers, texts in groups(batch.column(1).to_pylist()):
                columns: list[list] = [[], [], [], [], []]
                layout = Layout(texts)
                for row, span in zip(numbers, layout.spans, strict=True):
                    found = list(zip(*layout.chunks(*span, size, overlap), strict=True))
                    if found:
                        n = len(found[0])
                        for column, values in zip(columns, ([row] * n, range(n), *found), strict=True):
                            column += values
                rows, index, found, first, last = (pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()), strict=True))
                kept = [batch.column(i).take(rows) for i in range(2, batch.num_columns)]
                yield pa.record_batch([batch.column(0).take(rows), index, found, first, last, *kept], ["source", "index", "text", "line_start", "line_end", *keep])

    rows = documents.select("source", "text", *keep)
    return rows.mapInArrow(chunks, T.StructType([*T.StructType.fromDDL(CHUNK).fields, *rows.schema.fields[2:]]))


class ChunkText:
    """Table function: index, text, line_start and line_end of the chunks of a text, for SQL with LATERAL."""

    def eval(self, text: str | None, size: int = 1000, overlap: int = 150) -> Iterator[tuple[int, str, int, int]]:
        check_sizes(size, overlap)
        for index, piece in enumerate(cut(text, size, overlap) if text else ()):
            yield index, *piece


def register(spark: SparkSession, name: str = "chunk_text") -> None:
    """Make chunk_text(text, size, overlap) known to SQL; rows travel as Arrow batches."""
    spark.udtf.register(name, udtf(ChunkText, returnType="index int, text string, line_start int, line_end int", useArrow=True))
