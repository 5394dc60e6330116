"""Batches of rows in slices, so that what a task holds in Python does not follow the size of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows that are worked on, and sent, at once.
ROWS = 1024


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows, at most so many at a time, without a copy; nothing for an empty batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
