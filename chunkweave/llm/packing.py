"""Best-fit packing with certified partitions.

1. Documents are encoded where they are read; one small row for each piece goes on (no ids unless asked for).
2. Pieces are numbered and dealt by a hash of their numbers to partitions of about `per_partition` pieces, equal ones
   too, and each runs best-fit decreasing.
3. A partition is certified when its bins are as few as the largest of its lower bounds by dual-feasible
   functions. Partitions with a gap exchange their pieces: these are dealt anew among a quarter as many
   partitions, which run again; the new packing is taken if it uses fewer bins in all. With at most three
   such rounds no task gets more than 64 times `per_partition` small rows.

Defined results: a null or empty text is one piece, the end mark alone; rows with null or repeated ids are
packed as they stand; pieces of full length fill a bin each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.llm.common import checkpointed, col
from chunkweave.llm.tokens import default_vocabulary, word_ids

PER_PARTITION = 16_384


def token_pieces(docs: DataFrame, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, on demand, ids, for each piece of at most `capacity` tokens."""
    path = vocabulary or default_vocabulary()
    mark = end.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_ids(path)
        for batch in batches:
            row, piece, length, crc, held = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = memo.text(text) + mark
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        held.append(np.frombuffer(part, "<u4").astype("i4"))
            columns = {"doc_id": batch.column(0).take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32())}
            columns["start"] = pa.array([capacity * k for k in piece], pa.int64())
            columns |= {"length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                columns["ids"] = pa.array(held, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    schema = f"doc_id {rows.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(cut, schema + ", ids array<int>" * with_ids)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound on the number of bins by two families of dual-feasible functions."""
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    below, count = np.cumsum(n * size), np.cumsum(n)
    best = -(-int(below[-1]) // capacity)
    # Threshold t <= capacity / 2: lengths under t count nothing, those over capacity - t a whole bin.
    t = np.arange(1, capacity // 2 + 1)
    middle = below[capacity - t] - below[t - 1]
    best = max(best, int((-(-middle // capacity) + count[-1] - count[capacity - t]).max()))
    # Rounding to k-ths: x -> x if (k + 1) x is whole, else floor((k + 1) x) / k.
    for k in range(1, 33):
        q, rest = np.divmod((k + 1) * size, capacity)
        worth = np.where(rest == 0, k * q, (k + 1) * q)  # in units of 1 / (k (k + 1))
        best = max(best, -(-int((worth * n).sum()) // (k * (k + 1))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins. A bit set of free room finds the tightest bin."""
    order = np.argsort(-lengths, kind="stable")
    place, offset = np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8")
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, 0
    for i in order.tolist():
        size = int(lengths[i])
        if fitting := rooms >> size:
            room = size + (fitting & -fitting).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, at, bins = capacity, bins, bins + 1
        place[i], offset[i] = at, capacity - room
        if left := room - size:
            open_bins[left].append(at)
            rooms |= 1 << left
    return place, offset, bins


def pack(pieces: DataFrame, capacity: int = 4096, per_partition: int = PER_PARTITION, rounds: int = 3, seed: int = 0) -> DataFrame:
    """Adds sequence_id, offset, part_bins and part_bound to pieces (which have doc_id, piece, start, length, ids_crc32)."""
    names = "doc_id piece start length ids_crc32".split()
    kind = pieces.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, `offset` long, part long, part_bins long, part_bound long"

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy("i8")
        place, offset, bins = best_fit_decreasing(lengths, capacity)
        part = group["part"].to_numpy("i8")
        return group[[*names, "row"]].assign(sequence_id=(part << 32) + place, offset=offset, part=part, part_bins=bins, part_bound=lower_bound(lengths, capacity))

    def dealt(rows: DataFrame, n: int, turn: int) -> DataFrame:
        parts = max(1, math.ceil(n / (per_partition << 2 * turn)))
        at = F.pmod(F.xxhash64("row", F.lit(seed), F.lit(turn)), F.lit(parts)) + F.lit(turn << 24)
        return checkpointed(rows.select(*names, "row", at.alias("part")).groupBy("part").applyInPandas(fill, schema))

    def bins(rows: DataFrame) -> int:
        return rows.select("part", "part_bins").distinct().agg(F.sum("part_bins")).first()[0] or 0

    pieces = checkpointed(pieces.select(*names, F.monotonically_increasing_id().alias("row")))  # numbers that stay, whichever task runs again
    packed = dealt(pieces, pieces.count(), 0)
    done: DataFrame | None = None
    for turn in range(1, rounds + 1):
        gaps = packed.where("part_bins > part_bound")
        n, parts = gaps.agg(F.count("*"), F.count_distinct("part")).first()
        if parts < 2:
            break
        again = dealt(gaps, n, turn)
        if bins(again) >= bins(gaps):
            break
        certified = packed.where("part_bins <= part_bound")
        done = certified if done is None else done.unionByName(certified)
        packed = again
    return (packed if done is None else done.unionByName(packed)).drop("part", "row")


def packed_documents(docs: DataFrame, capacity: int = 4096, **options: object) -> DataFrame:
    """Encode, cut and pack whole documents. options: those of token_pieces but with_ids."""
    return pack(token_pieces(docs, capacity, **options), capacity)
