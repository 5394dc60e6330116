"""Trie of the common prefixes of conversations, by van Emde Boas recursion over depth.

A block of 2k depths is cut in half. The upper half of each sequence names the cut prefix: its name is a hash of the name where the
block begins and of the half's own turns. Below it the lower half is a sequence of a forest of its own, so that both halves recur at
once; at the end each depth has a name, and equal names are one node. Names need no shuffle: the recursion runs within segments of
`SEGMENT` turns, and once more over the segments of a longer conversation.

Totals go the other way. In round r the roots of the lower forests of 2**r depths, whose totals are complete by then, are grafted:
each adds its total to the 2**r nodes above it in the upper half. A node is grafted once, so a round moves at most half as many rows as there are
nodes, and there are as many rounds as the depth has bits.

Turns are numbered after a sort by range, so that a conversation of any length is spread over tasks. Ids of conversations that end in a node are
packed in their order into strings, and a hash goes over the strings of one node, never over its rows.

Defined results: rows with a null conv_id take no part; null roles and texts are empty; a null turn comes first, and turns of equal
number come in the order of a hash of role and text, repeated rows one after the other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.llm.common import checkpointed, col

#: Turns in a segment (a power of two), and bytes of ids that are packed into one string.
SEGMENT, PACKED = 1024, 1 << 20
ROOT = bytes(16)
NOTHING = hashlib.sha256(b"").hexdigest()


def combined(a: bytes, b: bytes) -> bytes:
    return hashlib.blake2b(a + b, digest_size=16).digest()


def halves(keys: list[bytes]) -> list[list[bytes]]:
    """Names of the aligned blocks of 1, 2, 4, ... keys; a block's name comes from those of its halves."""
    levels = [keys]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([combined(below[i], below[i + 1]) for i in range(0, len(below) - 1, 2)])
    return levels


def prefix_names(start: bytes, keys: list[bytes]) -> list[bytes]:
    """Names of all prefixes, from the empty one, which is `start`. The prefix of d keys is cut before its last block of d's lowest bit."""
    levels, names = halves(keys), [start]
    for d in range(1, len(keys) + 1):
        block = d & -d
        names.append(combined(names[d - block], levels[block.bit_length() - 1][d // block - 1]))
    return names


def numbered(turns: DataFrame) -> DataFrame:
    """Adds pos, from 0, to conv_id, turn, key, size: sorted by range over all tasks, so no conversation has to fit in one."""
    spark = turns.sparkSession
    order = ["conv_id", F.col("turn").asc_nulls_first(), "key", "row"]
    # The checkpoint fixes row, so that equal rows have one order.
    held = checkpointed(turns.withColumn("row", F.monotonically_increasing_id()))
    placed = checkpointed(held.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "size", F.spark_partition_id().alias("part")))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and the last conversation of a part, with their numbers of turns."""
        part, first, last = None, [None, 0], [None, 0]
        for batch in batches:
            ids, n = np.unique(batch.column(0).to_numpy(), return_counts=True)
            for c, m in zip(ids.tolist(), n.tolist(), strict=True):
                part = batch.column(1)[0].as_py()
                first = [c, 0] if first[0] is None else first
                if c == first[0]:
                    first[1] += m
                last = [c, last[1] + m if c == last[0] else m]
        rows = [] if part is None else [(part, *first)] if first[0] == last[0] else [(part, *first), (part, *last)]
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["part", "conv_id", "n"])

    before: dict[int, tuple[int, int]] = {}  # of the first conversation of each part: its turns in earlier parts
    held_by, so_far = None, 0
    for part, conv, n in sorted(map(tuple, placed.select("conv_id", "part").mapInArrow(ends, "part int, conv_id long, n long").collect())):  # two rows a part
        so_far = so_far if conv == held_by else 0
        before.setdefault(part, (conv, so_far))
        held_by, so_far = conv, so_far + n
    sent = spark.sparkContext.broadcast(before)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = reached = None
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            if conv is None:
                conv, reached = sent.value[batch.column(3)[0].as_py()]
            starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            base = np.where(ids[starts] == conv, reached - starts, -starts)
            pos = np.arange(len(ids)) + np.repeat(base, np.diff(np.append(starts, len(ids))))
            conv, reached = int(ids[-1]), int(pos[-1]) + 1
            yield pa.record_batch([batch.column(0), pa.array(pos), batch.column(1), batch.column(2)], ["conv_id", "pos", "key", "size"])

    return placed.mapInArrow(count, "conv_id long, pos long, key binary, size int")


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 0), key (16 bytes that stand for role and text) and size (code points of the text)."""
    role, text = (F.coalesce(col(c), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = conversations.where(col(conv_col).isNotNull())
    return checkpointed(numbered(rows.select(col(conv_col).cast("long").alias("conv_id"), col(turn_col).alias("turn"), key.alias("key"), F.length(text).alias("size"))))


def rebuilt(turns: DataFrame, every: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, key, size, n) and conversations (conv_id, n): c begins with the first h turns of the one before it whose
    id `every` divides, and goes on with its own turns after its first h; h = crc32(c) modulo `heads`. At most 2 * every conversations share one beginning."""
    own = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("n_own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = own.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % every})
    convs = convs.join(own.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base")), "base", "left")
    lent = F.least("h", F.coalesce("n_base", F.lit(0).cast("long")))
    convs = convs.select("conv_id", "base", "h", lent.alias("lent"), (lent + F.greatest(F.lit(0).cast("long"), F.col("n_own") - F.col("h"))).alias("n"))
    convs = checkpointed(convs)
    rest = turns.join(convs, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "key", "size", "n")
    first = turns.where(F.col("pos") < heads - 1).withColumnRenamed("conv_id", "base").join(convs, "base").where("pos < h")
    return first.select("conv_id", "pos", "key", "size", "n").unionByName(rest), convs.select("conv_id", "n")


def named(turns: DataFrame) -> DataFrame:
    """conv_id, seg, n, path (the names of the prefixes from the segment's first depth on) and sizes, for each segment of SEGMENT turns."""
    turn = F.array_sort(F.collect_list(F.struct("pos", "key", "size")))
    segments = turns.groupBy("conv_id", F.floor(F.col("pos") / SEGMENT).alias("seg")).agg(F.max("n").alias("n"), turn.alias("turn"))
    segments = checkpointed(segments.select("conv_id", "seg", "n", "turn.key", "turn.size"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            yield pa.record_batch([batch.column("conv_id"), batch.column("seg"), pa.array([halves(k)[-1][0] for k in keys], pa.binary())], ["conv_id", "seg", "name"])

    # The same recursion over whole segments, for conversations of more than one.
    whole = segments.where((F.col("n") > SEGMENT) & (F.size("key") == SEGMENT)).mapInArrow(cut, "conv_id long, seg long, name binary")
    chain = whole.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", "name"))), lambda x: x["name"]).alias("names"))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prefix_names(ROOT, keys) for keys in batch.column("names").to_pylist()]
            yield pa.record_batch([batch.column("conv_id"), pa.array(found, pa.list_(pa.binary()))], ["conv_id", "starts"])

    starts = chain.mapInArrow(chained, "conv_id long, starts array<binary>").select("conv_id", "starts", F.posexplode("starts").alias("seg", "start"))
    starts = starts.select("conv_id", F.col("seg").cast("long").alias("seg"), "start", F.try_element_at("starts", (F.col("seg") + 2)).alias("after"))

    def path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for start, after, keys in zip(*(batch.column(c).to_pylist() for c in ("start", "after", "key")), strict=True):
                names = prefix_names(start or ROOT, keys)
                if after and len(keys) == SEGMENT:
                    names[-1] = after
                paths.append(names)
            yield pa.record_batch([*(batch.column(c) for c in ("conv_id", "seg", "n")), pa.array(paths, pa.list_(pa.binary())), batch.column("size")], ["conv_id", "seg", "n", "path", "sizes"])

    if not segments.where("seg > 0").head(1):
        joined = segments.withColumns({"start": F.lit(None).cast("binary"), "after": F.lit(None).cast("binary")})
    else:
        joined = segments.join(starts, ["conv_id", "seg"], "left")
    return checkpointed(joined.mapInArrow(path, "conv_id long, seg long, n long, path array<binary>, sizes array<int>"))


def digests(ends: DataFrame) -> DataFrame:
    """id and sha: SHA-256 of the decimal conv_ids of each id in ascending order, joined by commas.

    Sorted by range, so that the conversations of one id may lie in many tasks. What is whole within a task is hashed there; the rest goes on as strings.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A hash for each id that begins and ends here, strings for the first and last id and for large ones."""
        node, held, size, at, open_ = None, [], 0, None, True
        out: list[tuple] = []

        def closed(last: bool) -> None:
            if open_ or last:
                out.append((node, at, ",".join(held).encode(), None))
            else:
                out.append((node, at, None, hashlib.sha256(",".join(held).encode()).hexdigest()))

        def sent() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.binary(), pa.string()), strict=True)]
            out.clear()
            return pa.record_batch(columns, ["id", "at", "ids", "sha"])

        for batch in batches:
            for i, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i != node or size >= PACKED:
                    if node is not None:
                        open_ = open_ or i == node
                        closed(False)
                    open_ = node is None or i == node
                    node, held, size, at = i, [], 0, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
            if len(out) > 10_000 or sum(len(r[2] or b"") for r in out) > PACKED:
                yield sent()
        if node is not None:
            closed(True)
            yield sent()

    packed = checkpointed(ends.repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(pack, "id binary, at long, ids binary, sha string"))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            out = []
            for i, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i == node:
                    sha.update(b",")
                else:
                    if node is not None:
                        out.append((node, sha.hexdigest()))
                    node, sha = i, hashlib.sha256()
                sha.update(ids)
            yield pa.record_batch([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.binary(), pa.string()))], ["id", "sha"])
        if node is not None:
            yield pa.record_batch([pa.array([node]), pa.array([sha.hexdigest()])], ["id", "sha"])

    open_ = packed.where("sha is null").repartition("id").sortWithinPartitions("id", "at").select("id", "ids")
    return packed.where("sha is not null").select("id", "sha").unionByName(open_.mapInArrow(gathered, "id binary, sha string"))


def above(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """id, block, at and up: the names of the `block` nodes above each node in the upper half where it is grafted, from depth `at` on. Blocks over a segment give a row for each."""
    block = F.expr("depth & -depth")
    rows = nodes.where("depth > 0").select("id", "conv_id", "depth", block.alias("block"))
    first, last = F.floor((F.col("depth") - F.col("block")) / SEGMENT), F.floor((F.col("depth") - 1) / SEGMENT)
    rows = rows.select("id", "conv_id", "depth", "block", F.explode(F.sequence(first, last)).alias("seg"))
    start = F.greatest(F.lit(0).cast("long"), F.col("depth") - F.col("block") - F.col("seg") * SEGMENT)
    joined = rows.join(segments.select("conv_id", "seg", "path"), ["conv_id", "seg"])
    return joined.select("id", "block", (F.col("seg") * SEGMENT + start).alias("at"), F.slice("path", start.cast("int") + 1, F.least("block", F.lit(SEGMENT)).cast("int")).alias("up"))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node. turns: conv_id, pos, key, size, n; convs: conv_id and n, its number of turns, perhaps 0.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, all as the smallest members, members and subtrees say.
    """
    segments = named(turns)
    part = F.posexplode(F.arrays_zip(F.slice("path", F.lit(2), F.size("sizes")).alias("id"), F.slice("path", F.lit(1), F.size("sizes")).alias("parent"), F.col("sizes").alias("size")))
    members = segments.select("conv_id", "seg", "n", part.alias("i", "node")).select("conv_id", "n", (F.col("seg") * SEGMENT + F.col("i") + 1).alias("depth"), "node.id", "node.parent", "node.size")
    counts = (F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("size").alias("size"))
    nodes = members.groupBy("id", "parent").agg(*counts)
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.select(F.lit(ROOT).alias("id"), F.lit(None).cast("binary").alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).alias("size"))
    nodes = checkpointed(nodes.unionByName(top))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = checkpointed(nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("size")}))
    deepest = nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    paths = checkpointed(above(nodes, segments))
    sums = (F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    grafted: list[DataFrame] = []
    for r in range(int(deepest).bit_length()):
        block = F.expr("depth & -depth") == 1 << r
        roots = nodes.where(block).select("id", "leaves", "saved")
        for earlier in grafted:
            roots = roots.unionByName(earlier.where(block).select("id", "leaves", "saved"))
        total = roots.groupBy("id").agg(*sums)
        up = paths.where(F.col("block") == 1 << r).join(total, "id").select("leaves", "saved", "at", F.posexplode("up").alias("i", "id"))
        grafted.append(checkpointed(up.groupBy("id", (F.col("at") + F.col("i")).alias("depth")).agg(*sums)))
    totals = nodes.select("id", "leaves", "saved")
    for each in grafted:
        totals = totals.unionByName(each.select("id", "leaves", "saved"))
    ends = members.where("depth = n").select("id", "conv_id").unionByName(convs.where("n = 0").select(F.lit(ROOT).alias("id"), "conv_id"))
    whole = nodes.drop("leaves", "saved").join(totals.groupBy("id").agg(*sums), "id").join(digests(ends), "id", "left")
    # Many nodes may share a parent: both sides lie in checkpoints, so that Spark can split the join there.
    whole, parents = checkpointed(whole), nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends_sha = F.coalesce("sha", F.lit(NOTHING)).alias("ends_sha256")
    return whole.join(parents, "parent", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), ends_sha)


def conversation_trie(conversations: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """The trie of conversations that were rebuilt as `rebuilt` says."""
    return trie(*rebuilt(turns_of(conversations), every, heads))
