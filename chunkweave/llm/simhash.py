"""Near-duplicates by SimHash, found through a segment-popcount embedding.

A fingerprint of 64 bits is cut into 16 segments of 4 bits; its counts of set bits are a point on a grid.
The Manhattan distance of two points never exceeds the number of differing bits. The range join within
distance 2 meets in the middle: every point goes to its own grid cell and to the cells one step away,
so two points within distance 2 share a cell, and cells with one fingerprint drop out.

The exact check works within the shared cells and makes no pairs: fingerprints differ in at most two bits
just if some bit string is within one bit of both, and its own popcounts name one of the cells that both
went to. Each fingerprint gives the one-bit neighbours that lie in a shared cell (65 at most in all), and those
with an equal neighbour are linked as a star around the smallest. So work and rows stay linear in the
number of different fingerprints, whatever the size of a group of copies.

Two bits are a narrow radius: texts whose shingles agree to 0.8 differ in 4 to 14 bits, which no bound on popcounts can
sift. `keep_one` with a similarity therefore takes further candidates from bands of least shingle hashes, and verifies
all of them, those from fingerprints too, on the whole sets of shingles. The sets of candidates are fetched once. First each band
is a star around the member that shares the largest bands: an original leads its edited copies. Then every band whose other
members still belong to several components is compared in full: its members are dealt to blocks of bounded size, and
a pair is skipped only if it is in one component already, or if the Manhattan distance of its counts of shingles by
hash, which never exceeds the number of shingles in one set alone, rules it out. A set goes to each group of its block, which is at most `SPREAD` times;
the members of larger buckets meet by the rarest of their shingles instead, of which any two similar sets share one, so unlike members don't meet at all.

Defined results: a null or empty text, or one of white space, has fingerprint 0 and links like any other;
rows with a null id get a component whose id is the smallest id in it, or null if it has none; repeated rows
share a component; an empty table gives an empty result; other columns are ignored. `keep_one` keeps all columns; of rows
that repeat id and text it keeps the one with the smallest hash of its row, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkweave.llm.common import checkpointed, col, min_labels, sealed

SEGMENTS, WIDTH = 16, 4
#: For similarity 0.8, 20 bands of 4 miss 3 pairs in 100,000.
BANDS, ROWS = 20, 4
FACTORS = np.random.default_rng(12).integers(1, 1 << 63, BANDS * ROWS, "u8") * np.uint64(2) + np.uint64(1)
#: Shingles whose bits are counted at once.
RUN = 1 << 16
#: Shingles in a block of members of one band, and counters of one member.
BLOCK, COUNTERS = 1 << 18, 256
#: A member of a bucket goes to a group for each of its blocks; of buckets with more than so many blocks members meet by rare shingles. Slots of their counts.
SPREAD, SLOTS = 64, 1 << 20


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """Hashes of all shingles, repeats included; of the whole sequence if it is shorter; none without words."""
    found = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space cuts
    joined = b" ".join(found)
    if len(found) > shingle:
        size = np.fromiter(map(len, found), "i8", len(found))
        stop = np.cumsum(size + 1) - 1
        start = (stop - size).tolist()
        spans = zip(start, stop[shingle - 1 :].tolist(), strict=False)
        return np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in spans], "<u8")
    return np.array([xxhash.xxh64_intdigest(joined, seed)] if found else [], "<u8")


def simhash(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint. A bit is set if it is in over half the hashes of the shingles."""
    raw = hashes.view("u1").reshape(-1, 8)
    ones = sum((np.unpackbits(raw[i : i + RUN], axis=1, bitorder="little").sum(0, dtype="i8") for i in range(0, len(raw), RUN)), np.zeros(64, "i8"))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def signed(data: bytes) -> int:
    return int.from_bytes(xxhash.xxh64_digest(data), "big", signed=True)


def band_keys(unique: np.ndarray) -> list[int]:
    """Keys of BANDS groups of least values under ROWS hash functions each."""
    least = np.full(BANDS * ROWS, np.iinfo("u8").max, "u8")
    for at in range(0, len(unique), 1 << 13):
        x = unique[at : at + (1 << 13), None] * FACTORS
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0))
    return [signed(bytes([i]) + least[i * ROWS : (i + 1) * ROWS].tobytes()) for i in range(BANDS)] if len(unique) else []


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """doc_id, fp (long) and text_key (a hash of the text) for each row of docs."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [simhash(shingle_hashes(t, shingle)) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(fp, pa.int64()), batch.column(2)], ["doc_id", "fp", "text_key"])

    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), F.xxhash64(col(text_col)).alias("text_key"))
    return rows.mapInArrow(hashed, f"doc_id {rows.schema[0].dataType.simpleString()}, fp long, text_key long")


def near_links(distinct: DataFrame) -> DataFrame:
    """Links a, b that join all fingerprints (column fp, each once) that differ in one or two bits."""
    counts = [f"bit_count((fp >> {WIDTH * s}) & {(1 << WIDTH) - 1})" for s in range(SEGMENTS)]
    here = " + ".join(f"shiftleft(cast({c} as bigint), {3 * s})" for s, c in enumerate(counts))
    points = distinct.select("fp", F.expr(here).alias("cell"))
    steps = [F.struct(F.col("cell"), F.lit(-1).alias("segment"), F.lit(0).alias("old"))]
    for s in range(SEGMENTS):
        at = F.expr(f"shiftrightunsigned(cell, {3 * s}) & 7")
        for step, old, there in ((1, 0, at < WIDTH), (-1, 1, at > 0)):
            moved = F.struct((F.col("cell") + F.lit(step << (3 * s))).alias("cell"), F.lit(s).alias("segment"), F.lit(old).alias("old"))
            steps.append(F.when(there, moved))
    cells = points.select("fp", F.inline(F.array_compact(F.array(*steps))))
    shared = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    bits = f"filter(transform(sequence(0, {WIDTH - 1}), b -> {WIDTH} * segment + b), p -> (shiftright(fp, p) & 1) = old)"
    middle = F.expr(f"explode(if(segment < 0, array(fp), transform({bits}, p -> (fp ^ shiftleft(1L, p)))))").alias("middle")
    met = cells.join(shared, "cell", "left_semi").select("fp", middle)
    # At most 65 fingerprints are within one bit of another one.
    groups = met.groupBy("middle").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    return groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns of a type that can be hashed."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return F.xxhash64(*[col(c) for c, kind in kinds.items() if "map<" not in kind and "variant" not in kind])


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """doc_id, text_key, row_key, fp, node (a hash of the set of shingles), size (of this set) and keys (of its bands) for each row of docs."""

    def signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, node, size, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text, shingle)
                unique = np.unique(hashes)
                fp.append(simhash(hashes))
                node.append(signed(unique.tobytes()))
                size.append(len(unique))
                keys.append(band_keys(unique))
            columns = [batch.column(0), batch.column(2), batch.column(3), *(pa.array(x, pa.int64()) for x in (fp, node, size)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, ["doc_id", "text_key", "row_key", "fp", "node", "size", "keys"])

    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), F.xxhash64(col(text_col)).alias("text_key"), row_key(docs).alias("row_key"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(signed_rows, f"doc_id {kind}, text_key long, row_key long, fp long, node long, size long, `keys` array<long>")


def labelled(marked: DataFrame) -> DataFrame:
    """fp, label (a fingerprint that names the component) and component_id for each fingerprint of marked (doc_id, fp)."""
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = min_labels(near_links(distinct.select("fp")))
    found = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    first = found.groupBy("label").agg(F.min("first").alias("component_id"))
    return checkpointed(found.join(first, "label").select("fp", "label", "component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id that links reach."""
    marked = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    return marked.join(labelled(marked), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """node, keys and held, its sorted set of shingles, for nodes (node, keys, doc_id and text_key of one of its texts)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t, shingle).view("i8")) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["node", "keys", "held"])

    asked = nodes.select("node", "keys", F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), F.xxhash64(col(text_col)).alias("text_key"))
    rows = rows.join(asked, rows["doc_id"].eqNullSafe(asked["id"]) & (rows["text_key"] == asked["key"]))
    return rows.select("node", "keys", "text").dropDuplicates(["node"]).mapInArrow(sets, "node long, `keys` array<long>, held array<long>")


def counters(held: list[np.ndarray]) -> np.ndarray:
    """Shingles of each set by the last bits of their hash. Counts are held at 255, which keeps their distance a lower bound."""
    mean = sum(map(len, held)) // len(held)
    n = min(COUNTERS, 1 << max(4, mean.bit_length()))
    return np.stack([np.minimum(np.bincount(h & (n - 1), minlength=n), 255) for h in held]).astype("u1")


def bucket_links(bucket: pd.DataFrame, key: int, crossed: bool, similarity: float) -> list[tuple[int, int]]:
    """Links that join the components of the members of one bucket, or (crossed) of two of its blocks.

    A pair is compared in the first bucket that both share. Members of many large buckets come first: they are likely centres of a group.
    """
    node, block, held = bucket["node"].to_numpy(), bucket["block"].to_numpy(), bucket["held"].tolist()
    keys = np.stack(bucket["keys"].tolist())
    place = int(np.argmax(keys[0] == key))
    size = np.array([len(h) for h in held])
    count = counters(held)
    comp = np.unique(bucket["comp"].to_numpy(), return_inverse=True)[1]
    common = np.zeros(len(node), "i8")
    for column in keys.T:
        _, back, n = np.unique(column, return_inverse=True, return_counts=True)
        common += n[back]
    waits, links = np.ones(len(node), bool), []
    for x in np.lexsort((node, -common)):
        waits[x] = False
        asked = waits & (comp != comp[x]) & (size >= similarity * size[x]) & (size[x] >= similarity * size)
        if crossed:
            asked &= block != block[x]
        at = np.flatnonzero(asked)
        at = at[~(keys[at, :place] == keys[x, :place]).any(axis=1)]
        apart = np.abs(count[at].astype("i2") - count[x]).sum(axis=1)
        at = at[apart * (1 + similarity) <= (1 - similarity) * (size[at] + size[x]) + 1e-6]
        if not len(at):
            continue
        flat = np.concatenate([held[y] for y in at])
        found = held[x][np.minimum(np.searchsorted(held[x], flat), size[x] - 1)] == flat
        shared = np.add.reduceat(found.astype("i8"), np.cumsum(size[at]) - size[at])
        for y in at[shared >= similarity * (size[at] + size[x] - shared)]:
            links.append((int(node[x]), int(node[y])))
            comp[comp == comp[y]] = comp[x]
    return links


def rest_links(led: DataFrame, held: DataFrame, labels: DataFrame, similarity: float) -> DataFrame | None:
    """Links between components among the members of each bucket other than its leader; None if no bucket has several components.

    led: node, size and key of these members. held: shingle_sets. labels: components of the links to leaders.
    """
    rest = led.join(labels, "node", "left").select("node", "key", "size", F.coalesce("label", "node").alias("comp"))
    several = mixed_buckets(rest)
    whole, blocks = several.agg(F.sum("total"), F.max("blocks")).first()
    if not whole:
        return None
    found = compared(rest.join(several.where(F.col("blocks") <= SPREAD), "key"), held, whole, similarity)
    if blocks <= SPREAD:
        return found
    # Members of the largest buckets meet by rare shingles instead.
    wide = rest.join(several.where(F.col("blocks") > SPREAD).select("key"), "key", "left_semi").select("node", "size", "comp").distinct()
    wide = checkpointed(rare_prefixes(wide, held, similarity))
    several = mixed_buckets(wide)
    sets = held.select("node", "held")
    return found.unionByName(compared(wide.join(several, "key"), sets, several.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0], similarity))


def mixed_buckets(rest: DataFrame) -> DataFrame:
    """key, total (shingles) and blocks of the buckets whose members belong to several components."""
    several = rest.groupBy("key").agg(F.sum("size").alias("total"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    return checkpointed(several.select("key", "total", F.ceil(F.col("total") / BLOCK).alias("blocks")))


def rare_prefixes(nodes: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """node, size, comp and key: each node under the rarest of its shingles, so many of them that two sets of this similarity share one.

    Sets of similarity s share all but a (1 - s)-th of the larger one, so the first n - ceil(s n) + 1 shingles of both, in one order of all shingles, meet. Any order will do: it is
    by counts in `SLOTS` slots, which says little of rare shingles that share a slot with a common one but needs no more room for more of them.
    """
    sets = nodes.join(held.select("node", "held"), "node")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, "i8")
        for batch in batches:
            for one in batch.column(0).to_pylist():
                np.add.at(n, np.array(one, "i8") & (SLOTS - 1), 1)
        slots = np.flatnonzero(n)
        yield pa.record_batch([pa.array(slots), pa.array(n[slots])], ["slot", "n"])

    table = np.zeros(SLOTS, "i8")
    counts = sets.select("held").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most SLOTS rows
    table[counts["slot"]] = counts["n"]
    sent = nodes.sparkSession.sparkContext.broadcast(table)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, keys = [np.empty(0, "i8")], [np.empty(0, "i8")]
            for i, one in enumerate(batch.column("held").to_pylist()):
                x = np.array(one, "i8")
                many = len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1
                keys.append(x[np.lexsort((x, sent.value[x & (SLOTS - 1)]))[:many]])
                row.append(np.full(len(keys[-1]), i))
            at = pa.array(np.concatenate(row))
            yield pa.record_batch([batch.column(c).take(at) for c in ("node", "size", "comp")] + [pa.array(np.concatenate(keys))], ["node", "size", "comp", "key"])

    return sets.mapInArrow(rarest, "node long, size long, comp long, key long")


def compared(members: DataFrame, held: DataFrame, whole: int, similarity: float) -> DataFrame:
    """Links between the members (node, key, comp, blocks) of each bucket. Members of a bucket are dealt to its blocks, and each pair of blocks is a group.

    held: shingle_sets; without the bands' keys, a pair is compared in each bucket that both share.
    """
    members = members.withColumn("block", F.pmod(F.xxhash64("node", "key"), "blocks"))
    small = F.pmod(F.xxhash64("key"), F.lit(whole // BLOCK + 1))
    members = members.select("node", "key", "comp", "blocks", "block", F.when(F.col("blocks") == 1, small).otherwise(F.col("key")).alias("unit"))
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j"))))
    dealt = members.withColumn("pair", pair).select("node", "key", "comp", "block", "unit", "pair.i", "pair.j").join(held, "node")
    if "keys" not in held.columns:
        dealt = dealt.withColumn("keys", F.array("key"))

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        links = []
        for (key, i, j), bucket in rows.groupby(["key", "i", "j"]):
            links += bucket_links(bucket, key, i != j, similarity)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("unit", "i", "j").applyInPandas(within, "a long, b long")


def similar_labels(docs: DataFrame, nodes: DataFrame, similarity: float, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """node and label of the components of all nodes that share a key and whose sets of shingles have at least this Jaccard similarity.

    nodes: node, keys, size, doc_id and text_key of one of its texts. Members of a bucket are first compared with its leader, and
    then, where they still belong to several components, with each other. Nothing but these rows moves before candidates are known.
    """
    keyed = nodes.where("size > 0").select("node", "size", F.explode("keys").alias("key"))
    # Counts and leaders are checkpointed, so that Spark can split the joins with them where a band is hot.
    counts = checkpointed(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = checkpointed(keyed.join(counts, "key"))
    weighed = shared.join(shared.groupBy("node").agg(F.sum("n").alias("weight")), "node")
    leaders = weighed.groupBy("key").agg(F.max(F.struct("weight", "node", "size")).alias("leader"))
    leaders = checkpointed(leaders.select("key", F.col("leader.node").alias("leader"), F.col("leader.size").alias("leader_size")))
    led = checkpointed(shared.join(leaders, "key").where("node <> leader"))
    asked = nodes.join(led.select("node").union(led.select("leader")).distinct(), "node")
    held = checkpointed(shingle_sets(docs, asked, id_col, text_col, shingle))
    near = (F.col("size") >= similarity * F.col("leader_size")) & (F.col("leader_size") >= similarity * F.col("size"))
    pairs = led.where(near).select("node", "leader").distinct()
    both = pairs.join(held.select("node", "held"), "node").join(held.select(F.col("node").alias("leader"), F.col("held").alias("other")), "leader")
    same = F.size(F.array_intersect("held", "other"))
    links = both.where(same >= similarity * (F.size("held") + F.size("other") - same)).select(F.col("node").alias("a"), F.col("leader").alias("b"))
    labels = min_labels(links)
    rest = rest_links(led.where("n > 2").select("node", "size", "key"), held, labels, similarity)
    return labels if rest is None else min_labels(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(rest))


def keep_one(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """One row of each group of near copies, with all its columns: that with the smallest id (null last), and
    among rows that repeat this id the one with the smallest hashes of its text and its row.

    Whole texts are shuffled twice: to fetch the sets of candidates, and to take the rows that stay.
    """
    marked = checkpointed(signatures(docs, id_col, text_col, shingle))
    place = ("doc_id", "text_key", "row_key")
    each = marked.groupBy("node", "size", "keys", *place).agg(F.min("fp").alias("fp"), F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *place, "copies")).alias("first")
    nodes = each.groupBy("node", "size", "keys").agg(first, F.min("fp").alias("fp"))
    label = F.xxhash64(F.lit("fingerprints"), "label")
    nodes = nodes.join(labelled(marked), "fp").select("node", "first.doc_id", "first.text_key", "first", "size", F.array_append("keys", label).alias("keys"))
    nodes = checkpointed(nodes)
    labels = similar_labels(docs, nodes, similarity, id_col, text_col, shingle)
    group = nodes.select("node", "first").join(labels, "node", "left").select(F.coalesce("label", "node").alias("group"), "first")
    kept = checkpointed(group.groupBy("group").agg(F.min("first").alias("first")).select(*[F.col(f"first.{c}").alias(f"_{c}") for c in (*place, "copies")]))
    rows = docs.select(sealed(docs), col(id_col).alias("doc_id"), F.xxhash64(col(text_col)).alias("text_key"), row_key(docs).alias("row_key"))
    here = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key")) & (F.col("row_key") == F.col("_row_key"))
    once = rows.join(kept.where("_copies = 1"), here).select("row.*")
    if not kept.where("_copies > 1").head(1):
        return once
    # Equal rows: combined before the shuffle, so that many copies of one row do not meet.
    again = rows.join(kept.where("_copies > 1"), here).groupBy(*place).agg(F.first("row").alias("row"))
    return once.unionByName(again.select("row.*"))
