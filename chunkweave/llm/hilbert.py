"""Sharding along a Hilbert curve, with DataFrame functions alone.

Several metadata columns are quantised to `BITS` bits each, the cell's index on the Hilbert curve is computed
with bit operations, and the rows in curve order are cut into shards, so that each shard covers a compact
part of the space of all these columns and a reader can skip files by `shard_ranges`. Every quantisation keeps the order of
its column: names fall into ranges of neighbours that hold about equal shares of the rows. The first name has one
bit more, as in a compact Hilbert index of unequal sides: the curve halves its range before all others.

The global order needs no task that sees all rows: rows fall into buckets by curve index and the first
bits of a hash of the row (more bits for more rows, so that a cell with a third of all rows is many buckets), counts and sizes of buckets are
summed in two levels, and rows are numbered within their bucket. Copies of one id and text, which no hash can part, are dealt to parts of their bucket where they are many.

Laws: `bytes` cuts at equal shares of the summed size (each cut within half a row of its share); `rows` makes counts
at most one apart.

Defined results: null values of a dimension form the lowest cell; null texts have size 1 and the checksum of no bytes;
repeated rows are placed each on its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.llm.common import checkpointed, col

BITS = 4
#: Rows of one cell in a bucket, about, and the least number of bits of the hash that name a bucket.
BUCKET, HASH_BITS = 1 << 20, 8


def by_magnitude(number: Column) -> Column:
    """Quantise a count by its power of two; 0 for null and up to 1."""
    power = F.floor(F.log2(F.greatest(number, F.lit(1)))).cast("int")
    return F.coalesce(F.least(power, F.lit((1 << BITS) - 1)), F.lit(0))


def cuts_of(docs: DataFrame, name: Column, cells: int) -> list[tuple[object, int]]:
    """The least names of ranges that hold about equal shares of the rows, in order, with the number (1 to cells) of each range.

    Names are counted and sorted in Spark and summed in two levels; one row for each partition and range reaches the driver.
    """
    counts = docs.select(name.alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("n"))
    counts = checkpointed(counts.orderBy("name")).withColumn("part", F.spark_partition_id())
    total = 0
    starts: list = []
    for r in sorted(counts.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        starts += [F.lit(r.part), F.lit(total)]
        total += r.n
    if not starts:
        return []
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cell = F.floor((F.create_map(*starts)[F.col("part")] + ahead) * cells / F.lit(total)).cast("int") + 1
    return [(r.least, r.cell) for r in counts.withColumn("cell", cell).groupBy("cell").agg(F.min("name").alias("least")).orderBy("cell").collect()]


def by_cuts(value: Column, cuts: list[tuple[object, int]]) -> Column:
    """The number of the value's range; 0 for null and names under all ranges."""
    steps = [F.when(value >= F.lit(least), cell - before).otherwise(0) for (least, cell), (_, before) in zip(cuts, [(None, 0), *cuts], strict=False)]
    return reduce(lambda a, b: a + b, steps, F.lit(0))


def by_range(number: Column, least: int | None, most: int | None) -> Column:
    """Quantise a number by its place between two bounds; 0 for null."""
    if least is None or most is None:
        return F.lit(0)
    step = (number.cast("decimal(38,0)") - F.lit(least)) * F.lit(1 << BITS) / F.lit(most - least + 1).cast("decimal(20,0)")
    return F.coalesce(F.greatest(F.lit(0), F.least(F.floor(step).cast("int"), F.lit((1 << BITS) - 1))), F.lit(0))


def with_curve(df: DataFrame, dims: list[str], name: str = "curve") -> DataFrame:
    """Add the Hilbert index of the cell named by integer columns `dims`, each of BITS bits.

    The cell's coordinates are turned, level by level from the highest bit, into the transposed index, whose bits
    are then interleaved. Every step is a projection of its own, so expressions do not grow.
    """
    axes = [f"_axis{i}" for i in range(len(dims))]
    keep = df.columns
    df = df.select(*[col(c) for c in keep], *[col(d).alias(a) for d, a in zip(dims, axes, strict=True)])
    for bit in reversed(range(1, BITS)):
        low = (1 << bit) - 1
        for a in axes:
            on = F.col(a).bitwiseAND(1 << bit) != 0
            if a == axes[0]:
                df = df.withColumn(a, F.when(on, F.col(a).bitwiseXOR(F.lit(low))).otherwise(F.col(a)))
                continue
            swap = F.when(on, F.lit(0)).otherwise(F.col(axes[0]).bitwiseXOR(F.col(a)).bitwiseAND(F.lit(low)))
            first = F.when(on, F.col(axes[0]).bitwiseXOR(F.lit(low))).otherwise(F.col(axes[0]).bitwiseXOR(swap))
            df = df.withColumns({axes[0]: first, a: F.col(a).bitwiseXOR(swap)})
    for before, a in zip(axes, axes[1:], strict=False):
        df = df.withColumn(a, F.col(a).bitwiseXOR(F.col(before)))
    last = F.col(axes[-1])
    flip = reduce(Column.bitwiseXOR, [F.when(last.bitwiseAND(1 << bit) != 0, F.lit((1 << bit) - 1)).otherwise(F.lit(0)) for bit in range(1, BITS)])
    df = df.withColumn("_flip", flip)
    digits = [F.shiftleft(F.shiftright(F.col(a).bitwiseXOR(F.col("_flip")), bit).bitwiseAND(1), bit * len(axes) + len(axes) - 1 - i) for bit in range(BITS) for i, a in enumerate(axes)]
    return df.withColumn(name, reduce(Column.bitwiseOR, digits).cast("long")).drop("_flip", *axes)


def with_parts(rows: DataFrame, sums: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows whose bucket's rows of one tie, if more than BUCKET, are dealt to parts; and the columns that name a bucket or part, in order.

    The hash spreads unlike rows, so only rows of one id and text can make a bucket that large: without any, rows stay as they are.
    """
    large = sums.where(F.col("n") > 2 * BUCKET).select("bucket")  # one in 2 * BUCKET rows at most
    if not large.head(1):
        return rows, ["bucket"]
    hot = rows.join(F.broadcast(large), "bucket").groupBy("bucket", "tie").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET)
    hot = hot.groupBy("bucket").agg(F.collect_list(F.struct("tie", F.ceil(F.col("n") / BUCKET).alias("parts"))).alias("hot"))
    rows = rows.withColumn("number", F.monotonically_increasing_id()).join(F.broadcast(hot), "bucket", "left")
    below = F.coalesce(F.size(F.filter("hot", lambda h: h["tie"] < F.col("tie"))), F.lit(0))
    parts = F.filter("hot", lambda h: h["tie"] == F.col("tie"))[0]["parts"]
    # Ties below the first hot one, the hot one, those up to the next, and so on; parts within the hot ones.
    rows = rows.withColumns({"turn": 2 * F.when(F.col("hot").isNull(), 0).otherwise(below) + parts.isNotNull().cast("int"), "part": F.coalesce(F.pmod("number", parts), F.lit(0))})
    return checkpointed(rows.drop("number", "hot")), ["bucket", "turn", "part"]


def placed(rows: DataFrame, shards: int, law: str) -> DataFrame:
    """Add shard and slot to rows with size, curve and tie (a long); equal rows may trade places."""
    bits = max(HASH_BITS, math.ceil(math.log2(max(1, rows.count()) / BUCKET)))
    rows = rows.withColumn("bucket", F.shiftleft("curve", bits) + F.shiftrightunsigned("tie", 64 - bits))
    counts = (F.count("*").alias("n"), F.sum("size").alias("b"))
    sums = checkpointed(rows.groupBy("bucket").agg(*counts))
    rows, names = with_parts(rows, sums)
    if len(names) > 1:
        sums = checkpointed(rows.groupBy(*names).agg(*counts))
    sums = sums.withColumn("block", F.shiftright("bucket", bits + BITS))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.groupBy("block").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_block") for c in "nb"])
    within = Window.partitionBy("block").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.join(F.broadcast(blocks), "block")  # blocks: at most 2^(3 BITS + 1) rows for four dimensions
    starts = starts.select(*names, *[(F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"{c}_block")).alias(f"{c}_before") for c in "nb"])
    n, total = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    order = Window.partitionBy(*names).orderBy("curve", "tie", "size", "doc_id")
    earlier = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(starts, names).withColumns({"rank": F.row_number().over(order) - 1 + F.col("n_before"), "held": earlier + F.col("b_before")})
    if law == "bytes":
        cut = F.floor((F.col("held") * 2 + F.col("size")) / F.lit(2 * max(1, total)) * shards)
    elif law == "rows":
        cut = F.floor(F.col("rank") * shards / F.lit(max(1, n)))
    else:
        raise ValueError(f"no such law: {law}")
    rows = rows.withColumn("shard", F.least(cut.cast("int"), F.lit(shards - 1)))
    first = rows.groupBy("shard").agg(F.min("rank").alias("first"))
    return rows.join(F.broadcast(first), "shard").withColumn("slot", F.col("rank") - F.col("first")).drop(*names, "n_before", "b_before", "rank", "held", "first")


def hilbert_shards(docs: DataFrame, shards: int = 8, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text", names: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id, size, text_crc32, curve, the cell's dimensions (dim0, ...), shard and slot for each row.

    Dimensions: the names by ranges, the size by magnitude and the id by range. size: UTF-8 bytes of the text plus 1.
    The names themselves are kept as name0, ...
    """
    text = F.coalesce(col(text_col), F.lit(""))
    least, most = docs.agg(F.min(col(id_col)), F.max(col(id_col))).first()
    size = (F.octet_length(text) + 1).cast("long")
    # Null is the lowest range. The first name has one bit more.
    first, *others = [by_cuts(col(c), cuts_of(docs, col(c), (1 << BITS + (i == 0)) - 1)) for i, c in enumerate(names)]
    dims = [first.bitwiseAND((1 << BITS) - 1), *others, by_magnitude(size), by_range(col(id_col), least, most)]
    known = [f"dim{i}" for i in range(len(dims))]
    kept = [col(c).alias(f"name{i}") for i, c in enumerate(names)]
    rows = docs.select(col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *kept, *[d.alias(k) for d, k in zip(dims, known, strict=True)], F.shiftright(first, BITS).alias("half"))
    rows = with_curve(rows, known).withColumn("tie", F.xxhash64("doc_id", "text_crc32"))
    rows = rows.withColumn("curve", F.col("curve") + F.shiftleft(F.col("half").cast("long"), BITS * len(dims))).withColumn("dim0", F.col("dim0") + F.shiftleft("half", BITS)).drop("half")
    return placed(checkpointed(rows), shards, law).drop("tie")


def shard_ranges(sharded: DataFrame) -> DataFrame:
    """For each shard its rows, its size, and of each name and dimension the range, by which readers skip it, and the nulls among names."""
    ranged = [c for c in sharded.columns if c.startswith(("dim", "name"))]
    nulls = [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in ranged if c.startswith("name")]
    return sharded.groupBy("shard").agg(
        F.count("*").alias("rows"), F.sum("size").alias("bytes"), *[f(c).alias(f"{c}_{f.__name__}") for c in ranged for f in (F.min, F.max)], *nulls
    )
