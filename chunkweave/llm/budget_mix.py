"""Mixing sources to target weights by fitting subset sums.

1. Every document has a size and a seeded hash of its whole row; documents are counted by source, exact size and hash bucket.
2. Targets: sources share the total by weight, but none gets more than `repeats` times its size; the excess goes to
   the others by weight until none is above. That is min(repeats * size, level * weight) for one level.
3. Whole passes over a source come first. For the rest each size gets its proportional number of documents, rounded
   down, and bounded-knapsack dynamic programming over the sizes spends what is left.
4. Documents of one size are taken in order of their hash, so reruns agree, whatever their ids. Documents count by bucket, so a size
   that holds a third of all rows is spread over many tasks; the number of buckets grows with the rows. Only counts of hashes are
   ranked, so that any number of equal rows is one row there.

Per source a task sees its size counts, which are at most as many as its different sizes, never documents.

Defined results: null and empty texts have size 0 and are never taken; the null source is one source, last in order;
repeated rows are documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.llm.common import BLANKS, checkpointed, col, sealed
from chunkweave.llm.simhash import row_key

#: At least so many buckets, and more for more rows than so many in each.
BUCKETS, PER_BUCKET = 256, 1 << 20
#: Words that dynamic programming may have to spend; before it, sizes get one more document each.
SPEND = 1 << 15


def n_words(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; 0 for null. One split; blanks at the ends give empty parts."""
    parts = F.split(F.coalesce(text, F.lit("")), BLANKS)
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """source, source_size, target from one row a source. Weights repeat along the sources by code point, null last."""
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(ranked) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    rows = checkpointed(sizes.select("source", "source_size", weight.alias("weight")))
    most = F.col("source_size") * repeats
    level, total = 0.0, float(rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    while total:
        full = most <= F.col("weight") * level
        held, open_weight = rows.agg(F.coalesce(F.sum(F.when(full, most)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if not open_weight or (raised := (total - held) / open_weight) <= level:
            break
        level = raised
    return rows.select("source", "source_size", F.least(most.cast("double"), F.col("weight") * level).alias("target"))


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take, at most counts, so that the sum comes as near to budget as it can."""
    take = np.zeros(len(sizes), "i8")
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.astype("i8")
    take += [int(c) * budget // total for c in counts]
    left = budget - int((sizes * take).sum())
    order = np.argsort(-sizes, kind="stable")
    while left > SPEND:
        for i in order.tolist():
            if take[i] < counts[i] and sizes[i] <= left - SPEND // 2:
                take[i] += 1
                left -= int(sizes[i])
        if not ((take < counts) & (sizes <= left - SPEND // 2)).any():
            break
    # Sums that the remaining documents reach, as a bit set, one step for each size and power of two.
    over = min(int(sizes.max()), left)  # going over by more than what is left is worse than taking nothing
    mask = (1 << (left + over + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    reached = 1
    for i in order[::-1].tolist():
        spare, power = min(int(counts[i] - take[i]), (left + over) // int(sizes[i])), 1
        while spare and not reached >> left & 1:
            many = min(power, spare)
            steps.append((i, many, reached))
            reached |= (reached << many * int(sizes[i])) & mask
            spare, power = spare - many, 2 * power
    below = (reached & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reached >> left
    sum_ = below if not above or left - below <= (above & -above).bit_length() - 1 else left + (above & -above).bit_length() - 1
    for i, many, before in reversed(steps):
        if not before >> sum_ & 1:
            take[i] += many
            sum_ -= many * int(sizes[i])
    return take


def mixed(docs: DataFrame, size: Column, weights: tuple[float, ...] = (1, 2, 3), repeats: int = 3, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", with_rows: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, times (how often the mix takes the row) and taken (times * size).

    with_rows: instead all columns of docs in a struct `row`, and times.
    """
    rows = docs.select(*([sealed(docs)] if with_rows else []), col(id_col).alias("doc_id"), col(source_col).alias("source"), size.cast("long").alias("size"), F.xxhash64(row_key(docs), F.lit(seed)).alias("hash"))
    # Null sources get a key of their own, so that joins need no null-safe comparison.
    rows = rows.withColumns({"key": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")), "bucket": F.pmod("hash", F.lit(max(BUCKETS, docs.count() // PER_BUCKET))).cast("int")})
    if not with_rows:
        rows = checkpointed(rows)
    place = ["key", "size", "bucket", "hash"]
    equal = checkpointed(rows.groupBy("source", *place).agg(F.count("*").alias("n")))
    hist = checkpointed(equal.groupBy("source", "key", "size", "bucket").agg(F.sum("n").alias("n")))
    by_size = hist.groupBy("source", "key", "size").agg(F.sum("n").alias("n"))
    wanted = checkpointed(targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, repeats))
    wanted = wanted.withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        sizes, counts = group["size"].to_numpy("i8"), group["n"].to_numpy("i8")
        total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        passes = min(repeats, int(target // total))
        budget = 0 if passes == repeats else round(target - passes * total)
        return group[["key", "size"]].assign(passes=passes, more=fit(sizes, counts, budget))

    chosen = by_size.where("size > 0").join(wanted, "key").select("key", "size", "n", "source_size", "target")
    chosen = chosen.groupBy("key").applyInPandas(choose, "key string, size long, passes int, more long")
    # Buckets of one size are taken one after another, and in each the hashes; all rows of a hash are taken alike, but for those of the last one.
    before = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = hist.join(chosen, ["key", "size"]).withColumn("quota", F.col("more") - F.coalesce(F.sum("n").over(before), F.lit(0)))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("key", "size", "bucket").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = equal.drop("source").withColumn("earlier", earlier).join(quota.select("key", "size", "bucket", "passes", "quota"), ["key", "size", "bucket"])
    taken = left.select(*place, "n", "passes", F.least("n", F.greatest(F.lit(0), F.col("quota") - F.col("earlier"))).alias("more"))
    taken = checkpointed(taken.where("passes > 0 or more > 0"))
    out = rows.join(taken.where("more = 0 or more = n").select(*place, (F.col("passes") + (F.col("more") > 0).cast("int")).alias("times")), place, "inner" if with_rows else "left")
    some = taken.where("more > 0 and more < n")
    if some.head(1):
        # Equal rows of which some are taken once more: combined before the shuffle, for any of them will do.
        kept = rows.columns
        one = rows.join(some, place).groupBy(*place).agg(*[F.first(c).alias(c) for c in [*(c for c in kept if c not in place), "n", "passes", "more"]])
        again = one.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
        again = again.select(*kept, (F.col("passes") + (F.col("i") <= F.col("more")).cast("int")).alias("times"))
        out = (out if with_rows else out.join(some.select(*place), place, "left_anti").select(*kept, "times")).unionByName(again.select(*kept, "times"))
    if with_rows:
        return out.select("row", "times")
    out = out.withColumn("times", F.coalesce("times", F.lit(0)))
    return out.join(wanted, "key").select("doc_id", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, text_col: str = "text", **options: object) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mix takes it, with all its columns."""
    rows = mixed(docs, n_words(col(text_col)), with_rows=True, **options)
    return rows.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).select("row.*")
