"""Quality rules: fixed base checks, then a decision list learnt from labelled documents. DataFrame functions alone.

Sequential covering: labelled documents are binned by thresholds with the most gain of information, chosen on the exact counts of
every value of a feature, and counted by bins, label and fold (grow or prune), which leaves a table whose size depends on the number of features and
bins but not on that of documents. On it rules grow one condition at a time by the gain of information,
are pruned on the other fold, and take the documents that they cover out of the table, until the best rule is no longer
precise enough. The list becomes one ordered conditional expression.

Defined results: a null text has no words and fails the base checks; repeated rows are judged alike; without labels
(or with labels of one kind) the list is empty and the base checks decide alone; an empty table gives an empty
result; labels of ids that do not occur are ignored; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkweave.llm.common import checkpointed, col, sealed, words

#: Characters that count as symbols: fixed values.
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
FEATURES = ("symbol_share", "upper_share", "mark_share", "repeat_share", "line_share", "mean_length")
BINS = 6
#: Bits of a window's place in its document.
PLACE = 24
#: Values are rounded to this many steps of one, so that exact counts need a bounded number of counters.
STEPS = 1000

Rule = list[tuple[str, str, float]]


def text_stats(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds the STATS; rows has column `text`.

    Windows of three words become longs of a hash and their place, sorted within their document. Neighbours with equal
    hashes are compared word by word; should unequal words ever share a hash in a document, or places not fit in the
    long, its windows are compared as strings instead. The places of repeats, sorted, cover min(3, gap to the next) words each.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = rows.withColumns({"_w": words(F.col(text)), "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))})
    n = F.size("_w")
    only = lambda c, kind: F.length(F.regexp_replace(c, f"[^{kind}]+", "")).cast("long")
    joined = F.array_join("_w", "")
    keys = F.transform(F.slice("_w", 1, n - 2), lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)).bitwiseAND(F.lit(-1 << PLACE)).bitwiseOR(i.cast("long")))
    out = out.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(joined).cast("long"),
            "n_symbols": only(t, SYMBOLS),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_upper": only(joined, "A-Z"),
            "n_marks": only(joined, "!?|"),
            "_keys": F.when(n.between(4, 1 << PLACE), F.sort_array(keys)),
        }
    )
    near = lambda a, b: F.shiftrightunsigned(a.bitwiseXOR(b), PLACE) == 0
    equal = F.zip_with("_keys", F.slice("_keys", 2, F.greatest(F.size("_keys"), F.lit(1))), lambda a, b: F.when(near(a, b), F.struct(a.alias("a"), b.alias("b"))))
    out = out.withColumn("_pairs", F.array_compact(equal)).drop("_keys", "_lines")
    at = lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1).cast("long")).cast("int")

    def clash(p: Column) -> Column:
        differ = [F.get("_w", at(p["a"]) + k) != F.get("_w", at(p["b"]) + k) for k in range(3)]
        return differ[0] | differ[1] | differ[2]

    spans = F.transform(F.slice("_w", 1, n - 2), lambda x, i: F.struct(F.concat_ws(" ", x, F.get("_w", i + 1), F.get("_w", i + 2)).alias("s"), i.alias("i")))
    out = out.withColumn("_spans", F.when(F.exists("_pairs", clash) | (n > 1 << PLACE), F.array_sort(spans)))
    same = lambda i, s: F.coalesce(F.get("_spans", i)["s"] == s, F.lit(False))
    slow = F.transform(F.filter("_spans", lambda x, i: same(i - 1, x["s"]) | same(i + 1, x["s"])), lambda x: x["i"])
    quick = F.array_distinct(F.concat(F.transform("_pairs", lambda p: at(p["a"])), F.transform("_pairs", lambda p: at(p["b"]))))
    out = out.withColumn("_starts", F.sort_array(F.when(F.col("_spans").isNull(), quick).otherwise(slow))).drop("_spans", "_pairs", "_w")
    gaps = F.zip_with("_starts", F.slice("_starts", 2, F.greatest(F.size("_starts"), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    covered = F.aggregate(gaps, F.lit(0), lambda total, x: total + x)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    # One row of an array: filters on the counts stay above it, else the optimizer would repeat all these steps in them.
    stats = F.inline(F.array(F.struct(*STATS)))
    return out.select(*[c for c in rows.columns], stats)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)) * STEPS) / STEPS
    return dict(
        zip(
            FEATURES,
            (share("n_symbols", "word_chars"), share("n_upper", "word_chars"), share("n_marks", "word_chars"), share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines"), F.least(share("word_chars", "n_words"), F.lit(50.0))),
            strict=True,
        )
    )


def best_cuts(values: np.ndarray, bad: np.ndarray, good: np.ndarray) -> list[float]:
    """Up to BINS - 1 thresholds midway between neighbours of the sorted values, taken one by one by the gain of information of either label's counts."""

    def spread(b: np.ndarray, g: np.ndarray) -> np.ndarray:
        n = b + g
        return -sum(c * np.log2(np.where(c > 0, c, 1) / np.where(c > 0, n, 1)) for c in (b, g))

    def split(low: int, high: int) -> tuple[float, int, int, int]:
        b, g = np.cumsum(bad[low:high]), np.cumsum(good[low:high])
        gain = spread(b[-1:], g[-1:]) - spread(b, g) - spread(b[-1] - b, g[-1] - g)
        best = int(np.argmax(gain[:-1])) if high - low > 1 else 0
        return (float(gain[best]) if high - low > 1 else 0.0), low + best + 1, low, high

    parts, cuts = [split(0, len(values))] if len(values) else [], []
    while len(cuts) < BINS - 1 and parts and (top := max(parts))[0] > 1e-9:
        _, at, low, high = top
        parts.remove(top)
        parts += [split(low, at), split(at, high)]
        cuts.append((float(values[at - 1]) + float(values[at])) / 2)
    return sorted(cuts)


def cut_points(labelled: DataFrame) -> dict[str, list[float]]:
    """Thresholds of each feature, from the exact counts of its values by label: at most 50 * STEPS rows reach the driver for one feature."""
    pairs = F.inline(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).cast("double").alias("value")) for i, f in enumerate(FEATURES)]))
    counts = labelled.select("good", pairs).groupBy("feature", "value").agg(F.count_if(F.col("good") == 0).alias("bad"), F.count_if(F.col("good") == 1).alias("good"))
    rows = np.array(sorted(map(tuple, counts.collect())), "f8").reshape(-1, 4)
    return {f: best_cuts(*rows[rows[:, 0] == i, 1:].T) for i, f in enumerate(FEATURES)}


def learn(labelled: DataFrame, precision: float = 0.9, coverage: float = 0.01, most_rules: int = 8, most_conditions: int = 3) -> list[Rule]:
    """Rules that find bad documents. labelled: FEATURES, good (0 or 1), fold (0 grow, 1 prune).

    Counts cover all labelled documents; at most BINS ** len(FEATURES) * 4 rows of counts reach the driver.
    """
    cuts = cut_points(labelled)
    bins = [reduce(lambda a, b: a + b, [(F.col(f) > c).cast("int") for c in cuts[f]], F.lit(0)).alias(f) for f in FEATURES]
    table = [tuple(r) for r in labelled.select(*bins, "good", "fold").groupBy(*FEATURES, "good", "fold").agg(F.count("*")).collect()]
    table.sort()
    place = {f: i for i, f in enumerate(FEATURES)}
    literals = [(f, op, k) for f in FEATURES for k in range(len(cuts[f])) for op in (">", "<=")]

    def holds(row: tuple, rule: list) -> bool:
        return all((row[place[f]] > k) == (op == ">") for f, op, k in rule)

    def counts(rows: list, rule: list) -> tuple[int, int]:
        bad = good = 0
        for row in rows:
            if holds(row, rule):
                bad, good = (bad, good + row[-1]) if row[-3] else (bad + row[-1], good)
        return bad, good

    rules: list[list] = []
    all_bad = sum(r[-1] for r in table if not r[-3])
    while len(rules) < most_rules:
        grow, prune = ([r for r in table if r[-2] == fold] for fold in (0, 1))
        rule: list = []
        bad, good = counts(grow, rule)
        covered = grow
        while bad and good and len(rule) < most_conditions:
            before = math.log2(bad / (bad + good))
            best = (0.0, None, 0, 0)
            for literal in literals:
                b, g = counts(covered, [literal])
                if b and (gain := b * (math.log2(b / (b + g)) - before)) > best[0] + 1e-9:
                    best = (gain, literal, b, g)
            if best[1] is None:
                break
            rule.append(best[1])
            covered, bad, good = [r for r in covered if holds(r, rule)], best[2], best[3]
        worth = lambda r: (lambda b, g: (b - g) / (b + g) if b + g else -1.0)(*counts(prune, r))
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        b, g = counts(prune, rule)
        both = counts(table, rule)
        if not rule or b < precision * (b + g) or both[0] < precision * sum(both) or both[0] < coverage * all_bad or not b:
            break
        rules.append(rule)
        table = [r for r in table if not holds(r, rule)]
    return [[(f, op, cuts[f][k]) for f, op, k in rule] for rule in rules]


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression over FEATURES: the number of the first rule that holds, else null."""
    value = features()
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        holds = reduce(lambda a, b: a & b, [value[f] > c if op == ">" else value[f] <= c for f, op, c in rule])
        out = F.when(holds, F.lit(i)).otherwise(out)
    return out


def learn_from(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", **options: float) -> list[Rule]:
    """Learn from all documents with a label. stats: id and STATS, so that no text is shuffled.

    An id with several labels counts once, as good if any label says so.
    """
    known = labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("good")).where("id is not null and good in (0, 1)")
    known = known.groupBy("id").agg(F.max("good").alias("good"))
    rows = stats.withColumnRenamed("doc_id", "id").where(~base_failed()).join(known, "id")
    fold = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3)).alias("fold")
    return learn(checkpointed(rows.select(*[c.alias(f) for f, c in features().items()], "good", (fold == 2).cast("int").alias("fold"))), **options)


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and STATS for each row: one pass over the texts, kept in a checkpoint of small rows."""
    return checkpointed(text_stats(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))).drop("text"))


def judged(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, rule (the rule that rejects, else null) and kept to document_stats."""
    rows = stats.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), verdict(rules)))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def kept_documents(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are kept, with all their columns."""
    rows = text_stats(docs.select(sealed(docs), col(text_col).alias("text"))).drop("text")
    return rows.where(~base_failed() & verdict(rules).isNull()).select("row.*")


def filtered(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """The rows that are kept by rules learnt from them, with all their columns.

    Texts are counted once: rules are learnt from the counts, and the rows that they reject leave by an anti join on the id and a hash of the text.
    """
    key = F.xxhash64(col(text_col)).alias("text_key")
    stats = checkpointed(text_stats(docs.select(col(id_col).alias("doc_id"), key, col(text_col).alias("text"))).drop("text"))
    found = judged(stats, learn_from(stats.drop("text_key"), labels, **options))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone"), F.col("text_key").alias("gone_key")).distinct()
    rows = docs.select(sealed(docs), col(id_col).alias("doc_id"), key)
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")) & (F.col("text_key") == F.col("gone_key")), "left_anti").select("row.*")
