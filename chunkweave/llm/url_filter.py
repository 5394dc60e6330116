"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join.

What is listed is learnt. Labelled documents say which words mark bad texts: those that many bad documents hold and hardly a good one, by exact counts
over all labelled ones. A page that holds such a word lists its canonical URL, and so all crawls of that page are judged by it. Pages are read once, for
small rows of addresses.

The filter has blocks of eight 32-bit words; a URL sets one bit in each word of one block, so one lookup of one
small row answers. Its bits grow with the list (about 16 for each URL). While it takes less than
`broadcast_bytes` it is sent to every task; beyond that the lookup is a join on the block number. URLs that have no canonical form
are looked up nowhere. Only possible hits go on to the exact join with the listed URLs, which removes false positives.

Defined results: a null URL, or one without `://`, has empty host and path, is never listed and fits no rule;
repeated rows and repeated listed URLs are harmless; an empty list blocks nothing; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkweave.llm.common import checkpointed, col

LANES = 8
#: Bytes of a block's row in a broadcast join.
ROW_BYTES = 256
KEYS_PER_BLOCK = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that name no other content: fixed values.
TRACKING = ("utm_[a-z]+", "ref", "fbclid", "gclid")
#: Verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

URL = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def canonical(url: Column) -> Column:
    """One form for the ways to write an address: no scheme, `www.` or `m.`, fragment, tracking parameters, final `/` or `.html`.

    Null if the URL has no `://`.
    """
    query = F.regexp_extract(F.regexp_replace(url, "(?s)#.*$", ""), "(?s)^[^?]*\\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.rlike(f"^({'|'.join(TRACKING)})(=|$)"))
    host = F.regexp_replace(host_of(url), "^(www|m)\\.", "")
    path = F.regexp_replace(path_of(url), "(\\.html|/)$", "")
    whole = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(""))
    return F.when(F.instr(url, "://") > 0, whole)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest rule (verdict, host, path) that fits, as a struct of rule and verdict, or null. For some hundred rules."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, under in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(under)
        out = F.when(fits, F.struct(F.lit(at + under).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def bits_of(key: Column) -> list[Column]:
    """The bit that a key sets in each of the words of its block."""
    spread = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(spread, 5 * i).bitwiseAND(31).cast("int")) for i in range(LANES)]


def bloom_filter(keys: DataFrame, n_keys: int, key_col: str = "key") -> tuple[DataFrame, int]:
    """The filter (block and the words w0, w1, ...; only blocks with a key) and its number of blocks."""
    blocks = max(1, math.ceil(n_keys / KEYS_PER_BLOCK))
    key = F.col(key_col)
    marked = keys.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits_of(key))])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(LANES)]), blocks


def possible(rows: DataFrame, bloom: DataFrame, blocks: int, key_col: str = "key", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Add bloom_hit: false only if the key is surely not in the filter."""
    small = blocks * ROW_BYTES <= broadcast_bytes
    rows = rows.withColumn("block", F.pmod(F.xxhash64(key_col), F.lit(blocks)))
    words = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(b) != 0 for i, b in enumerate(bits_of(F.col(key_col)))])
    joined = rows.join(F.broadcast(bloom) if small else bloom, "block", "left")
    return joined.withColumn("bloom_hit", F.coalesce(words & F.col(key_col).isNotNull(), F.lit(False))).drop("block", *[f"w{i}" for i in range(LANES)])


def plain_words(text: Column) -> Column:
    """Runs of the letters a to z, A-Z lower-cased. The ends of the array may be empty."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[^a-z]+")


def learned_marks(docs: DataFrame, labels: DataFrame, share: int = 8, odds: int = 19, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[str]:
    """Words in at least one of `share` bad documents (label 1), and in at least `odds` times as many bad ones as good ones (label 0), in order.

    At most `share` times the mean number of different words of a bad document can be in so many of them, so few words come to the driver. Documents of one id share
    its label, the larger of several; null ids and labels teach nothing.
    """
    known = labels.select(col(id_col).alias("id"), col(label_col).alias("bad")).where("id is not null and bad is not null")
    known = checkpointed(known.groupBy("id").agg(F.max("bad").alias("bad")))
    rows = docs.select(col(id_col).alias("id"), plain_words(col(text_col)).alias("words"))
    ids = known.where("bad = 1").select("id")
    ids = F.broadcast(ids) if ids.count() * ROW_BYTES <= 64 << 20 else ids
    total = rows.select("id").join(ids, "id").count()
    bad = rows.join(ids, "id").select(F.explode(F.array_distinct("words")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("bad"))
    counts = {r.word: r.bad for r in bad.where(F.col("bad") * share >= total).collect()}
    if not counts:
        return []
    some = rows.select("id", F.array_intersect("words", F.array(*map(F.lit, counts))).alias("found")).where("size(found) > 0")
    good = some.join(known.where("bad = 0"), "id").select(F.explode("found").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    held = {r.word: r.n for r in good.collect()}
    return sorted(w for w, n in counts.items() if n >= odds * held.get(w, 0))


def addresses(pages: DataFrame, marks: list[str], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, key (the canonical URL) and marked (whether the page holds one of the marks as a word), from one scan of pages."""
    url, text = col(url_col), F.translate(col(html_col), UPPER, LOWER)
    marked = F.coalesce(text.rlike(f"(^|[^a-z])({'|'.join(marks)})([^a-z]|$)"), F.lit(False)) if marks else F.lit(False)
    return checkpointed(pages.select(col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("key"), marked.alias("marked")))


def listed_urls(rows: DataFrame) -> DataFrame:
    """Canonical URLs (column key, each once) of marked addresses: a list learnt from any crawl of a page."""
    return rows.where("marked and key is not null").select("key").distinct()


def judged(rows: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict, bloom_hit and listed for each of the addresses. listed: column key, each URL once.

    The verdict is the longest fitting rule's; without one, block for listed URLs and allow for others.
    """
    listed = checkpointed(listed)
    bloom, blocks = bloom_filter(listed, listed.count())
    rows = rows.select("page_id", "host", "path", "key")
    none = rows.where("key is null").withColumn("bloom_hit", F.lit(False))
    rows = possible(rows.where("key is not null"), bloom, blocks, broadcast_bytes=broadcast_bytes)
    hits = rows.where("bloom_hit").join(listed.withColumn("listed", F.lit(True)), "key", "left")
    rest = rows.where("not bloom_hit").unionByName(none).withColumn("listed", F.lit(False)).select(*hits.columns)
    out = hits.unionByName(rest).withColumn("listed", F.coalesce("listed", F.lit(False)))
    out = out.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("fit.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "bloom_hit", "listed")
