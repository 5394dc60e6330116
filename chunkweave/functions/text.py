"""Text expressions. Everything here is a built-in column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip() and str.split() see it: 29 code points.
PY_WS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
WS_CLASS = f"[{PY_WS}]+"
#: Namespace of point ids: a fixed value.
NAMESPACE = "6f9619ff8b86d011b42d00c04fc964ff"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(PY_WS))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def words(text: Column) -> Column:
    return F.filter(F.split(text, WS_CLASS), lambda w: w != "")


def collapse(text: Column) -> Column:
    """Each run of white space becomes one space; none at the ends."""
    return strip(F.regexp_replace(text, WS_CLASS, " "))


def excerpt(text: Column, length: int = 200) -> Column:
    return F.substring(F.array_join(words(text), " "), 1, length)


def newlines(text: Column) -> Column:
    """`\\r\\n` and `\\r` become `\\n`; nothing else changes, so line numbers hold."""
    return F.regexp_replace(text, "\r\n?", "\n")


def n_lines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def has_suffix(name: Column, suffix: str = ".txt") -> Column:
    return F.lower(name).endswith(suffix)


def document_id(source: Column) -> Column:
    """The part of a file name before its first `__`."""
    return F.substring_index(source, "__", 1)


def reference(source: Column, line_start: Column, line_end: Column) -> Column:
    """How an answer cites a chunk: `source (l. a-b)`, `source (l. a)`, or the source if its lines are unknown."""
    span = F.concat(source, F.lit(" (l. "), line_start.cast("string"))
    many = (line_end != 0) & (line_end != line_start)
    return F.when(line_start == 0, source).when(many, F.concat(span, F.lit("-"), line_end.cast("string"), F.lit(")"))).otherwise(F.concat(span, F.lit(")")))


def point_id(source: Column, index: Column) -> Column:
    """UUID version 5 of `source:index`, as a string."""
    key = F.encode(F.concat_ws(":", source, index.cast("string")), "UTF-8")
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), key))
    part = lambda at, n: F.substring(h, at, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))
