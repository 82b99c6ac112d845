"""Text columns: tokens with byte offsets, line index, spans, escaping; all built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"\s+|\S+"


def tokens(text: Column) -> Column:
    """Alternating runs of whitespace and other characters."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_offsets(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, pos, token, start_byte, end_byte), one row for each token."""
    rows = df.select(*key, F.posexplode(tokens(F.col(text))).alias("pos", "token"))
    w = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.octet_length("token")).over(w)
    return rows.withColumn("end_byte", end).withColumn("start_byte", F.col("end_byte") - F.octet_length("token"))


def token_range_bytes(offsets: DataFrame, key: list[str], first: Column, last: Column) -> DataFrame:
    """The byte range of tokens first..last (last exclusive) of each key."""
    return offsets.filter((F.col("pos") >= first) & (F.col("pos") < last)).groupBy(*key).agg(F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"))


def line_index(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, line, line_start): byte offset of each line, from 0; lines end at \\n."""
    rows = df.select(*key, F.posexplode(F.split(text, "\n", -1)).alias("line", "s"))
    w = Window.partitionBy(*key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*key, F.col("line").cast("long").alias("line"), F.coalesce(F.sum(F.octet_length("s") + 1).over(w), F.lit(0)).cast("long").alias("line_start"))


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Values that prefix_sums adds up together: sums of whole stretches come first, so that a long array is not summed anew for each place.
STRETCH = 128


def prefix_sums(values: Column) -> Column:
    """For each place of an array of integers, the sum of the values before it."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))

    def within(v: Column, before: Column) -> Column:
        return F.transform(upto(F.size(v)), lambda i: F.get(before, F.floor(i / STRETCH).cast("int")) + total(F.slice(v, F.floor(i / STRETCH).cast("int") * STRETCH + 1, i % STRETCH)))

    def stretches(v: Column) -> Column:
        whole = F.transform(upto(F.ceil(F.size(v) / STRETCH).cast("int")), lambda j: total(F.slice(v, j * STRETCH + 1, F.lit(STRETCH))))
        return let(let(whole, lambda w: F.transform(w, lambda _, j: total(F.slice(w, F.lit(1), j)))), lambda before: within(v, before))

    return let(values, stretches)


def line_starts(text: Column) -> Column:
    """The same as one array in the row: byte offsets of the lines."""
    return prefix_sums(F.transform(F.split(text, "\n", -1), lambda s: F.octet_length(s) + 1))


def offset_to_point(points: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
    """(key, offset, row, col): the last line that starts at or before the offset. Lines and offsets are sorted together
    and the line carried forward, so no pair of offset and line is formed."""
    both = index.select(*key, F.col("line_start").alias("at"), F.lit(0).alias("is_point"), "line", "line_start").unionByName(
        points.select(*key, F.col("offset").alias("at"), F.lit(1).alias("is_point"), F.lit(None).cast("long").alias("line"), F.lit(None).cast("long").alias("line_start"))
    )
    w = Window.partitionBy(*key).orderBy("at", "is_point").rowsBetween(Window.unboundedPreceding, 0)
    out = both.select(*key, "at", "is_point", F.last("line", ignorenulls=True).over(w).alias("row"), F.last("line_start", ignorenulls=True).over(w).alias("start"))
    return out.filter("is_point = 1").select(*key, F.col("at").alias("offset"), "row", (F.col("at") - F.col("start")).alias("col"))


def affected_lines(ranges: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
    """(key, n_lines): distinct lines that byte ranges touch, the line of the end offset included. ranges: start, end."""
    points = ranges.select(*key, F.col("start").alias("offset")).union(ranges.select(*key, F.col("end").alias("offset"))).distinct()
    rows = offset_to_point(points, index, key).select(*key, "offset", "row")
    out = ranges.join(rows.select(*key, F.col("offset").alias("start"), F.col("row").alias("a")), [*key, "start"]).join(rows.select(*key, F.col("offset").alias("end"), F.col("row").alias("z")), [*key, "end"])
    return out.select(*key, F.explode(F.sequence("a", "z")).alias("line")).groupBy(*key).agg(F.countDistinct("line").alias("n_lines"))


def node_source(content: Column, start: Column, end: Column) -> Column:
    """Bytes start..end of a text as a string; an impossible range is empty."""
    raw = content.cast("binary")
    ok = (start >= 0) & (end >= start) & (end <= F.octet_length(content))
    return F.when(ok, F.make_valid_utf8(F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")).cast("string"))).otherwise("")


def span_start(text: Column) -> Column:
    return F.regexp_extract(text, r"\((\d+),\s*(\d+)\)", 1).try_cast("bigint")


def span_end(text: Column) -> Column:
    return F.regexp_extract(text, r"\((\d+),\s*(\d+)\)", 2).try_cast("bigint")


def span_distance(a: Column, b: Column) -> Column:
    """Sum of the distances of starts and ends; null without a span."""
    return F.abs(span_start(a) - span_start(b)) + F.abs(span_end(a) - span_end(b))


def sexp_escape(text: Column) -> Column:
    out = text
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def strip_ids(text: Column) -> Column:
    return F.regexp_replace(text, r' :id "[^"]*"', "")


def trim_line_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t]+\n", "\n")


def kebab(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, "([A-Z]+)([A-Z][a-z])", "$1-$2"), "([a-z0-9])([A-Z])", "$1-$2"))


def rename_word(text: Column, old: str, new: str) -> Column:
    return F.regexp_replace(text, rf"\b{old}\b", new)


def truncated(text: Column, size: int = 1024, marker: str = "... [truncated]") -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(marker))).otherwise(text)


def columns_40(left: Column, right: Column) -> Column:
    """A line of a side-by-side diff: 40 characters each, line breaks as spaces, the operation between them."""
    cell = lambda c: F.rpad(F.substring(F.translate(F.coalesce(c, F.lit("")), "\n", " "), 1, 40), 40, " ")
    op = F.when(left.isNull(), "+").when(right.isNull(), "-").when(left == right, " ").otherwise("|")
    return F.concat(cell(left), F.lit(" "), op, F.lit(" "), cell(right))


def adjacent_distinct(values: Column) -> Column:
    """Consecutive repeats removed, then empty strings."""
    kept = F.filter(F.transform(values, lambda x, i: F.when((i == 0) | (x != F.get(values, i - 1)), x)), lambda x: x.isNotNull())
    return F.filter(kept, lambda x: x != "")


def find_all(text: Column, needle: str) -> Column:
    """Every start of the needle, overlapping ones too (character offsets). The text is cut before each, and the pieces' lengths summed."""

    # every piece but the first begins with the needle
    first = F.startswith(text, F.lit(needle))
    pieces = F.transform(F.split(text, f"(?={re.escape(needle)})", -1), lambda p: F.length(p))
    return F.filter(prefix_sums(pieces), lambda i, k: (k > 0) | first)


def db_uri(uri: Column) -> Column:
    """ws://host:port of a ws or wss uri, port 8182 if it has none; null if it is not valid."""
    ok = uri.rlike(r"^wss?://[A-Za-z0-9.-]+(:[0-9]+)?(/.*)?$")
    return F.when(ok, F.concat(F.lit("ws://"), F.regexp_extract(uri, r"^wss?://([A-Za-z0-9.-]+)", 1), F.lit(":"), F.coalesce(F.nullif(F.regexp_extract(uri, r"^wss?://[A-Za-z0-9.-]+:([0-9]+)", 1), F.lit("")), F.lit("8182"))))
