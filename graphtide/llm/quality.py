"""Line-first cleaning: rules judge lines, failing lines go, and documents that lose too much text are rejected.

Built-in functions only, one pass, no shuffle: all figures of a document come from arrays of its own words, and
word windows are compared by their 64-bit hashes, sorted within the document.

Line rules (a line without a word is ignored): navigation (three or more bars), symbols (over a tenth of its
characters), shouting (three or more "!!"), boilerplate (legal and site phrases), punctuation (under 60
characters without any sentence mark). A document is rejected if the failing lines hold more than half of the
characters of its lines.

Defined results: null and empty texts have no words, fail the base rule and are not kept. Repeated rows get equal
results. Result columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.llm.columns import guarded
from graphtide.runtime import table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Phrases of legal and site boilerplate.
BOILERPLATE = r"(?i)(copyright|all rights reserved|licensed under|terms of (use|service)|privacy policy|cookie policy|click here|sign up|subscribe|permission is hereby granted)"
SHORT_LINE = 60


def failing(line: Column) -> Column:
    """Whether a line fails one of the line rules."""
    size = F.length(line)
    return (
        (size - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= 3)
        | (10 * (size - F.length(F.translate(line, SYMBOLS, ""))) > size)
        | line.like("%!!%!!%!!%")
        | line.rlike(BOILERPLATE)
        | ((size < SHORT_LINE) & ~line.rlike("[.!?,;:]"))
    )


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """value as a column of its own that later projections read and never compute again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


@guarded
def judge(docs: DataFrame, text: str = "text", max_lost: float = 0.5) -> DataFrame:
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "line_chars", "base_failed", "kept")
    df = docs.drop(*new).withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    df = _held(df, "__w", F.regexp_extract_all("__t", F.lit(WORD), F.lit(0)))
    n = F.size("__w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.xxhash64(F.get("__w", i - 2), F.get("__w", i - 1), F.get("__w", i)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = _held(df, "__a", F.struct(windows.alias("h"), lines.alias("l")))
    h = F.col("__a.h")
    df = _held(df, "__s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    s = F.col("__s")
    at = lambda i: F.get(s, i)
    same = F.filter(F.transform(s, lambda x, i: F.when((x["h"] == at(i + 1)["h"]) | (x["h"] == at(i - 1)["h"]), x["p"])), lambda p: p.isNotNull())
    df = _held(df, "__p", F.when(s.isNotNull(), F.sort_array(same)))
    p = F.col("__p")
    covered = F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(3), lambda acc, k: acc + F.least(F.lit(3), F.get(p, k) - F.get(p, k - 1)))
    line = F.col("__a.l")
    repeat = F.when(F.col("__p").isNull(), F.lit(0)).when(F.size(p) == 1, F.lit(3)).otherwise(covered)
    chars = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + F.length(x))
    df = df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_symbols": (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size(line) - F.size(F.array_distinct(line))).cast("long"),
            "n_repeat_words": repeat.cast("long"),
            "lost_chars": chars(F.filter(line, failing)).cast("long"),
            "line_chars": chars(line).cast("long"),
        }
    )
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= F.col("line_chars") * F.lit(max_lost)))
    return df.drop("__t", "__w", "__a", "__s", "__p")


def clean_text(text: Column) -> Column:
    """The text without its failing lines (lines without a word stay)."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & failing(x))), "\n")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, tri) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(list_sum(list_transform(list_filter(l, lambda x: length(x) - length(replace(x, '|', '')) >= 3
      OR 10 * (length(x) - length(translate(x, '#*$%&|<>', ''))) > length(x) OR x LIKE '%!!%!!%!!%'
      OR regexp_matches(x, '(?i)(copyright|all rights reserved|licensed under|terms of (use|service)|privacy policy|cookie policy|click here|sign up|subscribe|permission is hereby granted)')
      OR (length(x) < 60 AND NOT regexp_matches(x, '[.!?,;:]'))), lambda x: length(x))), 0) AS lost,
    coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS chars
  FROM d LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 2 * lost <= chars AS kept FROM f
"""
