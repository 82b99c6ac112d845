"""Benchmark decontamination by a prefix-filtered set join; built-in functions only.

Item windows (13 words, or the whole of a shorter item) are the sets to be contained. Their words are ordered by
rarity over all documents; as containment must be whole, the necessary prefix of a window is its rarest word. The
words of each document are joined with those prefix words, the word's offset in the window gives the only
possible place, length and position bounds drop places that leave the document, and the rest is verified
against the window's words in order.

Text never moves while the benchmark's windows are below BROADCAST_BYTES (measured): the words of a document are exploded, counted
and joined where they stand with the broadcast words, and only verified hits and one narrow row per document are
shuffled. Larger benchmarks are joined by shuffle: single words with their positions, then the stretches of words at
the places found.

Defined results: null and empty texts and items have no words; an empty benchmark contaminates nothing.
Repeated item rows count once by id; an item with a null id counts as the id "null". Rows that share an id keep
their own results. Result columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.llm.columns import guarded
from graphtide.runtime import cut, table

#: Words after A-Z has been lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
BROADCAST_BYTES = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text; lower() agrees with the A-Z rule where every character is ASCII, and is faster."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(w: the words of a window, ids: the items that hold it), one row for each distinct window."""
    w = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), words(F.col(text)).alias("ws")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - window + 1, F.lit(1)))
    return w.select("id", F.explode(F.transform(starts, lambda i: F.slice("ws", i, window))).alias("w")).groupBy("w").agg(F.collect_set("id").alias("ids"))


def _maybe_broadcast(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def hits(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, window: int) -> DataFrame:
    """(__k, n_words, start, size, ids): one row with n_words for each row of docs, and the verified occurrences; docs must have the row key __k."""
    win = cut(windows(items, item_id, item_text, window))
    size = win.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.expr("aggregate(w, 0L, (a, x) -> a + octet_length(x) + 24) + 8 * size(ids)")), F.lit(0)).alias("b")).first()
    small = size["b"] <= BROADCAST_BYTES
    known = win.select(F.explode("w").alias("word")).distinct()
    # one exploded word per row; only words of the benchmark survive the join
    split = docs.select("__k", words(F.col(text)).alias("ws"))
    seen = split.select(F.explode_outer("ws").alias("word")).join(_maybe_broadcast(known, small), "word").groupBy("word").count()
    rarity = known.join(seen, "word", "left").select("word", F.coalesce("count", F.lit(0)).alias("n"))
    least = (
        win.select("w", F.posexplode("w").alias("at", "word"))
        .join(_maybe_broadcast(rarity, small), "word")
        .groupBy("w")
        .agg(F.min(F.struct("n", "word", "at")).alias("least"))
        .select(F.col("least.word").alias("word"), F.col("least.at").alias("at"), F.size("w").alias("size"), F.col("w"))
    )
    found = _hits_here(docs, split, least) if small else _hits_apart(split, least)
    return found.join(_maybe_broadcast(win, small), "w", "left").select("__k", "n_words", "start", "size", "ids")


def _hits_here(docs: DataFrame, split: DataFrame, least: DataFrame) -> DataFrame:
    """(__k, start, size, w, n_words): the windows are broadcast and a document's words verified in their row."""
    ranked = least.groupBy("word").agg(F.collect_list(F.struct("at", "size", "w")).alias("places"))
    # an empty word before the first carries each document's word count through the same pass
    marker = docs.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(None).cast(ranked.schema["places"].dataType).alias("places"))
    led = split.select("__k", "ws", F.posexplode_outer(F.concat(F.array(F.lit("")), "ws")).alias("pos", "word")).select("__k", "ws", (F.col("pos") - 1).alias("pos"), "word")
    return _places(led.join(F.broadcast(ranked.unionByName(marker)), "word").select("__k", "ws", "pos", F.explode_outer("places").alias("p")))


def _hits_apart(split: DataFrame, least: DataFrame) -> DataFrame:
    """The same where the windows are too large to broadcast: (document, position, word) meet the prefix words by shuffle, the places they
    give meet their document's words, and the stretches there meet the windows. Only a stretch of one window's length moves with a place."""
    at = least.select("word", "at", "size").distinct()
    places = (
        split.select("__k", F.posexplode("ws").alias("pos", "word")).join(at, "word")
        .select("__k", (F.col("pos") - F.col("at")).alias("start"), "size").filter("start >= 0")
        .groupBy("__k").agg(F.collect_set(F.struct("start", "size")).alias("places"))
    )
    held = split.join(places, "__k", "left").select("__k", "ws", F.filter("places", lambda p: p["start"] + p["size"] <= F.size("ws")).alias("places"))
    stretch = lambda p: F.struct(p["start"].alias("start"), p["size"].alias("size"), F.slice("ws", p["start"] + 1, p["size"]).alias("w"))
    tried = held.select("__k", F.explode(F.transform("places", stretch)).alias("p")).select("__k", "p.start", "p.size", "p.w")
    found = tried.join(least.select("w"), "w", "left_semi").select("__k", "start", "size", "w", F.lit(None).cast("long").alias("n_words"))
    counts = split.select("__k", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("array<string>").alias("w"), F.size("ws").cast("long").alias("n_words"))
    return found.unionByName(counts)


def _places(joined: DataFrame) -> DataFrame:
    """Places that stay in the document and hold the whole window; rows without a place give the word count."""
    fits = "pos >= p.at AND pos - p.at + p.size <= size(ws) AND slice(ws, pos - p.at + 1, p.size) = p.w"
    return joined.filter(f"p IS NULL OR ({fits})").select("__k", (F.col("pos") - F.col("p.at")).alias("start"), F.col("p.size").alias("size"), F.col("p.w").alias("w"), F.when(F.col("p").isNull(), F.size("ws").cast("long")).alias("n_words"))


@guarded
def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_hit, item_ids (sorted strings), n_items and contaminated appended."""
    new = ("n_words", "n_hit", "item_ids", "n_items", "contaminated")
    docs = docs.drop(*new).withColumn("__k", F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))))
    found = hits(docs, items, text, item_id, item_text, window)
    # the union of the intervals: a start covers up to the next start at most
    per_start = found.groupBy("__k", "start").agg(F.max("n_words").alias("n_words"), F.max("size").alias("size"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"))
    per_doc = per_start.groupBy("__k").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "size")))).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"),
    )
    merged = F.aggregate(
        F.col("s"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(a["end"], x["start"]))).alias("n"), F.greatest(a["end"], x["start"] + x["size"]).alias("end")),
        lambda a: a["n"],
    )
    per_doc = per_doc.select("__k", "n_words", merged.cast("long").alias("n_hit"), F.col("ids").alias("item_ids"))
    out = docs.join(per_doc, "__k", "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "item_ids": F.coalesce("item_ids", F.array().cast("array<string>"))})
    return out.withColumns({"n_items": F.size("item_ids").cast("long"), "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))}).drop("__k")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    # the text is needed for the words only: the narrow columns are joined with the hits
    out = contamination(docs, items).drop("text")
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS k FROM i WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM q),
g AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, s WHERE len(w) >= n)),
m AS (SELECT doc_id, k, n, item_id FROM g JOIN (SELECT g, item_id FROM q) USING (g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
