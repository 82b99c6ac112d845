"""Queries over text versions: tokens, lines, edits, hashes, escaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphtide.functions import diff as D
from graphtide.functions import text as X
from graphtide.operators import spatial
from graphtide.plans.adapters import VERSIONS_SQL, version_hashes, versions
from graphtide.plans.catalog import query
from graphtide.runtime import table

W = f"WITH {VERSIONS_SQL} "


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")


#: Lists are unnested beside their places: naming the list in each row would copy it as often as it has parts.
TOKENS_SQL = r"tok AS (SELECT doc_id, unnest(generate_series(0, len(t) - 1)) AS pos, unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all(text, '\s+|\S+') AS t FROM documents)), off AS (SELECT doc_id, pos, token, sum(strlen(token)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS e FROM tok)"


@query("tokenise_offsets", f"WITH {TOKENS_SQL} SELECT doc_id, count(*) AS n_tokens, CAST(max(e) AS BIGINT) AS n_bytes, CAST(sum((pos + 1) * e) AS BIGINT) AS checksum FROM off GROUP BY doc_id")
def tokenise_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.token_offsets(_docs(spark, sf_dir), ["doc_id"], "text")
    return t.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.max("end_byte").alias("n_bytes"), F.sum((F.col("pos") + 1) * F.col("end_byte")).alias("checksum"))


@query("token_range_bytes", f"WITH {TOKENS_SQL} SELECT doc_id, CAST(min(e - strlen(token)) AS BIGINT) AS start_byte, CAST(max(e) AS BIGINT) AS end_byte FROM off WHERE pos >= 4 AND pos < 9 GROUP BY doc_id")
def token_range_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.token_range_bytes(X.token_offsets(_docs(spark, sf_dir), ["doc_id"], "text"), ["doc_id"], F.lit(4), F.lit(9))


LINES_SQL = "ln AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS line, CAST(coalesce(sum(strlen(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_start FROM (SELECT doc_id, unnest(generate_series(1, len(ls))) AS i, unnest(ls) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"


@query("line_index", f"WITH {LINES_SQL} SELECT * FROM ln")
def line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.line_index(_docs(spark, sf_dir), ["doc_id"], "text")


_POINTS = "pts AS (SELECT doc_id, unnest([CAST(strlen(text) // 3 AS BIGINT), CAST(strlen(text) // 2 AS BIGINT)]) AS \"offset\" FROM documents)"


@query("offset_to_point", f"WITH {LINES_SQL}, {_POINTS} SELECT DISTINCT p.doc_id, p.\"offset\", max(line) AS \"row\", p.\"offset\" - max(line_start) AS col FROM pts p JOIN ln ON ln.doc_id = p.doc_id AND line_start <= p.\"offset\" GROUP BY p.doc_id, p.\"offset\"")
def offset_to_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    n = F.octet_length("text")
    pts = d.select("doc_id", F.explode(F.array(F.floor(n / 3).cast("long"), F.floor(n / 2).cast("long"))).alias("offset")).distinct()
    return X.offset_to_point(pts, X.line_index(d, ["doc_id"], "text"), ["doc_id"])


@query("affected_lines", f"WITH {LINES_SQL}, r AS (SELECT doc_id, CAST(strlen(text) // 4 AS BIGINT) AS s, CAST(strlen(text) // 2 AS BIGINT) AS e FROM documents), a AS (SELECT r.doc_id, max(line) FILTER (line_start <= s) AS a, max(line) FILTER (line_start <= e) AS z FROM r JOIN ln USING (doc_id) GROUP BY 1) SELECT doc_id, z - a + 1 AS n_lines FROM a")
def affected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    n = F.octet_length("text")
    ranges = d.select("doc_id", F.floor(n / 4).cast("long").alias("start"), F.floor(n / 2).cast("long").alias("end"))
    return X.affected_lines(ranges, X.line_index(d, ["doc_id"], "text"), ["doc_id"])


@query("split_lines", "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INT) AS n_lines, sha256(string_split(text, chr(10))[-1]) AS last_sha FROM documents")
def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    return _docs(spark, sf_dir).select("doc_id", F.size(lines).alias("n_lines"), F.sha2(F.element_at(lines, -1), 256).alias("last_sha"))


@query("changed_versions", W + "SELECT path, step, CASE WHEN old IS NULL THEN 'new' ELSE 'changed' END AS status, sha256(new) AS content_hash FROM versions WHERE old IS DISTINCT FROM new")
def changed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes, not texts, are carried to the comparison."""
    v = version_hashes(spark, sf_dir).filter(~F.col("previous_content_hash").eqNullSafe(F.col("content_hash")))
    return v.select("path", "step", F.when(F.col("previous_content_hash").isNull(), "new").otherwise("changed").alias("status"), "content_hash")


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash, CAST(strlen(text) AS INT) AS n_bytes FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.octet_length("text").alias("n_bytes"))


@query("exists_probe", "SELECT b.item_id, EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = b.item_id * 7) AS found FROM benchmark b")
def exists_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") * 7).alias("doc_id"))
    hit = _docs(spark, sf_dir).select("doc_id").distinct().withColumn("hit", F.lit(True))
    return b.join(hit, "doc_id", "left").select("item_id", F.coalesce("hit", F.lit(False)).alias("found"))


@query("tree_walk_filter", "SELECT doc_id, source FROM documents WHERE contains(source, 'c1') AND ends_with(source, '1') AND length(text) > 0")
def tree_walk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).filter(F.contains("source", F.lit("c1")) & F.endswith("source", F.lit("1")) & (F.length("text") > 0)).select("doc_id", "source")


@query("empty_source", "SELECT CAST(NULL AS VARCHAR) AS path, CAST(0 AS BIGINT) AS n_bytes, sha256('') AS content_hash")
def empty_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphtide.sources.files import empty

    return empty(spark).select("path", "n_bytes", "content_hash")


@query("node_source_slice", "SELECT doc_id, CASE WHEN length(text) >= 40 THEN substr(text, 11, 30) ELSE '' END AS source FROM documents")
def node_source_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes from the eleventh to the fortieth character; a shorter text has no such range."""
    t = F.col("text")
    start, end = (F.octet_length(F.substring(t, 1, n)) for n in (10, 40))
    return _docs(spark, sf_dir).select("doc_id", X.node_source(t, start, F.when(F.length(t) >= 40, end).otherwise(-1)).alias("source"))


_EDITS = "e AS (SELECT doc_id, CAST(strlen(text) // 5 * k AS BIGINT) AS os, CAST(strlen(text) // 5 * k + 4 AS BIGINT) AS oe, CAST(strlen(text) // 5 * k + 3 * (k - 1) AS BIGINT) AS ns, CAST(strlen(text) // 5 * k + 3 * (k - 1) + 7 AS BIGINT) AS ne FROM documents, (VALUES (1), (2), (3)) v(k) WHERE strlen(text) > 100), pt AS (SELECT doc_id, CAST(strlen(text) // 7 * j AS BIGINT) AS pos FROM documents, (VALUES (1), (3), (5)) v(j) WHERE strlen(text) > 100 UNION ALL SELECT doc_id, os + 2 FROM e)"


@query("position_remap", f"WITH {_EDITS} SELECT pt.doc_id AS path, pos, coalesce(max(CASE WHEN os <= pos AND pos < oe THEN ns + (pos - os) * (ne - ns) // (oe - os) END), pos + coalesce(CAST(sum(CASE WHEN oe <= pos THEN (ne - ns) - (oe - os) END) AS BIGINT), 0)) AS new_pos FROM (SELECT DISTINCT * FROM pt) pt JOIN e USING (doc_id) GROUP BY pt.doc_id, pos")
def position_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).filter(F.octet_length("text") > 100).select(F.col("doc_id").alias("path"), F.octet_length("text").cast("long").alias("n"))
    s = F.floor(F.col("n") / 5)
    e = d.select("path", "n", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).select("path", (s * F.col("k")).alias("old_start"), (s * F.col("k") + 4).alias("old_end"), (s * F.col("k") + 3 * (F.col("k") - 1)).alias("new_start"), (s * F.col("k") + 3 * (F.col("k") - 1) + 7).alias("new_end"))
    pts = d.select("path", F.explode(F.array(*[F.floor(F.col("n") / 7) * j for j in (1, 3, 5)])).alias("pos")).unionByName(e.select("path", (F.col("old_start") + 2).alias("pos"))).distinct()
    return spatial.remap(pts, e)


@query("span_parse_distance", "WITH s AS (SELECT o_orderkey, '(' || o_custkey || ', ' || (o_custkey + 10) || ')' AS a, CASE WHEN o_orderkey % 9 = 0 THEN 'none' ELSE '(' || o_orderkey || ',' || (o_orderkey + 4) || ')' END AS b FROM orders) SELECT o_orderkey, abs(TRY_CAST(regexp_extract(a, '\\((\\d+),\\s*(\\d+)\\)', 1) AS BIGINT) - TRY_CAST(regexp_extract(b, '\\((\\d+),\\s*(\\d+)\\)', 1) AS BIGINT)) + abs(TRY_CAST(regexp_extract(a, '\\((\\d+),\\s*(\\d+)\\)', 2) AS BIGINT) - TRY_CAST(regexp_extract(b, '\\((\\d+),\\s*(\\d+)\\)', 2) AS BIGINT)) AS distance FROM s")
def span_parse_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a = F.format_string("(%d, %d)", "o_custkey", F.col("o_custkey") + 10)
    b = F.when(F.col("o_orderkey") % 9 == 0, "none").otherwise(F.format_string("(%d,%d)", "o_orderkey", F.col("o_orderkey") + 4))
    return o.select("o_orderkey", X.span_distance(a, b).alias("distance"))


@query("escape_and_trim", "SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')) AS escaped_sha, sha256(regexp_replace(replace(text, '. ', '. ' || chr(9) || chr(10)), '[ \\t]+\\n', chr(10), 'g')) AS trimmed_sha, CASE WHEN length(text) > 1024 THEN length(substr(text, 1, 1024) || '... [truncated]') ELSE length(text) END AS shown FROM documents")
def escape_and_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    loose = F.replace(F.col("text"), F.lit(". "), F.lit(". \t\n"))
    return d.select("doc_id", F.sha2(X.sexp_escape(F.col("text")), 256).alias("escaped_sha"), F.sha2(X.trim_line_ends(loose), 256).alias("trimmed_sha"), F.length(X.truncated(F.col("text"))).cast("long").alias("shown"))


@query("name_rewrites", "SELECT p_partkey, lower(regexp_replace(regexp_replace(p, '([A-Z]+)([A-Z][a-z])', '\\1-\\2', 'g'), '([a-z0-9])([A-Z])', '\\1-\\2', 'g')) AS kebab, regexp_replace(p_name, '\\bpart\\b', 'unit', 'g') AS renamed, regexp_replace('x :id \"' || p_partkey || '\" y', ' :id \"[^\"]*\"', '', 'g') AS stripped FROM (SELECT p_partkey, p_name, 'HTTPServer' || replace(initcap_type, ' ', '') || 'ParseURL' AS p FROM (SELECT p_partkey, p_name, p_brand AS initcap_type FROM part))")
def name_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    camel = F.concat(F.lit("HTTPServer"), F.replace("p_brand", F.lit(" "), F.lit("")), F.lit("ParseURL"))
    return p.select("p_partkey", X.kebab(camel).alias("kebab"), X.rename_word(F.col("p_name"), "part", "unit").alias("renamed"), X.strip_ids(F.concat(F.lit('x :id "'), "p_partkey", F.lit('" y'))).alias("stripped"))


@query("side_by_side", W + "SELECT path, step, rpad(substr(replace(coalesce(old, ''), chr(10), ' '), 1, 40), 40, ' ') || ' ' || CASE WHEN old IS NULL THEN '+' WHEN old = new THEN ' ' ELSE '|' END || ' ' || rpad(substr(replace(new, chr(10), ' '), 1, 40), 40, ' ') AS line FROM versions")
def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).select("path", "step", X.columns_40(F.col("old"), F.col("new")).alias("line"))


@query("adjacent_dedup", "WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, string_agg(event_type, '>' ORDER BY i) FILTER (p IS NULL OR p <> event_type) AS steps FROM f GROUP BY 1")
def adjacent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("l"))
    return e.select("user_id", F.array_join(X.adjacent_distinct(F.col("l.event_type")), ">").alias("steps"))


@query("find_all_positions", "SELECT doc_id, CAST(sum(i) AS BIGINT) AS position_sum, count(*) AS n FROM (SELECT doc_id, k, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k) + 2 * (k - 1) AS i, count(*) OVER (PARTITION BY doc_id) AS m FROM (SELECT doc_id, unnest(generate_series(1, len(ps))) AS k, unnest(ps) AS p FROM (SELECT doc_id, string_split(text, 'th') AS ps FROM documents))) WHERE k < m GROUP BY 1")
def find_all_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.explode(X.find_all(F.col("text"), "th")).alias("i")).groupBy("doc_id").agg(F.sum("i").alias("position_sum"), F.count("*").alias("n"))


@query("log_blocks", "SELECT doc_id, CAST(i - 1 AS INT) AS block, length(b) AS size FROM (SELECT doc_id, unnest(generate_series(1, len(bs))) AS i, unnest(bs) AS b FROM (SELECT doc_id, string_split(text, chr(10)) AS bs FROM documents)) WHERE contains(b, 'tion')")
def log_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("block", "b"))
    return rows.filter(F.contains("b", F.lit("tion"))).select("doc_id", "block", F.length("b").cast("long").alias("size"))


@query("regex_counts", "SELECT page_id, len(regexp_extract_all(html, '<li>')) AS n_items, regexp_extract(url, '\\.([a-z]+)/', 1) AS tld FROM pages")
def regex_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_count("html", F.lit("<li>")).cast("long").alias("n_items"), F.regexp_extract("url", r"\.([a-z]+)/", 1).alias("tld"))


@query("db_uri", "SELECT page_id, CASE WHEN regexp_matches(u, '^wss?://[A-Za-z0-9.-]+(:[0-9]+)?(/.*)?$') THEN 'ws://' || regexp_extract(u, '^wss?://([A-Za-z0-9.-]+)', 1) || ':' || coalesce(nullif(regexp_extract(u, '^wss?://[A-Za-z0-9.-]+:([0-9]+)', 1), ''), '8182') END AS uri FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'ws://h' || page_id WHEN 1 THEN 'wss://h.example:' || (page_id + 1000) || '/g' WHEN 2 THEN 'http://h' ELSE 'ws://bad host' END AS u FROM pages)")
def db_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    u = F.when(i % 4 == 0, F.concat(F.lit("ws://h"), i)).when(i % 4 == 1, F.concat(F.lit("wss://h.example:"), i + 1000, F.lit("/g"))).when(i % 4 == 2, "http://h").otherwise("ws://bad host")
    return p.select("page_id", X.db_uri(u).alias("uri"))


@query("colour_mix", "SELECT doc_id, CASE WHEN q THEN 255 ELSE 0 END AS red, CASE WHEN t THEN 255 ELSE 0 END AS green, CASE WHEN q AND t THEN 128 ELSE 0 END AS blue FROM (SELECT doc_id, quality = 1 AS q, toxic = 1 AS t FROM labels)")
def colour_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    on = lambda c, v: F.when(c, v).otherwise(0)
    return table(spark, sf_dir, "labels").select("doc_id", on(q, 255).alias("red"), on(t, 255).alias("green"), on(q & t, 128).alias("blue"))


@query("semantic_signature", "SELECT event_id, event_type || '|' || CASE WHEN value > 50 THEN 'high' ELSE 'low' END || '|' || coalesce(json_extract_string(props, '$.k'), '') AS signature FROM events")
def semantic_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat_ws("|", "event_type", F.when(F.col("value") > 50, "high").otherwise("low"), F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))).alias("signature"))


@query("numeric_coercion", "SELECT event_id, greatest(coalesce(TRY_CAST(CASE WHEN event_id % 6 = 0 THEN 'n/a' ELSE CAST(event_id % 13 AS VARCHAR) END AS DOUBLE), 0.1), 0.1) AS clipped, round((event_id % 13) / nullif(CAST(event_id % 5 AS DOUBLE), 0), 6) AS ratio FROM events")
def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    raw = F.when(i % 6 == 0, "n/a").otherwise((i % 13).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.greatest(F.coalesce(raw.try_cast("double"), F.lit(0.1)), F.lit(0.1)).alias("clipped"), F.round(F.try_divide((i % 13).cast("double"), F.nullif((i % 5).cast("double"), F.lit(0.0))), 6).alias("ratio"))


# edit scripts and patches are not SQL: their queries rebuild the new text from the old one, and SQL has the new text


@query("token_edit_scripts", "SELECT conv_id, turn, sha256(nxt) AS rebuilt FROM (SELECT conv_id, turn, lead(text) OVER w AS nxt, lead(turn) OVER w AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) WHERE t IS NOT NULL")
def token_edit_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest edit scripts from each turn of a conversation to the next one, applied."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    # a turn may have several rows: their place tells them apart
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("nth"), F.col("text").alias("old"), F.lead("text").over(w).alias("new"), F.lead("turn").over(w).alias("next")).filter("next IS NOT NULL")
    key = ["conv_id", "turn", "nth"]
    return D.rebuilt(c, D.edits(c, key), key).select("conv_id", "turn", F.sha2("text", 256).alias("rebuilt"))


@query("opcode_counts")
def opcode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", "text", F.lead("text").over(Window.partitionBy((F.col("item_id") % 16).alias("g")).orderBy("item_id")).alias("next"))
    return b.select("item_id", F.size(D.opcodes("text", "next")).alias("n"), F.round(D.sequence_ratio("text", "next"), 6).alias("ratio"))


@query("unified_diffs", "SELECT item_id, sha256(regexp_replace(text, 'the', 'THE', 'g')) AS rebuilt FROM benchmark")
def unified_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").withColumn("diff", D.unified_diff("text", F.regexp_replace("text", "the", "THE")))
    return b.select("item_id", F.sha2(D.patched("text", "diff"), 256).alias("rebuilt"))


@query("context_diffs", "SELECT item_id, CAST(length(text) AS BIGINT) AS n_old, CAST(length(replace(text, 'a', 'b')) AS BIGINT) AS n_new FROM benchmark")
def context_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of character comparisons in context; together they cover both texts."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(D.context_segments("text", F.replace("text", F.lit("a"), F.lit("b")))).alias("s"))
    return b.groupBy("item_id").agg(F.sum(F.col("s.a1") - F.col("s.a0")).alias("n_old"), F.sum(F.col("s.b1") - F.col("s.b0")).alias("n_new"))
