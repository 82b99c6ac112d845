"""Queries that change a stored graph: ordered inserts, retractions, the co-located store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.operators import graph, ordering, tree, treediff
from graphtide.plans.adapters import EDGES_SQL, TREE_SQL, tree_nodes, tree_parts
from graphtide.plans.catalog import query
from graphtide.plans.io_queries import _folder
from graphtide.runtime import table
from graphtide.sources.store import GraphStore
from graphtide.streaming import changes, commits, durable, views

# after every return statement two new rows come, and one before the first child of every function
_NEW = """added AS (SELECT graph_id, parent_id, 1000000 + 2 * node_id + s AS node_id, node_id AS after, s AS seq FROM nodes, (VALUES (0), (1)) v(s) WHERE depth = 2 AND kind = 'return_statement'
  UNION ALL SELECT graph_id, node_id, 9000000 + node_id, NULL, 0 FROM nodes WHERE depth = 1 AND kind = 'function_definition')"""
_ORDER = f"""{_NEW}, placed AS (SELECT graph_id, parent_id, node_id, child_ord AS pos, -1 AS seq FROM nodes WHERE depth = 2
  UNION ALL SELECT a.graph_id, a.parent_id, a.node_id, coalesce(n.child_ord, 0), a.seq FROM added a LEFT JOIN nodes n ON n.graph_id = a.graph_id AND n.node_id = a.after)"""


def _inserted(spark: SparkSession, sf_dir: str) -> ordering.Insertion:
    nodes = tree_nodes(spark, sf_dir)
    after = nodes.filter("depth = 2 AND kind = 'return_statement'").select("graph_id", "parent_id", F.col("node_id").alias("after"), F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"))
    new = after.withColumn("node_id", F.lit(1000000) + 2 * F.col("after") + F.col("seq"))
    first = nodes.filter("depth = 1 AND kind = 'function_definition'").select("graph_id", F.col("node_id").alias("parent_id"), (F.lit(9000000) + F.col("node_id")).alias("node_id"), F.lit(None).cast("long").alias("after"), F.lit(0).alias("seq"))
    return ordering.insert(ordering.labelled(nodes.filter("depth = 2")), new.unionByName(first))


@query("ordered_inserts", f"WITH {TREE_SQL}, {_ORDER} SELECT graph_id, parent_id, CAST(node_id AS BIGINT) AS node_id, CAST(row_number() OVER (PARTITION BY graph_id, parent_id ORDER BY pos, seq) AS INT) AS child_ord FROM placed")
def ordered_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children after inserts by labels; the SQL numbers every parent anew."""
    return ordering.positions(_inserted(spark, sf_dir).table())


_CHAIN = f"""{_ORDER}, o AS (SELECT *, lead(node_id) OVER w AS nxt FROM placed WINDOW w AS (PARTITION BY graph_id, parent_id ORDER BY pos, seq)),
b AS (SELECT graph_id, node_id, lead(node_id) OVER (PARTITION BY graph_id, parent_id ORDER BY child_ord) AS nxt FROM nodes WHERE depth = 2)"""


@query("sibling_edge_changes", f"WITH {TREE_SQL}, {_CHAIN} SELECT 'added' AS change, graph_id, CAST(node_id AS BIGINT) AS src, CAST(nxt AS BIGINT) AS dst FROM o WHERE nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b WHERE b.graph_id = o.graph_id AND b.node_id = o.node_id AND b.nxt = o.nxt) UNION ALL SELECT 'removed', graph_id, node_id, nxt FROM b WHERE nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM o WHERE b.graph_id = o.graph_id AND b.node_id = o.node_id AND b.nxt = o.nxt)")
def sibling_edge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sibling edges that inserts add and split, from the new rows alone; the SQL compares the whole chains."""
    done = _inserted(spark, sf_dir)
    named = lambda change, edges: edges.select(F.lit(change).alias("change"), "graph_id", "src", "dst")
    return named("added", done.edges_added()).unionByName(named("removed", done.edges_removed()))


@query("insert_write_count", f"WITH {TREE_SQL}, {_NEW} SELECT graph_id, count(*) AS n_new, count(DISTINCT after) AS n_others FROM added GROUP BY 1")
def insert_write_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the inserts write: the new ones, and the rows before them, which get another neighbour."""
    return _inserted(spark, sf_dir).writes.groupBy("graph_id").agg(F.count_if("is_new").alias("n_new"), F.count_if(~F.col("is_new")).alias("n_others"))


_LEFT = "lines AS (SELECT l_suppkey AS id, CASE WHEN l_returnflag = 'R' THEN l_partkey + 5 ELSE l_partkey END AS message FROM lineitem WHERE NOT (l_linestatus = 'O' AND l_linenumber <= 2) AND l_suppkey % 10 <> 3)"


def _signed(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """All line items; then those that go, some of them the least of their supplier; then the updates of others."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("message"), "l_linestatus", "l_linenumber", "l_returnflag")
    gone = "(l_linestatus = 'O' AND l_linenumber <= 2) OR id % 10 = 3"
    changed = rows.filter(f"NOT ({gone}) AND l_returnflag = 'R'")
    update = changed.withColumn("sign", F.lit(-1)).unionByName(changed.withColumns({"message": F.col("message") + 5, "sign": F.lit(1)}))
    return [d.select("id", "message", "sign") for d in (rows.withColumn("sign", F.lit(1)), rows.filter(gone).withColumn("sign", F.lit(-1)), update)]


@query("view_after_retractions", f"WITH {_LEFT} SELECT id, count(*) AS n, CAST(sum(message) AS BIGINT) AS total, min(message) AS least, max(message) AS greatest FROM lines GROUP BY id")
def view_after_retractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined messages kept through inserts, deletes and updates, the last batch retried; the SQL aggregates what is left."""
    view = views.inboxes(spark, _folder(spark))
    for epoch, batch in enumerate(_signed(spark, sf_dir)):
        view.apply(batch, epoch)
    view.apply(batch, epoch)
    return view.read()


@query("replayed_log", "SELECT node_id, key, value FROM (SELECT c_custkey AS node_id, 'name' AS key, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer) WHERE key = 'segment'")
def replayed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of four batches through a listener, suspended for two of them and resumed by another object on the same folder."""
    folder, c = _folder(spark), table(spark, sf_dir, "customer")
    feed = c.select(F.col("c_custkey").alias("node_id"), F.explode(F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment")).alias("key", "value"))

    def heard() -> durable.DurableListeners:
        of = durable.DurableListeners(spark, f"{folder}/feed")
        of.on("segment", "log", durable.by_epoch(f"{folder}/log"))
        return of

    first = heard()
    for epoch in range(4):
        if epoch == 1:
            first.suspend()
        first.attach(feed.filter(F.pmod("node_id", F.lit(4)) == epoch), epoch)
    heard().resume()
    return spark.read.parquet(f"{folder}/log").select("node_id", "key", "value")


_STORED: dict[tuple[str, str], GraphStore] = {}


def _store(spark: SparkSession, sf_dir: str) -> GraphStore:
    """The store of a session: written once, read by every query on it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        nodes = tree_nodes(spark, sf_dir)
        # a bucket is sorted when it is written and when it is joined: buckets grow in number with the tables, not in size
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * tree_parts(spark, sf_dir))
        _STORED[key] = GraphStore.write(nodes, graph.syntax_edges(nodes), buckets=buckets)
    return _STORED[key]


@query("stored_degrees", f"WITH {TREE_SQL}, {EDGES_SQL} SELECT n.graph_id, n.node_id, (SELECT count(*) FROM edges e WHERE e.graph_id = n.graph_id AND e.src = n.node_id) AS n_out, (SELECT count(*) FROM edges e WHERE e.graph_id = n.graph_id AND e.dst = n.node_id) AS n_in FROM nodes n")
def stored_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of every node from the co-located store, without an exchange."""
    return _store(spark, sf_dir).degrees()


@query("stored_adjacency", f"WITH {TREE_SQL}, {EDGES_SQL} SELECT e.edge_type, n.kind, 'leaves' AS side, count(*) AS n FROM edges e JOIN nodes n ON n.graph_id = e.graph_id AND n.node_id = e.src GROUP BY ALL UNION ALL SELECT e.edge_type, n.kind, 'enters', count(*) FROM edges e JOIN nodes n ON n.graph_id = e.graph_id AND n.node_id = e.dst GROUP BY ALL")
def stored_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by type and the kind of node at either end; the joins run bucket by bucket."""
    store = _store(spark, sf_dir)
    count = lambda edges, kind, side: edges.groupBy("edge_type", F.col(kind).alias("kind"), F.lit(side).alias("side")).agg(F.count("*").alias("n"))
    return count(store.sources("kind"), "src_kind", "leaves").unionByName(count(store.targets("kind"), "dst_kind", "enters"))


@query("commit_processor_run", "SELECT path, step, file, CASE WHEN p IS NULL THEN 'baseline' WHEN p = h THEN 'unchanged' ELSE 'changed' END AS action FROM (SELECT *, lag(h) OVER (PARTITION BY path, file ORDER BY step) AS p FROM (SELECT coalesce(source, '') AS path, doc_id AS step, coalesce(lang, '') AS file, coalesce(sha256(text), '') AS h FROM documents))")
def commit_processor_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commit processor over all documents as versions of a file for each language of each source, through its own source."""
    own, folder = commits.with_rocksdb(spark), _folder(spark)
    d = table(own, sf_dir, "documents")
    blank = lambda c: F.coalesce(c, F.lit(""))
    v = d.select(blank(F.col("source")).alias("path"), F.col("doc_id").alias("step"), blank(F.col("lang")).alias("file"), blank(F.sha2("text", 256)).alias("content_hash"))
    commits.write_versions(v, f"{folder}/versions", steps_per_batch=1 << 20)
    done = changes.drained(commits.commits(commits.version_stream(own, f"{folder}/versions", 1 << 30)), folder)
    return spark.read.schema(done.schema).parquet(f"{folder}/out")


# the new version of the order tree has other kinds for some leaves and for some whole functions
_TOUCHED = "(n.depth = 2 AND n.node_id % 11 = 0) OR (n.depth = 1 AND n.child_ord % 13 = 0)"
_RANGES = f"""d AS (SELECT n.graph_id, n.node_id AS p FROM nodes n LEFT JOIN nodes q ON q.graph_id = n.graph_id AND q.node_id = n.parent_id WHERE {_TOUCHED} OR (n.depth = 2 AND q.child_ord % 13 = 0)),
i AS (SELECT graph_id, p, p - row_number() OVER (PARTITION BY graph_id ORDER BY p) AS island FROM d),
r AS MATERIALIZED (SELECT graph_id, min(p) AS start, CAST(max(p) + 1 AS BIGINT) AS "end" FROM i GROUP BY graph_id, island)"""


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_nodes(spark, sf_dir)
    kind = F.when(F.expr(_TOUCHED.replace("n.", "")), "modified").otherwise(F.col("kind"))

    def spans(version: DataFrame) -> DataFrame:
        return tree.with_paths(version).select("graph_id", "node_id", "parent_id", F.col("node_id").alias("start"), F.col("end_id").alias("end"), "depth", "path", "above")

    return treediff.changed_ranges(spans(nodes), spans(nodes.withColumn("kind", kind)))


@query("changed_tree_ranges", f"WITH {TREE_SQL}, {_RANGES} SELECT graph_id, start, \"end\" FROM r")
def changed_tree_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal ranges in which two versions of every tree differ, by the sweep; the SQL compares position by position."""
    return _changed(spark, sf_dir)


@query("changed_ranges_met", f"WITH {TREE_SQL}, {_RANGES}, e AS (SELECT graph_id, node_id AS start FROM nodes WHERE depth = 1 AND child_ord % 13 = 0), v AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.graph_id = r.graph_id AND e.start = r.start) THEN 'hit' ELSE 'unexpected' END AS verdict FROM r UNION ALL SELECT 'missing' FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE e.graph_id = r.graph_id AND e.start = r.start)) SELECT verdict, count(*) AS n FROM v GROUP BY 1")
def changed_ranges_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed ranges against expectations: one starts at every changed function, wherever it ends."""
    nodes = tree_nodes(spark, sf_dir).filter("depth = 1 AND child_ord % 13 = 0")
    expected = nodes.select("graph_id", F.col("node_id").alias("start"), F.lit(None).cast("long").alias("end"))
    return treediff.met(_changed(spark, sf_dir), expected, ["graph_id"], ["start", "end"]).groupBy("verdict").agg(F.count("*").alias("n"))
