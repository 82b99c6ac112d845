"""Queries over the order tree: graph access, trees, spans, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphtide.operators import compare, graph, spatial, tree
from graphtide.operators.graph import EdgeQuery
from graphtide.plans.adapters import EDGES_SQL, TREE_SQL, tree_nodes
from graphtide.plans.catalog import query

_IN = ", ".join(f"'{t}'" for t in graph.DESCEND)
_KIND = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in graph.KIND_MAP.items()) + " ELSE 'LanguageImplementation' END"
TYPED_SQL = f"typed AS (SELECT *, {_KIND} AS node_type FROM nodes)"
W_TREE, W_EDGES, W_TYPED = f"WITH {TREE_SQL} ", f"WITH {TREE_SQL}, {EDGES_SQL} ", f"WITH {TREE_SQL}, {TYPED_SQL} "


def _spans(nodes: DataFrame) -> DataFrame:
    return graph.typed(nodes).select("graph_id", "node_id", F.col("node_id").alias("start"), F.col("end_id").alias("end"), "node_type")


def _queries(nodes: DataFrame) -> DataFrame:
    """Three ranges for each graph: a point, a narrow and a wide one (the last is turned round)."""
    size = nodes.filter("parent_id IS NULL").select("graph_id", F.col("end_id").alias("n"))
    q = F.explode(F.array(*[F.struct(F.lit(i).alias("query_id"), F.floor(F.col("n") * a / 10).alias("q_start"), F.floor(F.col("n") * z / 10).alias("q_end")) for i, (a, z) in enumerate(((4, 4), (2, 3), (8, 5)))]))
    return size.select("graph_id", q.alias("q")).select("graph_id", "q.query_id", "q.q_start", "q.q_end")


QUERIES_SQL = """ranges AS (SELECT graph_id, i AS query_id, CAST(floor(end_id * a / 10) AS BIGINT) AS q_start, CAST(floor(end_id * z / 10) AS BIGINT) AS q_end FROM nodes, (VALUES (0, 4, 4), (1, 2, 3), (2, 8, 5)) v(i, a, z) WHERE parent_id IS NULL)"""


@query("edge_query_children", W_EDGES + "SELECT e.graph_id, e.src, e.dst, s.dst AS right_sibling FROM edges e LEFT JOIN edges s ON s.graph_id = e.graph_id AND s.src = e.dst AND s.edge_type = 'SyntaxSibling' WHERE e.edge_type = 'SyntaxChild'")
def edge_query_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the sibling edge that leaves a child is the next child in the same window: both edge kinds in one pass, without a join
    nxt = F.lead("node_id").over(Window.partitionBy("graph_id", "parent_id").orderBy("child_ord", "node_id"))
    nodes = tree_nodes(spark, sf_dir).withColumn("right_sibling", nxt)
    kids = nodes.select("graph_id", F.col("parent_id").alias("src"), F.col("node_id").alias("dst"), F.lit("SyntaxChild").alias("edge_type"), "right_sibling").filter("src IS NOT NULL")
    return EdgeQuery().edge_type("SyntaxChild").query(kids).drop("edge_type")


@query("edge_query_point", W_EDGES + "SELECT graph_id, src, dst, edge_type FROM edges WHERE src = 1 AND edge_type = 'SyntaxChild'")
def edge_query_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EdgeQuery().src(1).edge_type("SyntaxChild").query(graph.syntax_edges(tree_nodes(spark, sf_dir)))


@query("outgoing_edges", W_EDGES + "SELECT e.* FROM edges e JOIN nodes n ON e.graph_id = n.graph_id AND e.src = n.node_id WHERE n.kind = 'function_definition'")
def outgoing_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_nodes(spark, sf_dir)
    return graph.outgoing(graph.syntax_edges(nodes), nodes.filter("kind = 'function_definition'")).select("graph_id", "src", "dst", "edge_type")


@query("incoming_edges", W_EDGES + "SELECT e.* FROM edges e JOIN nodes n ON e.graph_id = n.graph_id AND e.dst = n.node_id WHERE n.kind = 'return_statement'")
def incoming_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_nodes(spark, sf_dir)
    return graph.incoming(graph.syntax_edges(nodes), nodes.filter("kind = 'return_statement'")).select("graph_id", "src", "dst", "edge_type")


@query("node_by_id", W_TREE + "SELECT graph_id, node_id, kind, name FROM nodes WHERE node_id = 2")
def node_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_nodes(spark, sf_dir).filter("node_id = 2").select("graph_id", "node_id", "kind", "name")


@query("top_level_units", W_TYPED + "SELECT graph_id, name, max(node_id) AS node_id FROM typed WHERE depth = 1 AND node_type = 'Function' GROUP BY ALL")
def top_level_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_level_units(tree_nodes(spark, sf_dir))


@query("kind_map_project", W_TYPED + f"SELECT graph_id, node_id, node_type, node_type || ' ' || name AS label, CASE node_type WHEN 'TranslationUnit' THEN 'grey' WHEN 'Function' THEN 'lightblue' WHEN 'Branch' THEN 'orange' WHEN 'Loop' THEN 'orange' WHEN 'Return' THEN 'red' ELSE 'white' END AS colour, node_type IN ({_IN}) AS descends FROM typed")
def kind_map_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph.typed(tree_nodes(spark, sf_dir))
    t = F.col("node_type")
    return n.select("graph_id", "node_id", "node_type", graph.label(t, F.col("name")).alias("label"), graph.colour(t).alias("colour"), graph.should_descend(t).alias("descends"))


@query("language_lookup", "SELECT doc_id, CASE lower(lang) WHEN 'c' THEN 'C' WHEN 'h' THEN 'C' WHEN 'c++' THEN 'C' WHEN 'cpp' THEN 'C' WHEN 'clang' THEN 'C' WHEN 'py' THEN 'Python' WHEN 'python' THEN 'Python' END AS language FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'CPP' WHEN 1 THEN 'h' WHEN 2 THEN 'Py' ELSE lang END AS lang FROM documents)")
def language_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    alias = F.when(F.col("doc_id") % 4 == 0, "CPP").when(F.col("doc_id") % 4 == 1, "h").when(F.col("doc_id") % 4 == 2, "Py").otherwise(F.col("lang"))
    return d.select("doc_id", graph.language(alias).alias("language"))


@query("processable_children", W_TYPED + f"SELECT graph_id, parent_id, node_id, CAST(row_number() OVER (PARTITION BY graph_id, parent_id ORDER BY child_ord) AS INT) AS ord FROM typed WHERE parent_id IS NOT NULL AND node_type IN ({_IN})")
def processable_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ordered_children(tree_nodes(spark, sf_dir), processable=True)


@query("ordered_children", W_TREE + "SELECT graph_id, parent_id, node_id, CAST(row_number() OVER (PARTITION BY graph_id, parent_id ORDER BY child_ord) AS INT) AS ord FROM nodes WHERE parent_id IS NOT NULL")
def ordered_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ordered_children(tree_nodes(spark, sf_dir))


@query("graph_counts", W_EDGES + "SELECT n.graph_id, n_nodes, coalesce(n_edges, 0) AS n_edges FROM (SELECT graph_id, count(*) AS n_nodes FROM nodes GROUP BY 1) n LEFT JOIN (SELECT graph_id, count(*) AS n_edges FROM edges GROUP BY 1) e USING (graph_id)")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_nodes(spark, sf_dir)
    # both edge kinds follow from the nodes: counted together in one aggregation
    e = graph.syntax_edges(nodes).groupBy("graph_id").agg(F.count("*").alias("n_edges"))
    return nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes")).join(e, "graph_id", "left").fillna(0, ["n_edges"])


@query("node_equality", W_TREE + "SELECT l.graph_id, l.node_id AS l_id, r.node_id AS r_id, l.name IS NOT DISTINCT FROM r.name AND l.kind IS NOT DISTINCT FROM r.kind AS equal FROM nodes l JOIN nodes r ON l.graph_id = r.graph_id AND l.parent_id = r.parent_id AND r.child_ord = l.child_ord + 1")
def node_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tree_nodes(spark, sf_dir).filter("parent_id IS NOT NULL")
    l, r = n.alias("l"), n.alias("r")  # noqa: E741
    both = l.join(r, (F.col("l.graph_id") == F.col("r.graph_id")) & (F.col("l.parent_id") == F.col("r.parent_id")) & (F.col("r.child_ord") == F.col("l.child_ord") + 1))
    return both.select("l.graph_id", F.col("l.node_id").alias("l_id"), F.col("r.node_id").alias("r_id"), graph.same_node().alias("equal"))


@query("adjacent_pairs", W_TREE + "SELECT graph_id, node_id, nxt FROM (SELECT graph_id, node_id, kind, lead(node_id) OVER w AS nxt, lead(kind) OVER w AS nk FROM nodes WHERE depth = 1 WINDOW w AS (PARTITION BY graph_id, parent_id ORDER BY child_ord)) WHERE kind = nk")
def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("graph_id", "parent_id").orderBy("child_ord")
    n = tree_nodes(spark, sf_dir).filter("depth = 1").select("graph_id", "node_id", "kind", F.lead("node_id").over(w).alias("nxt"), F.lead("kind").over(w).alias("nk"))
    return n.filter("kind = nk").select("graph_id", "node_id", "nxt")


@query("sibling_rechain", W_TREE + "SELECT graph_id, node_id AS src, nxt AS dst FROM (SELECT graph_id, node_id, lead(node_id) OVER (PARTITION BY graph_id, parent_id ORDER BY child_ord) AS nxt FROM nodes WHERE parent_id IS NOT NULL AND kind <> 'comment') WHERE nxt IS NOT NULL")
def sibling_rechain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sibling_chain(tree_nodes(spark, sf_dir).filter("kind <> 'comment'")).select("graph_id", "src", "dst")


@query("edge_insert_dedup", W_EDGES + "SELECT DISTINCT graph_id, src, dst, edge_type FROM (SELECT * FROM edges UNION ALL SELECT graph_id, src, dst, edge_type FROM edges WHERE edge_type = 'SyntaxChild' UNION ALL SELECT graph_id, node_id, 0, 'ControlFlowEpsilon' FROM nodes WHERE kind = 'return_statement')")
def edge_insert_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_nodes(spark, sf_dir)
    new = graph.child_edges(nodes).unionByName(nodes.filter("kind = 'return_statement' OR parent_id IS NULL").select("graph_id", F.col("node_id").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit("ControlFlowEpsilon").alias("edge_type")))
    return graph.add_edges(graph.syntax_edges(nodes), new, drop_loops=True)


@query("edge_removal", W_EDGES + "SELECT graph_id, src, dst, edge_type FROM edges WHERE NOT (edge_type = 'SyntaxSibling' AND dst % 2 = 0)")
def edge_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.syntax_edges(tree_nodes(spark, sf_dir))
    return graph.remove_edges(edges, edges.filter("edge_type = 'SyntaxSibling' AND dst % 2 = 0")).select("graph_id", "src", "dst", "edge_type")


@query("edge_endpoints", W_EDGES + "SELECT edge_type, s.kind AS src_kind, d.kind AS dst_kind, count(*) AS n FROM edges e JOIN nodes s ON s.graph_id = e.graph_id AND s.node_id = e.src JOIN nodes d ON d.graph_id = e.graph_id AND d.node_id = e.dst GROUP BY ALL")
def edge_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_nodes(spark, sf_dir)
    return graph.resolve(graph.syntax_edges(nodes), nodes, "kind").groupBy("edge_type", "src_kind", "dst_kind").agg(F.count("*").alias("n"))


@query("roots_and_validation", W_EDGES + "SELECT n.graph_id, n.n AS n_nodes, coalesce(e.n, 0) AS n_edges, coalesce(e.n, 0) = n.n - 1 AND n.r = 1 AND coalesce(e.m, 0) <= 1 AS is_tree FROM (SELECT graph_id, count(*) AS n, count(*) FILTER (parent_id IS NULL) AS r FROM nodes GROUP BY 1) n LEFT JOIN (SELECT graph_id, CAST(sum(c) AS BIGINT) AS n, max(c) AS m FROM (SELECT graph_id, dst, count(*) AS c FROM edges WHERE edge_type = 'SyntaxChild' GROUP BY ALL) GROUP BY 1) e USING (graph_id)")
def roots_and_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_nodes(spark, sf_dir)
    return graph.tree_checks(nodes, graph.child_edges(nodes))


@query("root_nodes", W_EDGES + "SELECT graph_id, node_id, kind FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.dst = n.node_id AND e.edge_type = 'SyntaxChild')")
def root_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_nodes(spark, sf_dir)
    return graph.roots(nodes, graph.child_edges(nodes)).select("graph_id", "node_id", "kind")


@query("dangling_edges", W_EDGES + "SELECT graph_id, src, dst, edge_type FROM edges e WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.graph_id = e.graph_id AND n.kind = 'comment' AND n.node_id IN (e.src, e.dst))")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that a removal of all comments without clean-up would leave behind."""
    nodes = tree_nodes(spark, sf_dir)
    return graph.dangling(graph.syntax_edges(nodes), nodes.filter("kind <> 'comment'"))


@query("orphan_returns", W_EDGES + "SELECT graph_id, node_id FROM nodes n WHERE kind = 'return_statement' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.dst = n.node_id AND e.edge_type = 'SyntaxSibling')")
def orphan_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_nodes(spark, sf_dir)
    return graph.roots(nodes.filter("kind = 'return_statement'"), graph.sibling_chain(nodes)).select("graph_id", "node_id")


@query("edge_type_histogram", W_EDGES + "SELECT graph_id, src, edge_type, count(*) AS n FROM edges GROUP BY ALL")
def edge_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_histogram(graph.syntax_edges(tree_nodes(spark, sf_dir)))


@query("canonical_edge_order", W_EDGES + "SELECT graph_id, src, dst, edge_type, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY src, s_end, dst, d_end, edge_type, s_kind, d_kind) AS INT) AS pos FROM (SELECT e.*, s.end_id AS s_end, d.end_id AS d_end, s.kind AS s_kind, d.kind AS d_kind FROM edges e JOIN nodes s ON s.graph_id = e.graph_id AND s.node_id = e.src JOIN nodes d ON d.graph_id = e.graph_id AND d.node_id = e.dst)")
def canonical_edge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_nodes(spark, sf_dir)
    return graph.canonical_edge_order(graph.syntax_edges(nodes), nodes)


@query("canonical_ids", W_TREE + "SELECT graph_id, node_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY node_id) AS INT) AS canonical_id FROM nodes WHERE kind <> 'comment'")
def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.canonical_ids(tree_nodes(spark, sf_dir).filter("kind <> 'comment'"))


@query("path_navigation", W_TREE + "SELECT b.graph_id, b.node_id FROM nodes a JOIN nodes b ON b.graph_id = a.graph_id AND b.parent_id = a.node_id AND b.child_ord = 3 WHERE a.parent_id = 0 AND a.child_ord = 2")
def path_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.navigate(tree_nodes(spark, sf_dir), [2, 3])


@query("descendants_postorder", W_TREE + ", r AS (SELECT graph_id, node_id, lpad(CAST(child_ord AS VARCHAR), 6, '0') AS p FROM nodes WHERE depth = 1 UNION ALL SELECT n.graph_id, n.node_id, lpad(CAST(f.child_ord AS VARCHAR), 6, '0') || '/' || lpad(CAST(n.child_ord AS VARCHAR), 6, '0') FROM nodes n JOIN nodes f ON f.graph_id = n.graph_id AND f.node_id = n.parent_id WHERE n.depth = 2 UNION ALL SELECT graph_id, node_id, '' FROM nodes WHERE depth = 0) SELECT graph_id, node_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY p || '~') AS INT) AS post FROM r")
def descendants_postorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.postorder(tree_nodes(spark, sf_dir))


_ANC = "a AS (SELECT n.graph_id, n.node_id, t.node_id AS anc, t.node_type, t.depth FROM nodes n JOIN typed t ON t.graph_id = n.graph_id AND t.node_id <= n.node_id AND n.node_id < t.end_id)"


@query("nearest_container", W_TYPED + f", {_ANC} SELECT graph_id, node_id, coalesce(arg_max(anc, depth) FILTER (node_type IN ('Block', 'Function', 'TranslationUnit')), node_id) AS container_id FROM a GROUP BY graph_id, node_id")
def nearest_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.nearest_container(tree_nodes(spark, sf_dir))


@query("containing_function", W_TYPED + f", {_ANC} SELECT graph_id, node_id, arg_max(anc, depth) FILTER (node_type = 'Function') AS function_id FROM a GROUP BY graph_id, node_id")
def containing_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.containing_function(tree_nodes(spark, sf_dir))


@query("first_processable", W_TYPED + f" SELECT t.graph_id, t.node_id, min(d.node_id) AS first_id FROM typed t LEFT JOIN typed d ON d.graph_id = t.graph_id AND d.node_id >= t.node_id AND d.node_id < t.end_id AND d.node_type IN ({_IN}) GROUP BY ALL")
def first_processable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.first_processable(tree_nodes(spark, sf_dir))


@query("entry_points", W_TYPED + f", c AS (SELECT graph_id, parent_id, arg_min(node_id, child_ord) AS go FROM typed WHERE node_type IN ({_IN}) AND parent_id IS NOT NULL GROUP BY ALL) SELECT n.graph_id, n.node_id, coalesce(c2.go, c1.go, n.node_id) AS entry_id FROM nodes n LEFT JOIN c c1 ON c1.graph_id = n.graph_id AND c1.parent_id = n.node_id LEFT JOIN c c2 ON c2.graph_id = n.graph_id AND c2.parent_id = c1.go")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.entry_points(tree_nodes(spark, sf_dir))


@query("functions_in_subtree", W_TYPED + " SELECT t.graph_id, t.node_id, count(*) AS n_functions FROM typed t JOIN typed d ON d.graph_id = t.graph_id AND d.node_id >= t.node_id AND d.node_id < t.end_id AND d.node_type = 'Function' GROUP BY ALL")
def functions_in_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.functions_in_subtree(tree_nodes(spark, sf_dir), graph.kind_to_type(F.col("kind")) == "Function")


@query("subtree_depth", W_TREE + ", a AS (SELECT t.graph_id, t.node_id, t.depth, max(d.depth) AS low FROM nodes t JOIN nodes d ON d.graph_id = t.graph_id AND d.node_id >= t.node_id AND d.node_id < t.end_id GROUP BY ALL) SELECT graph_id, node_id, low - depth + 1 AS levels FROM a")
def subtree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.subtree_depth(tree_nodes(spark, sf_dir))


_GONE = "gone AS (SELECT d.graph_id, d.node_id FROM nodes t JOIN nodes d ON d.graph_id = t.graph_id AND d.node_id >= t.node_id AND d.node_id < t.end_id WHERE t.depth = 1 AND t.kind = 'declaration')"


@query("subtree_removal_nodes", W_TREE + f", {_GONE} SELECT graph_id, node_id FROM nodes EXCEPT SELECT graph_id, node_id FROM gone")
def subtree_removal_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_nodes(spark, sf_dir)
    return tree.remove_subtrees(nodes, graph.child_edges(nodes), nodes.filter("depth = 1 AND kind = 'declaration'").select("graph_id", "node_id"))[0].select("graph_id", "node_id")


@query("subtree_removal_edges", W_EDGES + f", {_GONE} SELECT graph_id, src, dst, edge_type FROM edges e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.graph_id = e.graph_id AND g.node_id IN (e.src, e.dst))")
def subtree_removal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_nodes(spark, sf_dir)
    return tree.remove_subtrees(nodes, graph.syntax_edges(nodes), nodes.filter("depth = 1 AND kind = 'declaration'").select("graph_id", "node_id"))[1].select("graph_id", "src", "dst", "edge_type")


@query("span_hull", W_TREE + "SELECT graph_id, parent_id AS node_id, min(node_id) AS hull_start, max(end_id) AS hull_end FROM nodes WHERE parent_id IS NOT NULL GROUP BY ALL")
def span_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.span_hull(tree_nodes(spark, sf_dir))


@query("span_propagate", W_TREE + ", s AS (SELECT graph_id, node_id, parent_id, depth, end_id, CASE WHEN depth = 2 THEN node_id - weight ELSE node_id END AS a, CASE WHEN depth = 2 THEN end_id + weight ELSE node_id + 1 END AS z FROM nodes) SELECT t.graph_id, t.node_id, min(d.a) AS a, max(d.z) AS z FROM s t JOIN s d ON d.graph_id = t.graph_id AND d.node_id >= t.node_id AND d.node_id < t.end_id GROUP BY ALL")
def span_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tree_nodes(spark, sf_dir)
    leaf = F.col("depth") == 2
    n = n.withColumns({"a": F.when(leaf, F.col("node_id") - F.col("weight")).otherwise(F.col("node_id").cast("double")), "z": F.when(leaf, F.col("end_id") + F.col("weight")).otherwise(F.col("node_id") + 1.0)})
    return tree.propagate_spans(n, "a", "z")


@query("structural_hash", W_TREE + ", l AS (SELECT graph_id, node_id, parent_id, child_ord, sha256(kind || '-' || child_ord) AS h FROM nodes WHERE depth = 2), f AS (SELECT n.graph_id, n.node_id, n.child_ord, sha256(n.kind || '-' || coalesce(string_agg(l.h, '-' ORDER BY l.child_ord), CAST(n.child_ord AS VARCHAR))) AS h FROM nodes n LEFT JOIN l ON l.graph_id = n.graph_id AND l.parent_id = n.node_id WHERE n.depth = 1 GROUP BY n.graph_id, n.node_id, n.child_ord, n.kind), r AS (SELECT n.graph_id, n.node_id, sha256(n.kind || '-' || string_agg(f.h, '-' ORDER BY f.child_ord)) AS h FROM nodes n JOIN f ON f.graph_id = n.graph_id WHERE n.depth = 0 GROUP BY n.graph_id, n.node_id, n.kind) SELECT graph_id, node_id, h AS hash FROM l UNION ALL SELECT graph_id, node_id, h FROM f UNION ALL SELECT graph_id, node_id, h FROM r")
def structural_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.structural_hash(tree_nodes(spark, sf_dir))


@query("structural_path", W_TREE + "SELECT n.graph_id, n.node_id, CASE n.depth WHEN 0 THEN n.kind WHEN 1 THEN 'translation_unit/' || n.kind ELSE 'translation_unit/' || p.kind || '/' || n.kind END AS path FROM nodes n LEFT JOIN nodes p ON p.graph_id = n.graph_id AND p.node_id = n.parent_id")
def structural_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.paths_to_root(tree_nodes(spark, sf_dir))


_W_RANGES = f"WITH {TREE_SQL}, {TYPED_SQL}, {QUERIES_SQL} "


@query("point_stab", _W_RANGES + "SELECT n.graph_id, query_id, node_id FROM nodes n JOIN ranges q ON q.graph_id = n.graph_id AND node_id <= q_start AND q_start < end_id")
def point_stab(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_nodes(spark, sf_dir)
    return spatial.stab(_spans(nodes), _queries(nodes).select("graph_id", "query_id", F.col("q_start").alias("point"))).select("graph_id", "query_id", "node_id")


@query("range_overlap", _W_RANGES + "SELECT n.graph_id, query_id, node_id FROM nodes n JOIN ranges q ON q.graph_id = n.graph_id AND least(q_start, q_end) <= end_id AND node_id < greatest(q_start, q_end)")
def range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_nodes(spark, sf_dir)
    return spatial.overlap(_spans(nodes), _queries(nodes)).select("graph_id", "query_id", "node_id")


@query("range_within", _W_RANGES + "SELECT n.graph_id, query_id, node_id FROM nodes n JOIN ranges q ON q.graph_id = n.graph_id AND least(q_start, q_end) < end_id AND node_id < greatest(q_start, q_end)")
def range_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_nodes(spark, sf_dir)
    return spatial.within(_spans(nodes), _queries(nodes)).select("graph_id", "query_id", "node_id")


@query("dyadic_cover", W_TREE + "SELECT graph_id, node_id, CAST(end_id - node_id AS BIGINT) AS covered, true AS few FROM nodes")
def dyadic_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of every span: together they are as long as the span, and at most two of a level."""
    c = spatial.cells(tree_nodes(spark, sf_dir).select("graph_id", "node_id", "end_id"), "node_id", F.col("end_id") - 1)
    by_level = c.groupBy("graph_id", "node_id", "level").agg(F.count("*").alias("n"))
    size = F.expr("sum(n * shiftleft(1L, level))").alias("covered")
    return by_level.groupBy("graph_id", "node_id").agg(size, (F.max("n") <= 2).alias("few"))


@query("range_strategies", _W_RANGES + "SELECT s.strategy, query_id, count(*) AS n FROM nodes n JOIN ranges q ON q.graph_id = n.graph_id AND node_id <= q_start AND q_end <= end_id, (VALUES ('dyadic'), ('bins'), ('scan')) s(strategy) GROUP BY ALL")
def range_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every strategy finds the same spans around every range."""
    nodes = tree_nodes(spark, sf_dir)
    spans, asked = _spans(nodes), _queries(nodes)
    found = [spatial.RangeIndex(spans, s).containing(asked).groupBy(F.lit(s).alias("strategy"), "query_id").agg(F.count("*").alias("n")) for s in spatial.RangeIndex.STRATEGIES]
    return found[0].unionByName(found[1]).unionByName(found[2])


_PRIO = "CASE node_type WHEN 'TranslationUnit' THEN 0 WHEN 'Block' THEN 1 WHEN 'Function' THEN 2 WHEN 'Statement' THEN 3 ELSE 4 END"


@query("smallest_containing", _W_RANGES + f"SELECT q.graph_id, query_id, node_id FROM typed n JOIN ranges q ON q.graph_id = n.graph_id AND node_id <= q_start AND q_end <= end_id QUALIFY row_number() OVER (PARTITION BY q.graph_id, query_id ORDER BY end_id - node_id, {_PRIO}, node_id) = 1")
def smallest_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_nodes(spark, sf_dir)
    return spatial.smallest_containing(_spans(nodes), _queries(nodes))


@query("parent_for_range", _W_RANGES + f"SELECT q.graph_id, query_id, node_id FROM typed n JOIN ranges q ON q.graph_id = n.graph_id AND node_id <= q_start QUALIFY row_number() OVER (PARTITION BY q.graph_id, query_id ORDER BY {_PRIO}, greatest(q_end - end_id, 0), q_start - node_id, node_id) = 1")
def parent_for_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_nodes(spark, sf_dir)
    return spatial.parent_for_range(_spans(nodes), _queries(nodes))


@query("dirty_node_merge", _W_RANGES + f", m AS (SELECT q.graph_id, query_id, node_id, q_start, q_end FROM typed n JOIN ranges q ON q.graph_id = n.graph_id AND node_id <= q_start AND q_end <= end_id QUALIFY row_number() OVER (PARTITION BY q.graph_id, query_id ORDER BY end_id - node_id, {_PRIO}, node_id) = 1) SELECT graph_id, node_id, min(q_start) AS old_start, max(q_end) AS old_end, min(q_start + 1) AS new_start, max(q_end + 3) AS new_end, count(*) AS n_ranges FROM m GROUP BY ALL")
def dirty_node_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_nodes(spark, sf_dir)
    q = _queries(nodes).withColumns({"new_start": F.col("q_start") + 1, "new_end": F.col("q_end") + 3})
    return spatial.dirty_nodes(_spans(nodes), q)


@query("interval_merge", W_TREE + ", s AS (SELECT graph_id, node_id AS a, CAST(node_id + weight % 4 AS BIGINT) AS z FROM nodes WHERE depth = 2), g AS (SELECT *, sum(b) OVER (PARTITION BY graph_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY graph_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS b FROM s)) SELECT graph_id, min(a) AS start, max(z) AS \"end\", count(*) AS n FROM g GROUP BY graph_id, island")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tree_nodes(spark, sf_dir).filter("depth = 2").select("graph_id", F.col("node_id").alias("start"), (F.col("node_id") + F.col("weight") % 4).cast("long").alias("end"))
    return spatial.merge(s, ["graph_id"])


# two versions of the tree: the right one has no comments and other names for every fifth leaf
_LEFT = "l AS (SELECT graph_id, parent_id, node_id, kind, name FROM nodes WHERE depth = 2)"
_RIGHT = "r AS (SELECT graph_id, parent_id, node_id, kind, CASE WHEN node_id % 5 = 0 THEN name || 'x' ELSE name END AS name FROM nodes WHERE depth = 2 AND kind <> 'comment')"
_ZIP = f"{_LEFT}, {_RIGHT}, z AS (SELECT coalesce(a.graph_id, b.graph_id) AS graph_id, coalesce(a.parent_id, b.parent_id) AS parent_id, coalesce(a.pos, b.pos) AS pos, a.name AS l_value, b.name AS r_value FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, parent_id ORDER BY node_id) AS pos FROM l) a FULL JOIN (SELECT *, row_number() OVER (PARTITION BY graph_id, parent_id ORDER BY node_id) AS pos FROM r) b ON a.graph_id = b.graph_id AND a.parent_id = b.parent_id AND a.pos = b.pos)"
_OP = "CASE WHEN r_value IS NULL THEN 'delete' WHEN l_value IS NULL THEN 'insert' WHEN l_value = r_value THEN 'keep' ELSE 'modify' END"


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left = tree_nodes(spark, sf_dir).filter("depth = 2").select("graph_id", "parent_id", "node_id", "kind", "name")
    right = left.filter("kind <> 'comment'").withColumn("name", F.when(F.col("node_id") % 5 == 0, F.concat("name", F.lit("x"))).otherwise(F.col("name")))
    return left, right


@query("zip_longest", W_TREE + f", {_ZIP} SELECT graph_id, parent_id, CAST(pos AS INT) AS pos, l_value, r_value FROM z")
def zip_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.zip_longest(*_two(spark, sf_dir), ["graph_id", "parent_id"], ["node_id"], "name")


@query("positional_alignment", W_TREE + f", {_ZIP} SELECT graph_id, parent_id, CAST(pos AS INT) AS pos, l_value, r_value, {_OP} AS op FROM z")
def positional_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.positional(*_two(spark, sf_dir), ["graph_id", "parent_id"], ["node_id"], "name")


@query("first_difference", W_TREE + f", {_ZIP} SELECT graph_id, parent_id, CAST(min(pos) AS INT) AS first_diff FROM z WHERE l_value IS DISTINCT FROM r_value GROUP BY ALL")
def first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.first_difference(compare.zip_longest(*_two(spark, sf_dir), ["graph_id", "parent_id"], ["node_id"], "name"), ["graph_id", "parent_id"])


_COUNTS = f"c AS (SELECT graph_id, parent_id, count(*) FILTER (op = 'insert') AS n_insert, count(*) FILTER (op = 'delete') AS n_delete, count(*) FILTER (op = 'modify') AS n_modify, count(*) FILTER (op = 'keep') AS n_keep FROM (SELECT *, {_OP} AS op FROM z) GROUP BY ALL)"


@query("operation_counts", W_TREE + f", {_ZIP}, {_COUNTS} SELECT * FROM c")
def operation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.operation_counts(compare.positional(*_two(spark, sf_dir), ["graph_id", "parent_id"], ["node_id"], "name"), ["graph_id", "parent_id"])


@query("rebuild_decision", W_TREE + f", {_ZIP}, {_COUNTS} SELECT graph_id, parent_id, round((n_insert + n_delete + n_modify) / (n_insert + n_delete + n_modify + n_keep), 6) AS changed_share, CASE WHEN (n_insert + n_delete + n_modify) / (n_insert + n_delete + n_modify + n_keep) > 0.9 OR (n_insert + n_delete) / (n_insert + n_delete + n_modify + n_keep) > 0.6 THEN 'rebuild' ELSE 'patch' END AS decision FROM c")
def rebuild_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.decision(operation_counts(spark, sf_dir)).select("graph_id", "parent_id", F.round("changed_share", 6).alias("changed_share"), "decision")


_UNITS = f"u AS (SELECT graph_id, name, max(node_id) AS node_id FROM typed WHERE depth = 1 AND node_type = 'Function' GROUP BY ALL), ul AS (SELECT * FROM u WHERE node_id % 4 <> 0), ur AS (SELECT graph_id, name, node_id + CASE WHEN node_id % 3 = 0 THEN 1 ELSE 0 END AS node_id FROM u WHERE node_id % 5 <> 0)"


def _units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    u = graph.top_level_units(tree_nodes(spark, sf_dir))
    return u.filter("node_id % 4 <> 0"), u.filter("node_id % 5 <> 0").withColumn("node_id", F.col("node_id") + F.when(F.col("node_id") % 3 == 0, 1).otherwise(0))


@query("compare_units", W_TYPED + f", {_UNITS} SELECT coalesce(a.graph_id, b.graph_id) AS graph_id, coalesce(a.name, b.name) AS name, a.node_id AS l_value, b.node_id AS r_value, CASE WHEN b.node_id IS NULL THEN 'only_left' WHEN a.node_id IS NULL THEN 'only_right' WHEN a.node_id = b.node_id THEN 'same' ELSE 'changed' END AS status FROM ul a FULL JOIN ur b ON a.graph_id = b.graph_id AND a.name = b.name")
def compare_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.by_name(*_units(spark, sf_dir), ["graph_id", "name"], "node_id")


@query("only_in_one", W_TYPED + f", {_UNITS} SELECT 'left' AS side, graph_id, name FROM (SELECT graph_id, name FROM ul EXCEPT SELECT graph_id, name FROM ur) UNION ALL SELECT 'right', graph_id, name FROM (SELECT graph_id, name FROM ur EXCEPT SELECT graph_id, name FROM ul)")
def only_in_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _units(spark, sf_dir)
    key = ["graph_id", "name"]
    gone, new = left.join(right, key, "left_anti").select(F.lit("left").alias("side"), *key), right.join(left, key, "left_anti").select(F.lit("right").alias("side"), *key)
    return gone.unionByName(new)


@query("functions_to_recompute", W_TYPED + f", {_UNITS} SELECT graph_id, node_id FROM (SELECT graph_id, node_id FROM ul WHERE node_id % 2 = 0 UNION SELECT graph_id, node_id FROM ur WHERE node_id % 7 = 0) t WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.graph_id = t.graph_id AND n.node_id = t.node_id AND n.kind <> 'comment')")
def functions_to_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _units(spark, sf_dir)
    wanted = left.filter("node_id % 2 = 0").select("graph_id", "node_id").union(right.filter("node_id % 7 = 0").select("graph_id", "node_id")).distinct()
    return wanted.join(tree_nodes(spark, sf_dir).filter("kind <> 'comment'"), ["graph_id", "node_id"], "left_semi")


@query("edge_changes", W_EDGES + ", e2 AS (SELECT graph_id, src, CASE WHEN dst % 9 = 0 THEN dst + 1 ELSE dst END AS dst, edge_type FROM edges) SELECT 'deleted' AS change, graph_id, src, dst, edge_type FROM (SELECT * FROM edges EXCEPT SELECT * FROM e2) UNION ALL SELECT 'added', graph_id, src, dst, edge_type FROM (SELECT * FROM e2 EXCEPT SELECT * FROM edges)")
def edge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = graph.syntax_edges(tree_nodes(spark, sf_dir))
    new = old.withColumn("dst", F.when(F.col("dst") % 9 == 0, F.col("dst") + 1).otherwise(F.col("dst")))
    cols = ["graph_id", "src", "dst", "edge_type"]
    side = lambda a, b, name: a.join(b, cols, "left_anti").select(F.lit(name).alias("change"), *cols).distinct()
    return side(old, new, "deleted").unionByName(side(new, old, "added"))


@query("fuzzy_match_best", W_TREE + f", {_LEFT}, {_RIGHT}, s AS (SELECT l.graph_id, l.parent_id, l.node_id AS l_id, r.node_id AS r_id, 50 + CASE WHEN l.name = r.name THEN 40 ELSE 0 END + CASE WHEN abs(l.node_id - r.node_id) <= 1 THEN 10 ELSE 0 END AS score FROM l JOIN r ON l.graph_id = r.graph_id AND l.parent_id = r.parent_id AND l.kind = r.kind), a AS (SELECT * FROM s WHERE score > 50 QUALIFY row_number() OVER (PARTITION BY graph_id, l_id ORDER BY score DESC, r_id) = 1) SELECT graph_id, l_id, r_id, score FROM a QUALIFY row_number() OVER (PARTITION BY graph_id, r_id ORDER BY score DESC, l_id DESC) = 1")
def fuzzy_match_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _two(spark, sf_dir)
    l = left.select("graph_id", "parent_id", "kind", F.col("node_id").alias("l_id"), F.col("name").alias("ln"))  # noqa: E741
    r = right.select("graph_id", "parent_id", "kind", F.col("node_id").alias("r_id"), F.col("name").alias("rn"))
    score = F.lit(50) + F.when(F.col("ln") == F.col("rn"), 40).otherwise(0) + F.when(F.abs(F.col("l_id") - F.col("r_id")) <= 1, 10).otherwise(0)
    scored = l.join(r, ["graph_id", "parent_id", "kind"]).select("graph_id", "l_id", "r_id", score.alias("score"))
    return compare.best_matches(scored, ["graph_id", "l_id"], ["graph_id", "r_id"], "score", 50)


@query("similarity_matrix", W_TREE + ", f AS (SELECT * FROM nodes WHERE depth = 1) SELECT a.graph_id, a.node_id AS l_id, b.node_id AS r_id, round(CASE WHEN a.kind = b.kind THEN 0.7 ELSE 0 END + 0.3 * greatest(least(a.end_id, b.end_id + 2) - greatest(a.node_id, b.node_id - 2), 0) / greatest(a.end_id - a.node_id, b.end_id - b.node_id + 4), 6) AS similarity FROM f a JOIN f b ON a.graph_id = b.graph_id AND b.child_ord BETWEEN a.child_ord AND a.child_ord + 3")
def similarity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tree_nodes(spark, sf_dir).filter("depth = 1")
    a = f.select("graph_id", F.col("node_id").alias("l_id"), F.col("end_id").alias("l_end"), F.col("kind").alias("lk"), F.explode(F.sequence("child_ord", F.col("child_ord") + 3)).alias("child_ord"))
    b = f.select("graph_id", "child_ord", F.col("node_id").alias("r_id"), F.col("end_id").alias("r_end"), F.col("kind").alias("rk"))
    over = compare.span_overlap(F.col("l_id"), F.col("l_end"), F.col("r_id") - 2, F.col("r_end") + 2)
    return a.join(b, ["graph_id", "child_ord"]).select("graph_id", "l_id", "r_id", F.round(compare.similarity(F.col("lk") == F.col("rk"), over), 6).alias("similarity"))


@query("upsert_latest", W_TREE + ", v AS (SELECT graph_id, name, node_id AS version, kind FROM nodes WHERE depth = 1 AND node_id % 2 = 0 UNION ALL SELECT graph_id, name, node_id + 1, kind || '2' FROM nodes WHERE depth = 1) SELECT graph_id, name, version, kind FROM v QUALIFY row_number() OVER (PARTITION BY graph_id, name ORDER BY version DESC, kind DESC) = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tree_nodes(spark, sf_dir).filter("depth = 1").select("graph_id", "name", F.col("node_id").alias("version"), "kind")
    return compare.upsert(f.filter("version % 2 = 0"), f.withColumns({"version": F.col("version") + 1, "kind": F.concat("kind", F.lit("2"))}), ["graph_id", "name"], "version")


@query("node_uid", W_TREE + "SELECT graph_id, node_id, kind || ':' || node_id || ':' || end_id || coalesce(':' || CASE WHEN depth = 2 THEN name END, '') AS uid FROM nodes")
def node_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tree_nodes(spark, sf_dir)
    return n.select("graph_id", "node_id", F.concat_ws(":", "kind", F.col("node_id").cast("string"), F.col("end_id").cast("string"), F.when(F.col("depth") == 2, F.col("name"))).alias("uid"))


@query("change_flags", _W_RANGES + "SELECT n.graph_id, n.node_id, coalesce(bool_or(q.q_start <= n.node_id AND n.end_id <= q.q_end), false) AS is_changed, coalesce(bool_or(n.node_id <= q.q_start AND q.q_end <= n.end_id), false) AS has_changed_child FROM nodes n LEFT JOIN ranges q ON q.graph_id = n.graph_id AND q.query_id < 2 GROUP BY ALL")
def change_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph has a few changed ranges: they are gathered to one array and tested in place."""
    nodes = tree_nodes(spark, sf_dir)
    q = _queries(nodes).filter("query_id < 2").groupBy("graph_id").agg(F.collect_list(F.struct("q_start", "q_end")).alias("qs"))
    any_of = lambda test: F.coalesce(F.exists("qs", test), F.lit(False))
    return nodes.join(q, "graph_id", "left").select(
        "graph_id", "node_id", any_of(lambda q: (q["q_start"] <= F.col("node_id")) & (F.col("end_id") <= q["q_end"])).alias("is_changed"), any_of(lambda q: (F.col("node_id") <= q["q_start"]) & (q["q_end"] <= F.col("end_id"))).alias("has_changed_child")
    )


@query("wl_hash_round", W_EDGES + ", b AS (SELECT graph_id, src, dst FROM edges WHERE edge_type = 'SyntaxChild' UNION ALL SELECT graph_id, dst, src FROM edges WHERE edge_type = 'SyntaxChild'), o AS (SELECT graph_id, node_id, kind AS label FROM nodes), m1 AS (SELECT b.graph_id, b.src AS node_id, string_agg(o.label, ',' ORDER BY o.label) AS near FROM b JOIN o ON o.graph_id = b.graph_id AND o.node_id = b.dst GROUP BY ALL), o1 AS MATERIALIZED (SELECT o.graph_id, o.node_id, sha256(label || '|' || coalesce(near, '')) AS label FROM o LEFT JOIN m1 USING (graph_id, node_id)), m2 AS (SELECT b.graph_id, b.src AS node_id, string_agg(o1.label, ',' ORDER BY o1.label) AS near FROM b JOIN o1 ON o1.graph_id = b.graph_id AND o1.node_id = b.dst GROUP BY ALL) SELECT o1.graph_id, o1.node_id, sha256(label || '|' || coalesce(near, '')) AS label FROM o1 LEFT JOIN m2 USING (graph_id, node_id)")
def wl_hash_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_nodes(spark, sf_dir)
    return compare.wl_hash(nodes.select("graph_id", "node_id", F.col("kind").alias("label")), graph.child_edges(nodes), 2)


@query("bfs_depth_ranks", W_TREE + "SELECT graph_id, node_id, depth, round(percent_rank() OVER (PARTITION BY graph_id, depth ORDER BY node_id), 6) AS x, -depth AS y FROM nodes")
def bfs_depth_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layered layout: the place within a layer, layers from top to bottom."""
    w = Window.partitionBy("graph_id", "depth").orderBy("node_id")
    return tree_nodes(spark, sf_dir).select("graph_id", "node_id", "depth", F.round(F.percent_rank().over(w), 6).alias("x"), (-F.col("depth")).alias("y"))


@query("dot_lines", W_EDGES + "SELECT graph_id, string_agg('n' || src || ' -> n' || dst || ' [label=\"' || edge_type || '\"];', chr(10) ORDER BY src, dst, edge_type) AS body FROM edges WHERE edge_type = 'SyntaxChild' GROUP BY graph_id")
def dot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphtide.sources.sinks import dot_edges

    return dot_edges(graph.child_edges(tree_nodes(spark, sf_dir)))


def _renamed(nodes: DataFrame) -> DataFrame:
    """The second version of the tree: other names for every seventh leaf, other kinds for every ninth."""
    leaf = F.col("depth") == 2
    return nodes.withColumns({"kind": F.when(leaf & (F.col("node_id") % 9 == 0), "identifier").otherwise(F.col("kind")), "name": F.when(leaf & (F.col("node_id") % 7 == 0), F.concat("name", F.lit("y"))).otherwise(F.col("name"))})


@query("compare_graphs", W_TYPED + ", r AS (SELECT graph_id, parent_id, child_ord, kind, CASE WHEN node_id % 9 = 0 THEN 'identifier' ELSE kind END AS kind2 FROM nodes WHERE depth = 2), u AS (SELECT graph_id, name, max(node_id) AS node_id FROM typed WHERE depth = 1 AND node_type = 'Function' GROUP BY ALL) SELECT u.graph_id, u.name, CASE WHEN bool_or(r.kind <> r.kind2) THEN 'changed' ELSE 'same' END AS status, u.node_id AS l_node, u.node_id AS r_node FROM u LEFT JOIN r ON r.graph_id = u.graph_id AND r.parent_id = u.node_id GROUP BY u.graph_id, u.name, u.node_id")
def compare_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_nodes(spark, sf_dir)
    return compare.compare_graphs(nodes, _renamed(nodes))


@query("compare_first_mismatch", W_TYPED + ", u AS (SELECT graph_id, name, max(node_id) AS node_id FROM typed WHERE depth = 1 AND node_type = 'Function' GROUP BY ALL), c AS (SELECT u.graph_id, u.name, n.child_ord, n.node_id, bool_or(n.node_id % 9 = 0 AND n.kind <> 'identifier') OVER (PARTITION BY u.graph_id, u.name) AS changed, (n.node_id % 9 = 0 AND n.kind <> 'identifier') OR n.node_id % 7 = 0 AS differs FROM u JOIN nodes n ON n.graph_id = u.graph_id AND n.parent_id = u.node_id) SELECT graph_id, name, min(child_ord) AS child_ord FROM c WHERE changed AND differs GROUP BY ALL")
def compare_first_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_nodes(spark, sf_dir)
    other = _renamed(nodes)
    return compare.first_mismatch(compare.compare_graphs(nodes, other).filter("status = 'changed'"), nodes, other).select("graph_id", "name", "child_ord")
