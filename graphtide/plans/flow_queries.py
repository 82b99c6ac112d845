"""Queries over event flows and bipartite graphs: control flow, data dependence, fixpoints, incremental recomputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphtide.operators import control, fixpoint, graph
from graphtide.operators.components import connected_components
from graphtide.plans.adapters import FLOW_SQL, TREE_SQL, flow, tree_nodes, version_hashes
from graphtide.plans.catalog import query
from graphtide.runtime import stored, table

_TYPE = {"error": "Branch", "purchase": "Return", "signup": "Call"}
TYPED_SQL = FLOW_SQL + ", tf AS (SELECT *, CASE kind WHEN 'error' THEN 'Branch' WHEN 'purchase' THEN 'Return' WHEN 'signup' THEN 'Call' ELSE 'Statement' END AS node_type FROM flow)"
W = f"WITH {TYPED_SQL} "


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F
    for k, v in _TYPE.items():
        t = t.when(F.col("kind") == k, v)
    return flow(spark, sf_dir).withColumn("node_type", t.otherwise("Statement"))


@query("cf_chain", W + "SELECT graph_id, node_id AS src, CASE WHEN node_type = 'Return' THEN -1 ELSE nxt END AS dst, 'ControlFlowEpsilon' AS edge_type FROM (SELECT *, lead(node_id) OVER (PARTITION BY graph_id ORDER BY node_id) AS nxt FROM tf) WHERE node_type = 'Return' OR nxt IS NOT NULL")
def cf_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.chain_flow(_typed(spark, sf_dir))


_BRANCH = "bf AS (SELECT graph_id, node_id AS src, n1 AS dst, CASE WHEN node_type = 'Branch' THEN 'ControlFlowTrue' ELSE 'ControlFlowEpsilon' END AS edge_type FROM n WHERE n1 IS NOT NULL UNION ALL SELECT graph_id, node_id, n2, 'ControlFlowFalse' FROM n WHERE node_type = 'Branch' AND n2 IS NOT NULL)"
_NEXT = "n AS (SELECT *, lead(node_id, 1) OVER w AS n1, lead(node_id, 2) OVER w AS n2 FROM tf WINDOW w AS (PARTITION BY graph_id ORDER BY node_id))"


@query("cf_branch", W + f", {_NEXT}, {_BRANCH} SELECT * FROM bf")
def cf_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.branch_flow(_typed(spark, sf_dir))


@query("control_dependence", W + f", {_NEXT} SELECT graph_id, node_id AS src, n1 AS dst, 'PDControlTrue' AS edge_type FROM n WHERE node_type = 'Branch' AND n1 IS NOT NULL")
def control_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.control_dependence(_typed(spark, sf_dir))


@query("clean_analysis_edges", W + f", {_NEXT}, {_BRANCH} SELECT * FROM bf WHERE NOT EXISTS (SELECT 1 FROM tf WHERE tf.graph_id = bf.graph_id AND tf.node_id = bf.src AND tf.node_type = 'Call')")
def clean_analysis_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _typed(spark, sf_dir)
    return control.clean_analysis(control.branch_flow(t), t.filter("node_type = 'Call'"))


# writers: views; readers: everything else
_RW = "rw AS (SELECT *, kind = 'view' AS is_write, kind <> 'view' AS is_read FROM flow)"


@query("reaching_defs", f"WITH {FLOW_SQL}, {_RW} SELECT graph_id, writer, node_id AS reader, var FROM (SELECT *, max(CASE WHEN is_write THEN node_id END) OVER (PARTITION BY graph_id, var ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS writer FROM rw) WHERE is_read AND writer IS NOT NULL")
def reaching_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixpoint.linear_reaching(flow(spark, sf_dir).withColumns({"is_write": F.col("kind") == "view", "is_read": F.col("kind") != "view"}))


@query("reaching_defs_branching", f"WITH RECURSIVE {FLOW_SQL}, {_RW}, n AS (SELECT *, lead(node_id, 1) OVER w AS n1, lead(node_id, 2) OVER w AS n2 FROM rw WINDOW w AS (PARTITION BY graph_id ORDER BY node_id)), step AS MATERIALIZED (SELECT graph_id, node_id AS src, n1 AS dst FROM n WHERE n1 IS NOT NULL UNION SELECT graph_id, node_id, n2 FROM n WHERE kind = 'error' AND n2 IS NOT NULL), fact(graph_id, node_id, var, writer) AS (SELECT rw.graph_id, dst, var, node_id FROM rw JOIN step ON step.graph_id = rw.graph_id AND src = node_id WHERE is_write UNION SELECT f.graph_id, step.dst, f.var, f.writer FROM fact f JOIN step ON step.graph_id = f.graph_id AND step.src = f.node_id JOIN rw ON rw.graph_id = f.graph_id AND rw.node_id = f.node_id WHERE NOT (rw.is_write AND rw.var = f.var)) SELECT DISTINCT f.graph_id, writer, f.node_id AS reader, f.var FROM fact f JOIN rw ON rw.graph_id = f.graph_id AND rw.node_id = f.node_id WHERE rw.is_read AND rw.var = f.var")
def reaching_defs_branching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as one program with branches."""
    t = _typed(spark, sf_dir)
    one = F.array("var")
    none = F.array().cast("array<string>")
    facts = t.select("graph_id", "node_id", F.when(F.col("kind") == "view", one).otherwise(none).alias("writes"), F.when(F.col("kind") != "view", one).otherwise(none).alias("reads"))
    return fixpoint.reaching_definitions(facts, control.branch_flow(t))


def _bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers that met in an order; suppliers have negative ids."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return o.join(li, "o_orderkey").select(F.col("o_custkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst")).distinct()


_BI = "bi AS MATERIALIZED (SELECT DISTINCT o_custkey AS src, -l_suppkey - 1 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_PR = [
    "e AS MATERIALIZED (SELECT src, dst FROM bi UNION SELECT dst, src FROM bi)",
    "ids AS (SELECT src AS id FROM e UNION SELECT dst FROM e)",
    "d AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY 1)",
    "r0 AS MATERIALIZED (SELECT id, CAST(1.0 / (SELECT count(*) FROM ids) AS DOUBLE) AS rank FROM ids)",
    *[
        f"r{k + 1} AS MATERIALIZED (SELECT ids.id, 0.15 / (SELECT count(*) FROM ids) + 0.85 * coalesce(m.s, 0) AS rank FROM ids LEFT JOIN (SELECT e.dst AS id, sum(r{k}.rank / d.degree) AS s FROM e JOIN r{k} ON r{k}.id = e.src JOIN d ON d.id = e.src GROUP BY 1) m ON m.id = ids.id)"
        for k in range(5)
    ],
]


@query("pagerank_k", f"WITH {_BI}, {', '.join(_PR)} SELECT id, round(rank, 9) AS rank FROM r5")
def pagerank_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bipartite(spark, sf_dir)
    both = b.unionByName(b.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return fixpoint.pagerank(both, rounds=5, tolerance=None).select("id", F.round("rank", 9).alias("rank"))


# customers are linked through the parts that they ordered
_LINKS = "links AS MATERIALIZED (SELECT DISTINCT o_custkey AS src, 100000000 + l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.lit(100000000) + F.col("l_partkey")).alias("dst"))
    return o.join(li, "o_orderkey").select(F.col("o_custkey").alias("src"), "dst").distinct()


# labels after so many rounds in SQL: more than the longest shortest path of these graphs, and the last round changes nothing
_LABELS = ", ".join(
    ["e AS MATERIALIZED (SELECT src, dst FROM links UNION SELECT dst, src FROM links)", "c0 AS MATERIALIZED (SELECT DISTINCT src AS id, src AS label FROM e)"]
    + [f"c{k + 1} AS MATERIALIZED (SELECT id, least(any_value(label), min(other)) AS label FROM (SELECT a.id, a.label, b.label AS other FROM c{k} a JOIN e ON e.src = a.id JOIN c{k} b ON b.id = e.dst) GROUP BY id)" for k in range(12)]
)


@query("connected_components", f"WITH {_LINKS}, {_LABELS} SELECT id AS node, label AS component FROM c12")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(_links(spark, sf_dir))


@query("min_label_program", f"WITH {_LINKS}, {_LABELS} SELECT id, label FROM c12")
def min_label_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same components by the vertex-centric engine."""
    return fixpoint.min_labels(_links(spark, sf_dir), max_rounds=None)[0]


@query("active_label_program", f"WITH {_LINKS}, {_LABELS} SELECT id, label FROM c12")
def active_label_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same components, with messages from changed vertices only."""
    return fixpoint.min_labels_active(_links(spark, sf_dir))[0]


@query("bfs_layers", f"WITH RECURSIVE {_LINKS}, e AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links), b(id, level) AS (SELECT s, 0 FROM (SELECT min(dst) AS s FROM links) UNION SELECT e.dst, b.level + 1 FROM b JOIN e ON e.src = b.id WHERE b.level < 12), l AS (SELECT id, min(level) AS level FROM b GROUP BY 1) SELECT l.id, CAST(l.level AS INT) AS level, (SELECT min(p.id) FROM l p JOIN e ON e.src = p.id WHERE e.dst = l.id AND p.level = l.level - 1) AS parent FROM l")
def bfs_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return fixpoint.bfs(both, links.agg(F.min("dst").alias("id")))


@query("reachability_closure", f"WITH RECURSIVE {_LINKS}, e AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links), b(id) AS (SELECT min(dst) FROM links UNION SELECT e.dst FROM b JOIN e ON e.src = b.id) SELECT id FROM b")
def reachability_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bfs_layers(spark, sf_dir).select("id")


@query("message_combiners", f"WITH {_LINKS} SELECT dst AS id, CAST(sum(src) AS BIGINT) AS total, min(src) AS least, CAST(count(DISTINCT src) AS BIGINT) AS n_set FROM links GROUP BY 1")
def message_combiners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).groupBy(F.col("dst").alias("id")).agg(F.sum("src").alias("total"), F.min("src").alias("least"), F.size(F.collect_set("src")).cast("long").alias("n_set"))


@query("message_semi_join", f"WITH {_LINKS} SELECT src, dst FROM links l WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = l.src AND c_mktsegment = 'BUILDING')")
def message_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("src"))
    return _links(spark, sf_dir).join(known, "src", "left_semi")


@query("convergence_state", f"WITH {_BI}, {', '.join(_PR)} SELECT round(max(abs(a.rank - b.rank)), 9) AS largest_change, count(*) FILTER (abs(a.rank - b.rank) > 1e-5) AS n_moving FROM r5 a JOIN r4 b USING (id)")
def convergence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bipartite(spark, sf_dir)
    both = b.unionByName(b.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    x, y = fixpoint.pagerank(both, 5, tolerance=None), fixpoint.pagerank(both, 4, tolerance=None).withColumnRenamed("rank", "before")
    gap = F.abs(F.col("rank") - F.col("before"))
    return x.join(y, "id").agg(F.round(F.max(gap), 9).alias("largest_change"), F.count_if(gap > 1e-5).alias("n_moving"))


# two versions of every function: those with a child divisible by 11 changed one name, those with number divisible by 13 went
_OLD = "ou AS (SELECT graph_id, parent_id AS unit, sha256(string_agg(kind || ':' || name, ',' ORDER BY node_id)) AS h FROM nodes WHERE depth = 2 GROUP BY ALL), nu AS (SELECT graph_id, parent_id AS unit, sha256(string_agg(kind || ':' || CASE WHEN node_id % 11 = 0 THEN name || '_new' ELSE name END, ',' ORDER BY node_id)) AS h FROM nodes WHERE depth = 2 AND parent_id % 13 <> 0 GROUP BY ALL)"


def _unit_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    leaves = tree_nodes(spark, sf_dir).filter("depth = 2").select("graph_id", F.col("parent_id").alias("unit"), "node_id", "kind", "name")
    units = lambda d: d.groupBy("graph_id", "unit").agg(F.array_sort(F.collect_list(F.struct("node_id", "kind", "name"))).alias("parts")).withColumn("h", F.sha2(F.array_join(F.transform("parts", lambda p: F.concat(p["kind"], F.lit(":"), p["name"])), ","), 256))
    new = leaves.filter("unit % 13 <> 0").withColumn("name", F.when(F.col("node_id") % 11 == 0, F.concat("name", F.lit("_new"))).otherwise(F.col("name")))
    return units(leaves), units(new)


@query("change_set", f"WITH {TREE_SQL}, {_OLD} SELECT coalesce(o.graph_id, n.graph_id) AS graph_id, coalesce(o.unit, n.unit) AS unit, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'changed' END AS change FROM ou o FULL JOIN nu n ON o.graph_id = n.graph_id AND o.unit = n.unit WHERE o.h IS DISTINCT FROM n.h")
def change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.change_set(*_unit_versions(spark, sf_dir), ["graph_id", "unit"], "h")


def _unit_rows(u: DataFrame) -> DataFrame:
    return u.select("graph_id", "unit", F.explode("parts").alias("p")).groupBy("graph_id", "unit", F.col("p.kind").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("p.name")).alias("name_chars"))


@query("unit_update", f"WITH {TREE_SQL} SELECT graph_id, parent_id AS unit, kind, count(*) AS n, CAST(sum(length(CASE WHEN node_id % 11 = 0 THEN name || '_new' ELSE name END)) AS BIGINT) AS name_chars FROM nodes WHERE depth = 2 AND parent_id % 13 <> 0 GROUP BY ALL")
def unit_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored result of the old units brought up to date from the changed ones; the SQL computes the new version in full."""
    old, new = _unit_versions(spark, sf_dir)
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("orders", "lineitem")]
    hashes, result = stored(spark, "unit hashes", inputs, lambda: old.select("graph_id", "unit", "h")), stored(spark, "unit rows", inputs, lambda: _unit_rows(old))
    return control.incremental(result, hashes, new, ["graph_id", "unit"], "h", _unit_rows)


@query("write_sets_merge", f"WITH {FLOW_SQL} SELECT graph_id, var, string_agg(DISTINCT kind, ',' ORDER BY kind) AS writers FROM flow GROUP BY ALL")
def write_sets_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow(spark, sf_dir).groupBy("graph_id", "var").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("writers"))


@query("commit_stream_state", "SELECT doc_id, source, CASE WHEN p IS NULL THEN 'baseline' WHEN p = h THEN 'unchanged' ELSE 'changed' END AS action FROM (SELECT doc_id, source, sha256(text) AS h, lag(sha256(text)) OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents)")
def commit_stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the stateful commit stream: per path, what each version does to the state."""
    h, p = F.col("content_hash"), F.col("previous_content_hash")
    return version_hashes(spark, sf_dir).select("doc_id", F.col("path").alias("source"), F.when(p.isNull(), "baseline").when(p == h, "unchanged").otherwise("changed").alias("action"))


@query("call_graph", W + ", c AS (SELECT graph_id, var AS caller, lead(var) OVER (PARTITION BY graph_id ORDER BY node_id) AS callee, node_type FROM tf) SELECT graph_id, caller, callee, count(*) AS n FROM c WHERE node_type = 'Call' AND callee IS NOT NULL GROUP BY ALL")
def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _typed(spark, sf_dir).withColumn("callee", F.lead("var").over(Window.partitionBy("graph_id").orderBy("node_id")))
    return t.filter("node_type = 'Call' AND callee IS NOT NULL").groupBy("graph_id", F.col("var").alias("caller"), "callee").agg(F.count("*").alias("n"))


@query("clone_units", f"WITH {TREE_SQL}, u AS (SELECT graph_id, parent_id AS unit, sha256(string_agg(kind, ',' ORDER BY node_id)) AS h FROM nodes WHERE depth = 2 GROUP BY ALL) SELECT h AS shape, count(*) AS n_units, min(graph_id * 100000 + unit) AS first_unit FROM u GROUP BY 1 HAVING count(*) > 1")
def clone_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of equal shape, as one row for each class: pairs within a class are never formed."""
    leaves = tree_nodes(spark, sf_dir).filter("depth = 2")
    u = leaves.groupBy("graph_id", F.col("parent_id").alias("unit")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("node_id", "kind")))["kind"], ","), 256).alias("h"))
    return u.groupBy(F.col("h").alias("shape")).agg(F.count("*").alias("n_units"), F.min(F.col("graph_id") * 100000 + F.col("unit")).alias("first_unit")).filter("n_units > 1")


@query("sparse_product", "WITH a AS (SELECT o_custkey AS i, o_orderkey AS j, CAST(1 AS BIGINT) AS v FROM orders), b AS (SELECT l_orderkey AS i, l_suppkey AS j, CAST(l_quantity AS BIGINT) AS v FROM lineitem) SELECT a.i, b.j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM a JOIN b ON a.j = b.i GROUP BY ALL")
def sparse_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product of two matrices in coordinate form."""
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("i"), F.col("o_orderkey").alias("k"))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("j"), F.col("l_quantity").cast("long").alias("v"))
    return a.join(b, "k").groupBy("i", "j").agg(F.sum("v").alias("v"))


@query("tree_validation_by_program", f"WITH {TREE_SQL} SELECT graph_id * 100000 AS component, count(*) AS n FROM nodes GROUP BY 1 HAVING count(*) > 1")
def tree_validation_by_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every graph of the tree is one component of its own: components of child edges keyed by graph."""
    nodes = tree_nodes(spark, sf_dir)
    e = graph.child_edges(nodes).select((F.col("graph_id") * 100000 + F.col("src")).alias("src"), (F.col("graph_id") * 100000 + F.col("dst")).alias("dst"))
    return connected_components(e).groupBy("component").agg(F.count("*").alias("n"))


