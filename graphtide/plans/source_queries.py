"""Queries over source code: C files written from the parts table, one file for each brand and group of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.functions import diff as D
from graphtide.operators import control, fixpoint, graph, incremental, splice
from graphtide.operators import frontends as fe
from graphtide.plans.catalog import query
from graphtide.runtime import LONG_ROWS, Shelf, measured, stored, table
from graphtide.sources import sinks

#: Functions of one file: files stay small, so that one is one unit of parsing.
GROUP = 50


def sources(spark: SparkSession, sf_dir: str, changed: bool = False) -> DataFrame:
    """(graph_id, text). changed: every seventh function has another constant, every thirteenth is gone."""
    p = table(measured(spark), sf_dir, "part").select("p_partkey", "p_size")
    k, s = F.col("p_partkey"), F.col("p_size")
    constant = F.when((k % 7 == 0) & F.lit(changed), s + 100).otherwise(s)
    body = F.concat(
        F.when(s % 4 == 0, "// even more\n").otherwise(""), F.format_string("int f%d(int a) {\n  int v = a + %d;\n", k, constant),
        F.when(s % 2 == 0, F.concat(F.lit("  if (v > 10) { v = v - 1; }"), F.when(s % 5 == 0, " else { v = 0; }").otherwise(""), F.lit("\n"))).otherwise(""),
        F.when(s % 3 == 0, "  while (v) { v = g(v); }\n").otherwise(""), F.lit("  return v;\n}\n"),
    )
    if changed:
        p = p.filter("p_partkey % 13 <> 0")
    rows = p.select(F.concat(F.lit("g"), F.floor(k / GROUP).cast("string")).alias("graph_id"), k.alias("k"), body.alias("b"))
    # texts are short and take long to parse: as many tasks as the session has partitions, whatever their bytes
    rows = rows.repartition(parts(spark), "graph_id")
    return rows.groupBy("graph_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", "b")))["b"], "").alias("text"))


def parsed(spark: SparkSession, sf_dir: str, changed: bool = False) -> DataFrame:
    """Nodes of every file, parsed once for a session: for queries that read them more than once. A file lies in one part, as it was dealt to be parsed."""
    return stored(measured(spark), "new nodes" if changed else "old nodes", [f"{sf_dir}/part.parquet"], lambda: fe.build(sources(spark, sf_dir, changed)), "graph_id", parts(spark))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: An assignment that reads its variable has two writers with readers, its expression and its statement; another has one.
_NEW = f"SELECT 'g' || (p_partkey // {GROUP}) AS graph_id, count(*) AS n_functions, count(*) FILTER (p_size % 2 = 0) AS n_branches, count(*) FILTER (p_size % 2 = 0) + count(*) FILTER (p_size % 3 = 0) AS n_true, count(*) FILTER (p_size % 10 = 0) AS n_false, count(*) AS n_exits, count(*) + 2 * count(*) FILTER (p_size % 2 = 0) + count(*) FILTER (p_size % 10 = 0) + 2 * count(*) FILTER (p_size % 3 = 0) AS n_writers FROM part WHERE p_partkey % 13 <> 0 GROUP BY 1"


@query("source_node_counts", f"SELECT 'g' || (p_partkey // {GROUP}) AS graph_id, count(*) AS n_functions, count(*) FILTER (p_size % 2 = 0) AS n_branches, count(*) FILTER (p_size % 3 = 0) AS n_loops, count(*) AS n_returns, count(*) FILTER (p_size % 4 = 0) AS n_comments, count(*) FILTER (p_size % 3 = 0) AS n_calls, CAST(0 AS BIGINT) AS n_errors FROM part GROUP BY 1")
def source_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fe.build(sources(spark, sf_dir))
    of = lambda t: F.count_if(F.col("node_type") == t)
    return n.groupBy("graph_id").agg(of("Function").alias("n_functions"), of("Branch").alias("n_branches"), of("Loop").alias("n_loops"), of("Return").alias("n_returns"), of("Comment").alias("n_comments"), of("Call").alias("n_calls"), of("Error").alias("n_errors"))


@query("source_control_flow", f"SELECT 'g' || (p_partkey // {GROUP}) AS graph_id, count(*) FILTER (p_size % 2 = 0) + count(*) FILTER (p_size % 3 = 0) AS n_true, count(*) FILTER (p_size % 10 = 0) AS n_false, count(*) AS n_exits FROM part GROUP BY 1")
def source_control_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fe.cf_pass(fe.build(sources(spark, sf_dir)))
    t = F.col("edge_type")
    return e.groupBy("graph_id").agg(F.count_if(t == "ControlFlowTrue").alias("n_true"), F.count_if(t == "ControlFlowFalse").alias("n_false"), F.count_if(F.col("dst") < 0).alias("n_exits"))


def old_store(spark: SparkSession, sf_dir: str) -> incremental.Store:
    """What is known of the old version of every file: built once for a session."""
    made: list[incremental.Store] = []

    def known() -> incremental.Store:
        if not made:
            made.append(incremental.build(sources(spark, sf_dir), Shelf(spark).put))
        return made[0]

    inputs = [f"{sf_dir}/part.parquet"]
    own = measured(spark)
    return incremental.Store(stored(own, "old units", inputs, lambda: known().units), stored(own, "old parts", inputs, lambda: known().parts))


def _figures(store: incremental.Store) -> DataFrame:
    """Figures of each file's whole graph: nodes, control flow and data dependence."""
    at = incremental.placed(store)
    of = lambda c, v: F.count_if(F.col(c) == v)
    n = incremental.nodes(store, at).groupBy("graph_id").agg(of("node_type", "Function").alias("n_functions"), of("node_type", "Branch").alias("n_branches"))
    e = incremental.flow(store, at).groupBy("graph_id").agg(of("edge_type", "ControlFlowTrue").alias("n_true"), of("edge_type", "ControlFlowFalse").alias("n_false"), F.count_if(F.col("dst") < 0).alias("n_exits"))
    d = incremental.data(store, at).groupBy("graph_id").agg(F.countDistinct("writer").alias("n_writers"))
    return n.join(e, "graph_id").join(d, "graph_id", "left")


@query("full_recompute", _NEW)
def full_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, control flow and data dependence of the new version of every file, from its text alone."""
    return _figures(incremental.build(sources(spark, sf_dir, True), Shelf(spark).put))


@query("incremental_update", _NEW)
def incremental_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the store of the old version: only changed functions are parsed. Tests compare whole tables."""
    return _figures(incremental.update(old_store(spark, sf_dir), sources(spark, sf_dir, True), Shelf(spark).put))


@query("subtree_splice", f"SELECT 'g' || (p_partkey // {GROUP}) AS graph_id, count(*) AS n_functions, count(*) FILTER (p_size % 2 = 0) AS n_branches, CAST(0 AS BIGINT) AS n_wrong FROM part WHERE p_partkey % 13 <> 0 GROUP BY 1")
def subtree_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old version's tree of every file with the changed subtrees rebuilt in place; n_wrong: rows that differ from the new version's tree."""
    old = stored(measured(spark), "old tree", [f"{sf_dir}/part.parquet"], lambda: splice.rows(parsed(spark, sf_dir)), "graph_id", parts(spark))
    new = parsed(spark, sf_dir, True)
    got = splice.renumbered(splice.spliced(old, splice.splice(old, new)))
    what = F.struct(*[c for c in new.columns if c not in ("graph_id", "node_id")])
    both = got.withColumn("got", what).join(new.select("graph_id", "node_id", what.alias("want")), ["graph_id", "node_id"], "full_outer")
    of = lambda t: F.count_if(F.col("got.node_type") == t)
    return both.groupBy("graph_id").agg(of("Function").alias("n_functions"), of("Branch").alias("n_branches"), F.count_if(~F.col("got").eqNullSafe(F.col("want"))).alias("n_wrong"))


@query("surgical_operations")
def surgical_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a patch of each file's nodes does, by operation and type of node."""
    old, new = parsed(spark, sf_dir), parsed(spark, sf_dir, True)
    return incremental.operations(old, new).groupBy("graph_id", "op", "l_type").agg(F.count("*").alias("n"))


@query("node_repairing")
def node_repairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old nodes of each file paired with the new nodes at the mapped start."""
    old, new = sources(spark, sf_dir), sources(spark, sf_dir, True)
    edits = D.edits(old.withColumnRenamed("text", "old").join(new.withColumnRenamed("text", "new"), "graph_id"), ["graph_id"])
    span = lambda changed: parsed(spark, sf_dir, changed).select("graph_id", "node_id", "start_byte", "end_byte")
    return incremental.repaired(span(False), edits, span(True))


@query("message_control_flow", f"SELECT 'g' || (p_partkey // {GROUP}) AS graph_id, count(*) FILTER (p_size % 2 = 0) + count(*) FILTER (p_size % 3 = 0) AS n_true, count(*) FILTER (p_size % 10 = 0) AS n_false, count(*) AS n_exits FROM part GROUP BY 1")
def message_control_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control flow of every file by message passing over its syntax tree."""
    e = control.flow_by_messages(parsed(spark, sf_dir))
    t = F.col("edge_type")
    return e.groupBy("graph_id").agg(F.count_if(t == "ControlFlowTrue").alias("n_true"), F.count_if(t == "ControlFlowFalse").alias("n_false"), F.count_if(F.col("dst") < 0).alias("n_exits"))


@query("source_change_set", f"SELECT 'g' || (p_partkey // {GROUP}) AS graph_id, 'function_definition#f' || p_partkey || '#1' AS unit, CASE WHEN p_partkey % 13 = 0 THEN 'removed' ELSE 'changed' END AS change FROM part WHERE p_partkey % 13 = 0 OR p_partkey % 7 = 0")
def source_change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incremental update has to look at: functions whose text changed, whatever moved around them. Comments have no name and are numbered; they are left out."""
    both = []
    for changed in (False, True):
        f = sources(spark, sf_dir, changed)
        both.append(fe.units(fe.build(f), f).filter("unit LIKE 'function%'"))
    return control.change_set(*both, ["graph_id", "unit"], "hash")


@query("source_reads_writes", f"SELECT 'g' || (p_partkey // {GROUP}) AS graph_id, count(*) AS n_declared FROM part GROUP BY 1")
def source_reads_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fe.build(sources(spark, sf_dir))
    return n.filter("kind = 'declaration' AND df_writes = array('v') AND df_reads = array('a')").groupBy("graph_id").agg(F.count("*").alias("n_declared"))


@query("source_data_dependence", _NEW.replace(" WHERE p_partkey % 13 <> 0", "").replace("count(*) AS n_functions, count(*) FILTER (p_size % 2 = 0) AS n_branches, count(*) FILTER (p_size % 2 = 0) + count(*) FILTER (p_size % 3 = 0) AS n_true, count(*) FILTER (p_size % 10 = 0) AS n_false, count(*) AS n_exits, ", ""))
def source_data_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writers with a reader, by reaching definitions along the control flow of every file. Tests compare all pairs."""
    return data_dependence(spark, sf_dir).groupBy("graph_id").agg(F.countDistinct("writer").alias("n_writers"))


def data_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = parsed(spark, sf_dir)
    e = fe.cf_pass(n).filter("dst >= 0").select("graph_id", "src", "dst")
    facts = n.select("graph_id", "node_id", F.col("df_reads").alias("reads"), F.col("df_writes").alias("writes"))
    return fixpoint.reaching_definitions(facts, e)


@query("source_function_returns", f"SELECT 'g' || (p_partkey // {GROUP}) AS graph_id, count(*) AS n_returns, count(*) AS n_reads FROM part GROUP BY 1")
def source_function_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return nodes of functions and the variables that return statements bring to them."""
    n = parsed(spark, sf_dir)
    e = fe.return_edges(n, fe.cf_pass(n), data_dependence(spark, sf_dir))
    of = lambda t: F.count_if(F.col("edge_type") == t)
    return e.groupBy("graph_id").agg(of("ControlFlowFunctionReturn").alias("n_returns"), of("PDData").alias("n_reads"))


@query("source_sexp")
def source_sexp(spark: SparkSession, sf_dir: str) -> DataFrame:
    # lines are indented by their depth along siblings, so a file has megabytes: texts go straight to whoever reads them
    parsed(spark, sf_dir)  # nodes are many and short: they are stored with the usual settings
    n = parsed(measured(spark, LONG_ROWS), sf_dir)
    return sinks.sexp(n, graph.syntax_edges(n))


@query("source_dot")
def source_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = parsed(spark, sf_dir)
    return sinks.dot(n, graph.child_edges(n), rank_by_depth=True)


_TEXT = "CASE WHEN p_size % 4 = 0 THEN '// even more' || chr(10) ELSE '' END || 'int f' || p_partkey || '(int a) {' || chr(10) || '  int v = a + ' || CASE WHEN p_partkey % 7 = 0 THEN p_size + 100 ELSE p_size END || ';' || chr(10) || CASE WHEN p_size % 2 = 0 THEN '  if (v > 10) { v = v - 1; }' || CASE WHEN p_size % 5 = 0 THEN ' else { v = 0; }' ELSE '' END || chr(10) ELSE '' END || CASE WHEN p_size % 3 = 0 THEN '  while (v) { v = g(v); }' || chr(10) ELSE '' END || '  return v;' || chr(10) || '}' || chr(10)"


@query("source_edits", f"SELECT 'g' || (p_partkey // {GROUP}) AS graph_id, sha256(string_agg({_TEXT}, '' ORDER BY p_partkey)) AS rebuilt FROM part WHERE p_partkey % 13 <> 0 GROUP BY 1")
def source_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits between the two versions of each file, as byte ranges, applied to the old version."""
    old, new = sources(spark, sf_dir).withColumnRenamed("text", "old"), sources(spark, sf_dir, True).withColumnRenamed("text", "new")
    pairs = old.join(new, "graph_id")
    return D.rebuilt(pairs, D.edits(pairs, ["graph_id"]), ["graph_id"]).select("graph_id", F.sha2("text", 256).alias("rebuilt"))
