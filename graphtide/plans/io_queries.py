"""Queries that write with a sink, read with the source, or run a stream to its end; files lie in the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.functions import diff as D
from graphtide.functions import patchgen
from graphtide.operators import frontends as fe
from graphtide.operators import graph
from graphtide.operators.metrics import numbered
from graphtide.plans.adapters import TREE_SQL, metrics, tree_nodes
from graphtide.plans.adapters import METRICS_SQL
from graphtide.plans.catalog import query
from graphtide.plans.source_queries import GROUP, sources
from graphtide.runtime import Shelf, table
from graphtide.sources import files, sinks
from graphtide.streaming import changes


def _folder(spark: SparkSession) -> str:
    """A folder that goes with the session."""
    shelf = Shelf(spark)
    shelf.put(spark.range(0))
    return shelf.folder


@query("worktree_files", f"SELECT 'g' || (p_partkey // {GROUP}) AS graph_id, count(*) AS n_functions FROM part GROUP BY 1")
def worktree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source file written, found again under the folder, decoded and parsed."""
    folder = f"{_folder(spark)}/tree"
    sources(spark, sf_dir).repartition("graph_id").write.partitionBy("graph_id").text(folder)
    found = files.text(files.worktree(spark, folder, "*.txt")).select(F.regexp_extract("path", r"graph_id=([^/]+)/", 1).alias("graph_id"), "text")
    return fe.build(found).groupBy("graph_id").agg(F.count_if(F.col("node_type") == "Function").alias("n_functions"))


@query("folder_listing", f"SELECT DISTINCT 'graph_id=g' || (p_partkey // {GROUP}) AS name, true AS is_folder FROM part")
def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{_folder(spark)}/tree"
    sources(spark, sf_dir).repartition("graph_id").write.partitionBy("graph_id").text(folder)
    return files.listing(files.worktree(spark, folder, "*.txt"), "/tree")


@query("metrics_files", f"WITH {METRICS_SQL} SELECT edits_count, full_ms AS full_timings_ms, incremental_ms AS incremental_timings_ms, CAST(same AS INT) AS same, file_size AS file_size_bytes, file_path FROM metrics")
def metrics_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows written as CSV with one header a file and read again with the wanted types."""
    folder = f"{_folder(spark)}/metrics"
    m = metrics(spark, sf_dir).select(
        F.col("op").alias("patch_name"), "edits_count", F.col("full_ms").alias("full_timings_ms"), F.col("incremental_ms").alias("incremental_timings_ms"), "same", "lines_changed", F.col("file_size").alias("file_size_bytes"), "file_path"
    )
    sinks.write_metrics_csv(m, folder, ["file_path", "patch_name"])
    return files.metrics_csv(spark, folder).select("edits_count", "full_timings_ms", "incremental_timings_ms", "same", "file_size_bytes", "file_path")


@query("graph_store", f"WITH {TREE_SQL} SELECT graph_id, count(*) AS n_nodes, count(parent_id) AS n_edges FROM nodes GROUP BY 1")
def graph_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges written to the bucketed store and read again."""
    folder, nodes = _folder(spark), tree_nodes(spark, sf_dir)
    sinks.write_store(nodes, graph.child_edges(nodes), folder, buckets=8)
    n, e = (spark.read.parquet(f"{folder}/{t}") for t in ("nodes", "edges"))
    return n.groupBy("graph_id").agg(F.count("*").alias("n_nodes")).join(e.groupBy("graph_id").agg(F.count("*").alias("n_edges")), "graph_id", "left").fillna(0, ["n_edges"])


@query("generated_patches", f"SELECT 'g' || (p_partkey // {GROUP}) AS dir, CAST(i AS INT) AS patch_index FROM (SELECT DISTINCT p_partkey // {GROUP} AS k, k * {GROUP} AS p_partkey FROM part), generate_series(1, 5) t(i)")
def generated_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five patches for every source file, one after the other applied to it."""
    bases = sources(spark, sf_dir).select(F.col("graph_id").alias("dir"), F.col("text").alias("content"))
    made = patchgen.patches(bases, 5)
    return D.fold_patches(bases, made.select("dir", "patch_index", "diff")).select("dir", "patch_index")


@query("python_node_counts", "SELECT p_partkey AS k, 1 AS n_functions, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS n_branches, 1 AS n_returns FROM part")
def python_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second language: one Python function for each part."""
    s = F.col("p_size")
    text = F.concat(F.lit("def f(a):\n"), F.when(s % 2 == 0, "    if a > 1:\n        a = 2\n").otherwise(""), F.lit("    return a\n"))
    n = fe.build(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("graph_id"), text.alias("text")), "Python")
    of = lambda t: F.count_if(F.col("node_type") == t).cast("int")
    return n.groupBy(F.col("graph_id").cast("long").alias("k")).agg(of("Function").alias("n_functions"), of("Branch").alias("n_branches"), of("Return").alias("n_returns"))


@query("commit_stream_run", "SELECT path, step, CASE WHEN p IS NULL THEN 'baseline' WHEN p = h THEN 'unchanged' ELSE 'changed' END AS action FROM (SELECT source AS path, row_number() OVER w AS step, sha256(text) AS h, lag(sha256(text)) OVER w AS p FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))")
def commit_stream_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful commit stream over all versions of every path, run to its end."""
    folder = _folder(spark)
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), "doc_id", F.sha2("text", 256).alias("content_hash"))
    v = numbered(d, ["path"], ["doc_id"], "step").select("path", "step", "content_hash")
    v.write.parquet(f"{folder}/versions")
    stream = spark.readStream.schema(v.schema).parquet(f"{folder}/versions")
    return changes.drained(changes.commit_stream(stream), folder).select("path", "step", "action")


@query("property_log", "SELECT node_id, 'name' AS key, name AS value FROM (SELECT c_custkey AS node_id, c_name AS name FROM customer) UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer")
def property_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change feed streamed through the listeners, of which one writes every change to a log."""
    folder = _folder(spark)
    c = table(spark, sf_dir, "customer")
    c.select(F.col("c_custkey").alias("node_id"), F.explode(F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment")).alias("key", "value")).write.parquet(f"{folder}/feed")
    heard = changes.Listeners()
    heard.on(heard.ALL, "log", lambda batch: changes.change_log(batch, f"{folder}/log"))
    feed = spark.readStream.schema("node_id long, key string, value string").parquet(f"{folder}/feed")
    feed.writeStream.foreachBatch(heard.attach).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/log")
