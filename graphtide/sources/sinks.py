"""Sinks: drawings, S-expressions, metric files and the Parquet store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphtide.functions.text import sexp_escape


def dot_edges(edges: DataFrame) -> DataFrame:
    """(graph_id, body): one DOT line for each edge of a graph, in order."""
    line = F.format_string('n%d -> n%d [label="%s"];', "src", "dst", "edge_type")
    rows = edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "edge_type", line.alias("line")))).alias("l"))
    return rows.select("graph_id", F.array_join(F.col("l.line"), "\n").alias("body"))


def dot(nodes: DataFrame, edges: DataFrame, rank_by_depth: bool = False) -> DataFrame:
    """(graph_id, dot): a whole drawing of each graph, nodes numbered from 0 in pre-order; layers on one rank if wanted."""
    order = Window.partitionBy("graph_id").orderBy("node_id")
    n = nodes.withColumn("cid", F.row_number().over(order) - 1)
    label = F.format_string('  n%d [label="%s"];', F.col("cid"), sexp_escape(F.concat_ws(" ", "kind", "name")))
    body = n.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("cid", label.alias("l")))).alias("ns"))
    ids = n.select("graph_id", "node_id", "cid")
    e = edges.join(ids.withColumnsRenamed({"node_id": "src", "cid": "a"}), ["graph_id", "src"]).join(ids.withColumnsRenamed({"node_id": "dst", "cid": "b"}), ["graph_id", "dst"])
    arrow = F.format_string('  n%d -> n%d [label="%s"];', "a", "b", "edge_type")
    arrows = e.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("a", "b", "edge_type", arrow.alias("l")))).alias("es"))
    out = body.join(arrows, "graph_id", "left")
    parts = [F.lit("digraph G {"), F.array_join(F.col("ns.l"), "\n"), F.array_join(F.col("es.l"), "\n")]
    if rank_by_depth:
        layer = n.groupBy("graph_id", "depth").agg(F.array_sort(F.collect_list("cid")).alias("ids"))
        line = F.concat(F.lit("  { rank=same; "), F.array_join(F.transform("ids", lambda i: F.concat(F.lit("n"), i.cast("string"))), "; "), F.lit("; }"))
        layers = layer.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("depth", line.alias("l")))).alias("rs"))
        out = out.join(layers, "graph_id", "left")
        parts.append(F.array_join(F.col("rs.l"), "\n"))
    return out.select("graph_id", F.concat_ws("\n", *parts, F.lit("}")).alias("dot"))


def _sexp_of(items: list[tuple], links: list[tuple]) -> str:
    """One graph: nodes numbered from 1 at their first visit, edges in order, a node seen before as a marker. items: node_id, kind, name, start, end;
    links, in order: src, edge_type, dst."""
    nodes = {r[0]: r for r in items}
    out: dict[int, list] = {}
    for src, kind, dst in links:
        out.setdefault(src, []).append((kind, dst))
    seen: dict[int, int] = {}
    lines: list[str] = []
    esc = lambda s: str(s).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    # an explicit stack: trees may be deeper than the call stack
    stack: list[tuple[str, int, int]] = [("node", min(nodes), 0)] if nodes else []
    while stack:
        what, node, depth = stack.pop()
        pad = "  " * depth
        if what == "close":
            lines.append(pad + ")")
            continue
        if what != "node":
            lines.append(f"{pad}(-> {what}")
            stack.append(("close", node, depth))
            stack.append(("node", node, depth + 1))
            continue
        _, what, name, start, end = nodes[node]
        if node in seen:
            lines.append(f'{pad}{what} [visited "{seen[node]}"]')
            continue
        seen[node] = len(seen) + 1
        named = "" if name is None else f' :name "{esc(name)}"'
        lines.append(f'{pad}({what} :canonical-id "{seen[node]}" :span "({start}, {end})"{named}')
        stack.append(("close", node, depth))
        for kind, to in reversed(out.get(node, [])):
            if to in nodes:
                stack.append((kind, to, depth + 1))
    return "\n".join(lines)


def sexp(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, sexp): the walk over all edges from the first node of each graph."""
    n = nodes.select("graph_id", F.struct("node_id", "kind", "name", F.col("node_id").alias("start"), F.col("end_id").alias("end")).alias("item"))
    e = edges.select("graph_id", F.struct("src", "edge_type", "dst").alias("link"))
    both = n.unionByName(e, allowMissingColumns=True).groupBy("graph_id").agg(F.collect_list("item").alias("items"), F.array_sort(F.collect_list("link")).alias("links"))
    # graphs are small and many: they pass through Python by the batch, not one frame each
    return both.select("graph_id", F.udf(_sexp_of, "string", useArrow=True)("items", "links").alias("sexp"))


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_metrics_csv(metrics: DataFrame, path: str, order: list[str | Column]) -> None:
    """One header, rows in order within files."""
    metrics.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").csv(path, header=True)


def write_store(nodes: DataFrame, edges: DataFrame, path: str, buckets: int = 64) -> None:
    """The graph store: Parquet partitioned by a bucket of graph_id, so that one graph is one directory to read."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        bucket = F.pmod(F.xxhash64("graph_id"), F.lit(buckets)).cast("int")
        df.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")


def to_latex(table: list[tuple], header: list[str]) -> str:
    """A small summary table as LaTeX (the rows are a report, not data)."""
    cell = lambda v: f"{v:.3f}" if isinstance(v, float) else str(v).replace("_", r"\_")
    body = " \\\\\n".join(" & ".join(map(cell, r)) for r in table)
    return "\\begin{tabular}{" + "l" * len(header) + "}\n" + " & ".join(map(cell, header)) + " \\\\\\hline\n" + body + "\n\\end{tabular}"


def tikz(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, tex): a LaTeX picture of each graph, layers from top to bottom, names with escaped underscores."""
    safe = lambda c: F.replace(c, F.lit("_"), F.lit("\\_"))
    place = Window.partitionBy("graph_id", "depth").orderBy("node_id")
    n = nodes.withColumn("line", F.format_string("  \\node (n%d) at (%d,%d) {%s};", F.col("node_id"), F.row_number().over(place), -F.col("depth"), safe(F.concat_ws(" ", "kind", "name"))))
    e = edges.withColumn("line", F.format_string("  \\draw[->] (n%d) -- (n%d);", "src", "dst"))
    listed = lambda d, *key: d.groupBy("graph_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct(*key, "line")))["line"], "\n").alias("body"))
    both = listed(n, "node_id").join(listed(e, "src", "dst").withColumnRenamed("body", "arrows"), "graph_id", "left")
    return both.select("graph_id", F.concat_ws("\n", F.lit("\\begin{tikzpicture}"), "body", "arrows", F.lit("\\end{tikzpicture}")).alias("tex"))


#: Serialisers by name: nodes and edges to one text for each graph, in the column of that name (tikz: tex).
SERIALIZERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"dot": dot, "sexp": sexp, "tikz": tikz}


def serialize(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(graph_id, text) by one of the SERIALIZERS."""
    if kind not in SERIALIZERS:
        raise ValueError(f"unknown serialiser {kind}; there are {', '.join(sorted(SERIALIZERS))}")
    out = SERIALIZERS[kind](nodes, edges)
    return out.select("graph_id", F.col(out.columns[1]).alias("text"))
