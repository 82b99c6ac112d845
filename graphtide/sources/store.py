"""A graph store whose parts lie together: bucketed tables that adjacency joins read without an exchange.

Nodes are bucketed by (graph_id, node_id); edges are kept twice, bucketed by (graph_id, src) and by (graph_id, dst), and
all are sorted within buckets. A step along edges, either way, joins a table of edges with the nodes bucket by bucket; the
result of a step out is dealt like the edges that it came from, and a large graph is spread over all buckets. A lookup of
one node passes by the row groups whose range of graphs and nodes leaves it out. The tables lie in the session's
warehouse, which all executors share.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class GraphStore:
    spark: SparkSession
    name: str
    buckets: int

    @staticmethod
    def write(nodes: DataFrame, edges: DataFrame, name: str | None = None, buckets: int = 64) -> GraphStore:
        """nodes: graph_id, node_id, ...; edges: graph_id, src, dst, ... An existing store of the name is replaced."""
        store = GraphStore(nodes.sparkSession, name or f"graph_{uuid.uuid4().hex}", buckets)
        for table, df, end in (("nodes", nodes, "node_id"), ("out_edges", edges, "src"), ("in_edges", edges, "dst")):
            # rows are dealt as the buckets are, so that each bucket is one file
            dealt = df.repartition(buckets, "graph_id", end)
            dealt.write.bucketBy(buckets, "graph_id", end).sortBy("graph_id", end).mode("overwrite").format("parquet").saveAsTable(f"{store.name}_{table}")
        return store

    def table(self, which: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{which}")

    def nodes(self) -> DataFrame:
        return self.table("nodes")

    def drop(self) -> None:
        for table in ("nodes", "out_edges", "in_edges"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")

    def sources(self, *columns: str) -> DataFrame:
        """Edges with the named columns of the node that they leave, prefixed src_."""
        return self._with("out_edges", "src", columns)

    def targets(self, *columns: str) -> DataFrame:
        """Edges with the named columns of the node that they enter, prefixed dst_."""
        return self._with("in_edges", "dst", columns)

    def _with(self, table: str, end: str, columns: tuple[str, ...]) -> DataFrame:
        n = self.nodes().select("graph_id", F.col("node_id").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in columns))
        # both sides are in buckets: merging them beats sending one of them whole to every task
        return self.table(table).join(n.hint("merge"), ["graph_id", end])

    def degrees(self) -> DataFrame:
        """(graph_id, node_id, n_out, n_in), for nodes without edges too."""
        n = self.nodes().select("graph_id", "node_id")
        for table, end in (("out", "src"), ("in", "dst")):
            counted = self.table(f"{table}_edges").groupBy("graph_id", F.col(end).alias("node_id")).agg(F.count("*").alias(f"n_{table}"))
            n = n.join(counted.hint("merge"), ["graph_id", "node_id"], "left")
        return n.fillna(0, ["n_out", "n_in"])

    def at(self, graph_id: int, node_id: int) -> DataFrame:
        """The edges that leave one node."""
        return self.table("out_edges").filter((F.col("graph_id") == graph_id) & (F.col("src") == node_id))
