"""Connected components by alternating large-star and small-star rounds (DataFrame loop, no driver collection)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtide.runtime import cut

MAX_ROUNDS = 60


def parts(edges: DataFrame) -> int:
    return int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _is_settled(edges: DataFrame) -> bool:
    """Whether every edge leads to the centre of a star: no node has two centres, and no centre has one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select("v").distinct().select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 OR (out = 1 AND into = 1)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    # dealt by u once: the distinct edges, their least ends and the join of both stay where they are
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).repartition(parts(edges), "u").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component): every node of an edge with the smallest node of its component.

    Edges are undirected; null ends and self loops are ignored. Each round is cut in the checkpoint folder.
    """
    edges = cut(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v"))
    for _ in range(max_rounds):
        edges = cut(_small_star(_large_star(edges)), edges)
        if _is_settled(edges):
            break
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
