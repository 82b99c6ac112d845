"""Where two trees over one axis of positions differ: a sweep over the boundaries of both.

At every position a tree has a signature: the kinds on the path to the deepest node there. A signature holds from one
boundary to the next, so a tree is a list of (position, signature), and two trees are merged by one window of each graph
that carries the last signature of either side forward. Stretches with unequal signatures that follow each other are
united: the result is the fewest, longest ranges in which the trees differ. Positions of the old tree are those of the new
text (spatial.remap gives them where texts differ in length).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bounds(nodes: DataFrame) -> DataFrame:
    """(graph_id, at, rank, sig): both ends of every node that has a position. Of those at one place, the signature of the greatest rank counts."""
    if "above" not in nodes.columns:
        above = nodes.select("graph_id", F.col("node_id").alias("parent_id"), F.col("path").alias("above"))
        nodes = nodes.join(above, ["graph_id", "parent_id"], "left")
    bound = lambda at, begins, sign, sig: F.struct(F.col(at).alias("at"), F.struct(F.lit(begins).alias("begins"), (sign * F.col("depth")).alias("depth"), (sign * F.col("node_id")).alias("node_id")).alias("rank"), sig.alias("sig"))
    both = F.array(bound("start", 1, 1, F.col("path")), bound("end", 0, -1, F.coalesce("above", F.lit(""))))
    # without a name of its own, the column of a stored table would hide from a union that both sides are dealt by it
    return nodes.filter("start < end").select("graph_id", F.explode(both).alias("b")).select(F.col("graph_id").alias("graph_id"), "b.*")


def signatures(nodes: DataFrame) -> DataFrame:
    """(graph_id, at, sig): from position at on. nodes: graph_id, node_id, parent_id, start, end, depth, path; path names the kinds from the root.

    Of the nodes that start at a position the deepest one counts; where none starts, the parent of the outermost that ends.
    Outside of the root the signature is empty. Nodes without a position are left out. A column above, the parent's path, spares a join.
    """
    return _bounds(nodes).groupBy("graph_id", "at").agg(F.max_by("sig", "rank").alias("sig"))


def changed_ranges(old: DataFrame, new: DataFrame) -> DataFrame:
    """(graph_id, start, end) of the maximal ranges whose signatures differ; a graph of one side only differs wherever it has nodes.

    Bounds of both sides are sorted once, by graph and position: of trees that lie in parts by graph, no row moves.
    """
    bounds = _bounds(old).withColumn("is_old", F.lit(True)).unionByName(_bounds(new).withColumn("is_old", F.lit(False)))
    side = lambda which: F.max_by("sig", F.when(which, F.col("rank")))
    events = bounds.groupBy("graph_id", "at").agg(side(F.col("is_old")).alias("a"), side(~F.col("is_old")).alias("b"))
    upto = Window.partitionBy("graph_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    carried = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.lit(""))
    order = Window.partitionBy("graph_id").orderBy("at")
    state = events.select("graph_id", "at", (carried("a") != carried("b")).alias("differs"))
    # only where the trees begin or cease to differ is kept: a range is such a place and the next one
    turns = state.withColumn("before", F.coalesce(F.lag("differs").over(order), F.lit(False))).filter("differs <> before")
    return turns.withColumn("end", F.lead("at").over(order)).filter("differs").select("graph_id", F.col("at").alias("start"), "end")


def met(found: DataFrame, expected: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key, columns, verdict): each range found or expected as hit, missing or unexpected. A null expected value fits anything; repeated rows count once."""
    f, e = found.select(*key, *columns).distinct(), expected.select(*key, *columns).distinct()
    on: Column = F.lit(True)
    for k in key:
        on = on & F.col(f"f.{k}").eqNullSafe(F.col(f"e.{k}"))
    for c in columns:
        on = on & (F.col(f"e.{c}").isNull() | F.col(f"f.{c}").eqNullSafe(F.col(f"e.{c}")))
    both = f.withColumn("is_found", F.lit(True)).alias("f").join(e.withColumn("is_expected", F.lit(True)).alias("e"), on, "full")
    verdict = F.when(F.col("is_found").isNull(), "missing").when(F.col("is_expected").isNull(), "unexpected").otherwise("hit")
    return both.select(*[F.coalesce(f"f.{c}", f"e.{c}").alias(c) for c in (*key, *columns)], verdict.alias("verdict")).distinct()
