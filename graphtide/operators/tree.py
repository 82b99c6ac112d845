"""Tree operators on nested sets: ancestry is an interval test, so no recursion is needed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphtide.operators.graph import CONTAINERS, kind_to_type, should_descend
from graphtide.runtime import cut


def with_subtree(tops: DataFrame, nodes: DataFrame, how: str = "inner") -> DataFrame:
    """Each top with the nodes of its subtree (itself included). tops: graph_id, top_id, top_end."""
    return tops.join(nodes, (tops["graph_id"] == nodes["graph_id"]) & (nodes["node_id"] >= tops["top_id"]) & (nodes["node_id"] < tops["top_end"]), how).drop(nodes["graph_id"])


def postorder(nodes: DataFrame) -> DataFrame:
    """Position of each node in a post-order walk: subtrees that end earlier come first, deeper ones before shallower."""
    w = Window.partitionBy("graph_id").orderBy("end_id", F.desc("depth"))
    return nodes.select("graph_id", "node_id", F.row_number().over(w).alias("post"))


def nearest_ancestor(nodes: DataFrame, wanted: Column, name: str, fallback: bool = True, max_depth: int = 64) -> DataFrame:
    """(graph_id, node_id, name): the deepest ancestor, itself included, for which wanted(kind) holds.

    The open ancestors at a node in pre-order are, for each depth, the last node seen at that depth: running
    aggregates over one window, no join. Trees of more levels than max_depth are climbed by pointer jumping instead.
    """
    w = Window.partitionBy("graph_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    depths = range(nodes.agg(F.max("depth")).first()[0] or 0, -1, -1)
    if len(depths) > max_depth:
        pick = F.col("found")
        nodes = _climbed(nodes, wanted, len(depths))
    else:
        last = {d: F.last(F.when(F.col("depth") == d, F.struct("node_id", wanted.alias("ok"))), ignorenulls=True).over(w) for d in depths}
        pick = F.coalesce(*[F.when((F.col("depth") >= d) & last[d]["ok"], last[d]["node_id"]) for d in depths])
    return nodes.select("graph_id", "node_id", (F.coalesce(pick, F.col("node_id")) if fallback else pick).alias(name))


def _climbed(nodes: DataFrame, wanted: Column, levels: int) -> DataFrame:
    """(graph_id, node_id, found): every node points to itself if it is wanted, else to its parent; pointers are followed twice as far each round."""
    here = cut(nodes.select("graph_id", "node_id", F.when(wanted, F.col("node_id")).otherwise(F.col("parent_id")).alias("found"), wanted.alias("ok")))
    wanted_ids = here.filter("ok").select("graph_id", F.col("node_id").alias("found"), F.lit(True).alias("good"))
    here, held = here.drop("ok"), []
    for _ in range(max(1, levels.bit_length())):
        hop = here.select("graph_id", F.col("node_id").alias("found"), F.col("found").alias("on"))
        # a pointer past the root is null and stays so
        here = cut(here.join(hop, ["graph_id", "found"], "left").select("graph_id", "node_id", F.col("on").alias("found")), *held)
        held = [here]
    return here.join(wanted_ids, ["graph_id", "found"], "left").select("graph_id", "node_id", F.when(F.col("good"), F.col("found")).alias("found"))


def functions_in_subtree(nodes: DataFrame, wanted: Column) -> DataFrame:
    """(graph_id, node_id, n_functions): wanted nodes of each subtree, where there are some.

    Numbers of a subtree are one interval, so its count is the running count at its end less the one at its start: one window over
    both bounds and the nodes, without a join.
    """
    own = nodes.select("graph_id", "node_id", "end_id", wanted.cast("int").alias("one"))
    bound = lambda at, sign: F.struct(F.col(at).alias("pos"), F.lit(0).alias("is_node"), F.lit(0).alias("one"), F.lit(sign).alias("sign"))
    marks = F.array(F.struct(F.col("node_id").alias("pos"), F.lit(1).alias("is_node"), F.col("one"), F.lit(0).alias("sign")), bound("node_id", -1), bound("end_id", 1))
    points = own.select("graph_id", "node_id", F.explode(marks).alias("m")).select("graph_id", "node_id", "m.*")
    w = Window.partitionBy("graph_id").orderBy("pos", "is_node").rowsBetween(Window.unboundedPreceding, 0)
    counted = points.withColumn("before", F.sum("one").over(w)).filter("sign <> 0")
    return counted.groupBy("graph_id", "node_id").agg(F.sum(F.col("sign") * F.col("before")).alias("n_functions")).filter("n_functions > 0")


def nearest_container(nodes: DataFrame) -> DataFrame:
    return nearest_ancestor(nodes, kind_to_type(F.col("kind")).isin(*CONTAINERS), "container_id")


def containing_function(nodes: DataFrame) -> DataFrame:
    return nearest_ancestor(nodes, kind_to_type(F.col("kind")) == "Function", "function_id", fallback=False)


def first_processable(nodes: DataFrame) -> DataFrame:
    """(graph_id, node_id, first_id): the first node of the subtree in pre-order that control flow descends into.

    In pre-order it is the next such node at or after this one, if it is still inside the subtree.
    """
    w = Window.partitionBy("graph_id").orderBy("node_id").rowsBetween(0, Window.unboundedFollowing)
    nxt = F.min(F.when(should_descend(kind_to_type(F.col("kind"))), F.col("node_id"))).over(w)
    return nodes.select("graph_id", "node_id", F.when(nxt < F.col("end_id"), nxt).alias("first_id"))


def entry_points(nodes: DataFrame, rounds: int = 16) -> DataFrame:
    """(graph_id, node_id, entry_id): follow the first processable child down to its leaf, by pointer jumping."""
    kids = nodes.filter(should_descend(kind_to_type(F.col("kind")))).filter("parent_id IS NOT NULL")
    first = kids.groupBy("graph_id", F.col("parent_id").alias("node_id")).agg(F.min_by("node_id", "child_ord").alias("go"))
    here = nodes.select("graph_id", "node_id").join(first, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("go", "node_id").alias("entry_id"))
    steps = max(1, min(rounds, int(nodes.agg(F.max("depth")).first()[0] or 0).bit_length()))
    for _ in range(steps):
        hop = here.select("graph_id", F.col("node_id").alias("entry_id"), F.col("entry_id").alias("on"))
        here = here.join(hop, ["graph_id", "entry_id"], "left").select("graph_id", "node_id", F.coalesce("on", "entry_id").alias("entry_id"))
    return here


def subtree_depth(nodes: DataFrame) -> DataFrame:
    """Levels of each subtree: the deepest node inside, found bottom-up level by level."""
    top = int(nodes.agg(F.max("depth")).first()[0] or 0)
    deepest = nodes.select("graph_id", "node_id", "parent_id", "depth", F.col("depth").alias("low"))
    done = deepest.filter(F.col("depth") == top)
    parts = [done]
    for d in range(top - 1, -1, -1):
        below = done.groupBy("graph_id", F.col("parent_id").alias("node_id")).agg(F.max("low").alias("sub"))
        done = deepest.filter(F.col("depth") == d).join(below, ["graph_id", "node_id"], "left").select("graph_id", "node_id", "parent_id", "depth", F.coalesce("sub", "low").alias("low"))
        parts.append(done)
    return reduce(DataFrame.unionByName, parts).select("graph_id", "node_id", (F.col("low") - F.col("depth") + 1).alias("levels"))


def remove_subtrees(nodes: DataFrame, edges: DataFrame, tops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the subtrees of tops (graph_id, node_id) and without edges at removed nodes."""
    spans = nodes.join(tops, ["graph_id", "node_id"], "left_semi").select("graph_id", F.col("node_id").alias("a"), F.col("end_id").alias("z"))
    # nested or disjoint intervals: a node is inside one if the furthest end opened before it lies beyond it
    w = Window.partitionBy("graph_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    marked = nodes.join(spans.select("graph_id", F.col("a").alias("node_id"), "z"), ["graph_id", "node_id"], "left")
    kept = marked.withColumn("open", F.max("z").over(w)).filter("open IS NULL OR open <= node_id").drop("z", "open")
    ids = kept.select("graph_id", "node_id")
    left = edges
    for end in ("src", "dst"):
        left = left.join(ids.withColumnRenamed("node_id", end), ["graph_id", end], "left_semi")
    return kept, left


def span_hull(nodes: DataFrame) -> DataFrame:
    """(graph_id, node_id, hull_start, hull_end): the span that covers a node's children."""
    return nodes.filter("parent_id IS NOT NULL").groupBy("graph_id", F.col("parent_id").alias("node_id")).agg(F.min("node_id").alias("hull_start"), F.max("end_id").alias("hull_end"))


def propagate_spans(nodes: DataFrame, start: str, end: str) -> DataFrame:
    """Own spans grown, from the leaves up, until they contain the spans of their children."""
    top = int(nodes.agg(F.max("depth")).first()[0] or 0)
    base = nodes.select("graph_id", "node_id", "parent_id", "depth", F.col(start).alias("s"), F.col(end).alias("e"))
    done = base.filter(F.col("depth") == top)
    parts = [done]
    for d in range(top - 1, -1, -1):
        below = done.groupBy("graph_id", F.col("parent_id").alias("node_id")).agg(F.min("s").alias("cs"), F.max("e").alias("ce"))
        done = base.filter(F.col("depth") == d).join(below, ["graph_id", "node_id"], "left").select("graph_id", "node_id", "parent_id", "depth", F.least("s", "cs").alias("s"), F.greatest("e", "ce").alias("e"))
        parts.append(done)
    return reduce(DataFrame.unionByName, parts).select("graph_id", "node_id", F.col("s").alias(start), F.col("e").alias(end))


def structural_hash(nodes: DataFrame) -> DataFrame:
    """sha256 over kind and, bottom-up, the ordered hashes of the children (a leaf: kind and ordinal)."""
    top = int(nodes.agg(F.max("depth")).first()[0] or 0)
    base = nodes.select("graph_id", "node_id", "parent_id", "child_ord", "depth", "kind")
    leaf = F.sha2(F.concat_ws("-", "kind", F.col("child_ord").cast("string")), 256)
    done = base.filter(F.col("depth") == top).withColumn("hash", leaf)
    parts = [done]
    for d in range(top - 1, -1, -1):
        below = done.groupBy("graph_id", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("child_ord", "hash"))).alias("kids"))
        joined = base.filter(F.col("depth") == d).join(below, ["graph_id", "node_id"], "left")
        inner = F.sha2(F.concat_ws("-", F.col("kind"), F.array_join(F.col("kids.hash"), "-")), 256)
        done = joined.withColumn("hash", F.when(F.col("kids").isNull(), leaf).otherwise(inner)).drop("kids")
        parts.append(done)
    return reduce(DataFrame.unionByName, parts).select("graph_id", "node_id", "hash")


def with_paths(nodes: DataFrame, max_depth: int = 64) -> DataFrame:
    """nodes with path, the kinds from the root to each node joined by "/", and above, the path of its parent (empty at a root).

    As in nearest_ancestor, the open ancestors are the last node seen at each depth: one window and no join. Trees of more levels
    than max_depth are followed level by level.
    """
    top = int(nodes.agg(F.max("depth")).first()[0] or 0)
    if top >= max_depth:
        paths = _paths_by_level(nodes, top)
        above = paths.select("graph_id", F.col("node_id").alias("parent_id"), F.col("path").alias("above"))
        return nodes.join(paths, ["graph_id", "node_id"]).join(above, ["graph_id", "parent_id"], "left").select(*nodes.columns, "path", F.coalesce("above", F.lit("")).alias("above"))
    w = Window.partitionBy("graph_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    open_ = [F.last(F.when(F.col("depth") == d, F.struct("kind")), ignorenulls=True).over(w)["kind"] for d in range(top + 1)]
    upto = lambda low: F.concat_ws("/", *[F.when(F.col("depth") >= d + low, k) for d, k in enumerate(open_)])
    return nodes.select(*nodes.columns, upto(0).alias("path"), upto(1).alias("above"))


def _paths_by_level(nodes: DataFrame, top: int) -> DataFrame:
    base = nodes.select("graph_id", "node_id", "parent_id", "depth", "kind")
    done = base.filter("depth = 0").withColumn("path", F.concat_ws("/", "kind"))
    parts = [done]
    for d in range(1, top + 1):
        up = done.select("graph_id", F.col("node_id").alias("parent_id"), F.col("path").alias("up"))
        done = base.filter(F.col("depth") == d).join(up, ["graph_id", "parent_id"]).select("graph_id", "node_id", "parent_id", "depth", "kind", F.concat_ws("/", "up", "kind").alias("path"))
        parts.append(done)
    return reduce(DataFrame.unionByName, parts).select("graph_id", "node_id", "path")


def paths_to_root(nodes: DataFrame) -> DataFrame:
    """(graph_id, node_id, path): the kinds from the root to each node, joined by "/"."""
    return with_paths(nodes).select("graph_id", "node_id", "path")


def child_paths(nodes: DataFrame, max_depth: int = 64) -> DataFrame:
    """nodes with path: child ordinals of fixed width from the root.

    As in with_paths, one window and no join, so that tables in parts by graph stay where they lie. Trees of more levels than max_depth go by
    pointer jumping: rounds follow the logarithm of the depth.
    """
    ord_ = F.lpad(F.col("child_ord").cast("string"), 7, "0")
    top = int(nodes.agg(F.max("depth")).first()[0] or 0)
    if top < max_depth:
        w = Window.partitionBy("graph_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
        open_ = [F.last(F.when(F.col("depth") == d, F.col("child_ord")), ignorenulls=True).over(w) for d in range(1, top + 1)]
        levels = [F.when(F.col("depth") >= d, F.lpad(o.cast("string"), 7, "0")) for d, o in enumerate(open_, 1)]
        return nodes.withColumn("path", F.concat_ws("/", *levels) if levels else F.lit(""))
    here = nodes.select("graph_id", "node_id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNull(), "").otherwise(ord_).alias("path"))
    for _ in range(top.bit_length()):
        above = here.select("graph_id", F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("path").alias("front"))
        here = here.join(above, ["graph_id", "up"], "left").select("graph_id", "node_id", F.col("next").alias("up"), F.concat_ws("/", F.nullif(F.coalesce("front", F.lit("")), F.lit("")), "path").alias("path"))
    return nodes.join(here.select("graph_id", "node_id", "path"), ["graph_id", "node_id"])
