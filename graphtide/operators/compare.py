"""Comparison and alignment of graphs and lists, and set operations on their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_name(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer match: status left, right, same or changed."""
    l, r = left.select(*keys, F.col(value).alias("l_value")), right.select(*keys, F.col(value).alias("r_value"))  # noqa: E741
    status = F.when(F.col("r_value").isNull(), "only_left").when(F.col("l_value").isNull(), "only_right").when(F.col("l_value") == F.col("r_value"), "same").otherwise("changed")
    return l.join(r, keys, "full_outer").withColumn("status", status)


def zip_longest(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """i-th with i-th row of each key, unmatched ones with nulls."""
    w = Window.partitionBy(*keys).orderBy(*order)
    l = left.select(*keys, F.row_number().over(w).alias("pos"), F.col(value).alias("l_value"))  # noqa: E741
    r = right.select(*keys, F.row_number().over(w).alias("pos"), F.col(value).alias("r_value"))
    return l.join(r, [*keys, "pos"], "full_outer")


def positional(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Alignment by position: modify where both sides exist, delete where only the left, insert where only the right does."""
    op = F.when(F.col("r_value").isNull(), "delete").when(F.col("l_value").isNull(), "insert").when(F.col("l_value") == F.col("r_value"), "keep").otherwise("modify")
    return zip_longest(left, right, keys, order, value).withColumn("op", op)


def first_difference(zipped: DataFrame, keys: list[str]) -> DataFrame:
    return zipped.filter(~F.col("l_value").eqNullSafe(F.col("r_value"))).groupBy(*keys).agg(F.min("pos").alias("first_diff"))


def operation_counts(aligned: DataFrame, keys: list[str]) -> DataFrame:
    return aligned.groupBy(*keys).agg(*[F.count_if(F.col("op") == x).alias(f"n_{x}") for x in ("insert", "delete", "modify", "keep")])


def decision(counts: DataFrame) -> DataFrame:
    """Rebuild or patch: rebuild if more than 0.9 of the children change, or 0.6 are inserted or deleted, or where the columns
    type_changed (the node's own type) or unsupported (an operation that a patch cannot do) are given and true."""
    total = F.col("n_insert") + F.col("n_delete") + F.col("n_modify") + F.col("n_keep")
    share = F.try_divide((total - F.col("n_keep")).cast("double"), total.cast("double"))
    structural = F.try_divide((F.col("n_insert") + F.col("n_delete")).cast("double"), total.cast("double"))
    must = F.lit(False)
    for c in ("type_changed", "unsupported"):
        if c in counts.columns:
            must = must | F.coalesce(F.col(c), F.lit(False))
    return counts.withColumn("changed_share", share).withColumn("decision", F.when(must | (share > 0.9) | (structural > 0.6), "rebuild").otherwise("patch"))


def span_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length over the longer length; 0 for empty spans."""
    longer = F.greatest(a1 - a0, b1 - b0)
    return F.when(longer <= 0, F.lit(0.0)).otherwise(F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0)).cast("double") / longer.cast("double"))


def similarity(same_type: Column, overlap: Column) -> Column:
    return F.lit(0.7) * same_type.cast("double") + F.lit(0.3) * overlap


def best_matches(scored: DataFrame, left: list[str], right: list[str], score: str, threshold: float) -> DataFrame:
    """Best candidate of each left row above the threshold, then each right row keeps its best left row."""
    ok = scored.filter(F.col(score) > threshold)
    one = ok.withColumn("__a", F.row_number().over(Window.partitionBy(*left).orderBy(F.desc(score), *right))).filter("__a = 1")
    return one.withColumn("__b", F.row_number().over(Window.partitionBy(*right).orderBy(F.desc(score), *[F.desc(c) for c in left]))).filter("__b = 1").drop("__a", "__b")


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """The latest row of each key."""
    both = old.unionByName(new)
    return both.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(version)))).filter("__r = 1").drop("__r")


def wl_hash(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """Weisfeiler-Lehman labels: each round hashes a node's label with its neighbours' sorted labels. nodes: graph_id, node_id, label."""
    both = edges.select("graph_id", "src", "dst").unionByName(edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    here = nodes.select("graph_id", "node_id", "label")
    for _ in range(rounds):
        near = both.join(here.select("graph_id", F.col("node_id").alias("dst"), "label"), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("node_id")).agg(F.array_sort(F.collect_list("label")).alias("near"))
        here = here.join(near, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.sha2(F.concat_ws("|", "label", F.array_join(F.coalesce("near", F.array().cast("array<string>")), ",")), 256).alias("label"))
    return here


def compare_graphs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(graph_id, name, status, l_node, r_node): functions of two versions of a graph by name and subtree hash.

    Equal subtree hashes end the comparison of a function at its root; nodes of changed functions are compared by first_mismatch.
    """
    from graphtide.operators.graph import typed
    from graphtide.operators.tree import structural_hash

    sides = []
    for nodes, prefix in ((left, "l"), (right, "r")):
        f = typed(nodes).filter("depth = 1 AND node_type = 'Function'").join(structural_hash(nodes), ["graph_id", "node_id"])
        last = F.max(F.struct("node_id", "hash"))
        sides.append(f.groupBy("graph_id", "name").agg(last.alias("x")).select("graph_id", "name", F.col("x.node_id").alias(f"{prefix}_node"), F.col("x.hash").alias(f"{prefix}_hash")))
    both = sides[0].join(sides[1], ["graph_id", "name"], "full_outer")
    status = F.when(F.col("r_node").isNull(), "only_left").when(F.col("l_node").isNull(), "only_right").when(F.col("l_hash") == F.col("r_hash"), "same").otherwise("changed")
    return both.select("graph_id", "name", status.alias("status"), "l_node", "r_node")


def first_mismatch(changed: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(graph_id, name, path, child_ord): the first place, in pre-order of the function's whole subtree, where a node's kind or name differ or one
    is missing. changed: graph_id, name, l_node, r_node (functions at depth 1). path: child ordinals from the function, empty for itself.

    Subtrees meet by path, so both versions of a function may stand at different places; the padded ordinals of a path sort in pre-order.
    """
    from graphtide.operators.tree import child_paths

    sides = []
    for nodes, p in ((left, "l"), (right, "r")):
        at = child_paths(nodes)
        tops = changed.join(at.select("graph_id", F.col("node_id").alias(f"{p}_node"), F.col("path").alias("top")), ["graph_id", f"{p}_node"]).select("graph_id", "name", "top")
        inside = at.filter("path <> ''").select("graph_id", F.substring_index("path", "/", 1).alias("top"), "path", F.struct("kind", F.col("name").alias("node_name")).alias(f"{p}_what"))
        own = inside.join(tops, ["graph_id", "top"]).select("graph_id", "name", F.expr("substring(path, length(top) + 2)").alias("path"), f"{p}_what")
        sides.append(own)
    differs = sides[0].join(sides[1], ["graph_id", "name", "path"], "full_outer").filter(~F.col("l_what").eqNullSafe(F.col("r_what")))
    first = differs.groupBy("graph_id", "name").agg(F.min("path").alias("path"))
    return first.withColumn("child_ord", F.substring_index("path", "/", 1).try_cast("int"))


def aligned_children(left: DataFrame, right: DataFrame, keys: list[str], threshold: float = 0.6) -> DataFrame:
    """(keys, op, l_id, r_id): the longest alignment of each parent's children in which pairs of at least the threshold's similarity match.

    left, right: keys, node_id, end_id, kind, name, in order of node_id. The children of one node are one group.
    """
    from graphtide.functions.diff import align

    cols = ["node_id", "end_id", "kind", "name"]
    both = left.select(*keys, *cols, F.lit(0).alias("side")).unionByName(right.select(*keys, *cols, F.lit(1).alias("side")))
    listed = lambda k: F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct(*cols))))

    def like(a: tuple, b: tuple) -> float:
        longer = max(a[1] - a[0], b[1] - b[0])
        shared = max(0, min(a[1], b[1]) - max(a[0], b[0])) / longer if longer > 0 else 0.0
        return 0.7 * (a[2] == b[2]) + 0.3 * shared

    def run(l: list, r: list) -> list[tuple]:  # noqa: E741
        rows = []
        for op, i, j in align(l, r, like, threshold):
            if op != "insert" and op != "delete":
                op = "keep" if l[i][2:] == r[j][2:] else "modify"
            rows.append((op, None if i is None else l[i][0], None if j is None else r[j][0]))
        return rows

    # families are small and many: they pass through Python by the batch, not one frame each
    ops = F.udf(run, "array<struct<op:string,l_id:bigint,r_id:bigint>>", useArrow=True)
    return both.groupBy(*keys).agg(listed(0).alias("l"), listed(1).alias("r")).select(*keys, F.inline(ops("l", "r")))
