"""Matching of two graphs' nodes and edges by score, as joins and ranks, and the changes that follow.

Candidates of a node have its kind; candidates of an edge share a matched end, so neither is an all-pairs join of a graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spans up to so far apart are near; points of a node's score and of an edge's.
SPAN_NEAR = 25
SIMILAR_TYPES = (("SyntaxChild", "SyntaxSibling"), ("ControlFlowTrue", "ControlFlowFalse", "ControlFlowEpsilon"))
CHANGE_ORDER = ("deleted", "added", "modified", "unchanged")


#: Fixed value: paths of up to so many steps are compared step by step, without an array for each pair.
STEPS = 8


def _common(left: Column, right: Column) -> Column:
    """Length of the common beginning of two arrays."""
    equal = F.zip_with(left, right, lambda x, y: x.eqNullSafe(y))
    return F.coalesce(F.nullif(F.array_position(equal, False), F.lit(0)) - 1, F.size(equal).cast("long"))


def _common_steps(left: Column, right: Column, short: Column, end: bool) -> Column:
    """Length of the common beginning (end: common end) of two arrays, of which the shorter one has short <= STEPS elements."""
    at = lambda path, k: F.get(path, F.size(path) - (k + 1) if end else F.lit(k))
    n = F.lit(0)
    for k in reversed(range(STEPS)):
        n = F.when((short > k) & at(left, k).eqNullSafe(at(right, k)), n + 1).otherwise(0)
    return n.cast("long")


def path_similarity(left: Column, right: Column) -> Column:
    """Twice the length of the common beginning and end of two paths (arrays of kinds from the root) over both lengths; 1 if both are empty."""
    n, short = F.size(left) + F.size(right), F.least(F.size(left), F.size(right))
    few = _common_steps(left, right, short, False) + _common_steps(left, right, short, True)
    many = _common(left, right) + _common(F.reverse(left), F.reverse(right))
    common = F.when(short <= STEPS, few).otherwise(many)
    return F.when(n == 0, F.lit(1.0)).otherwise(2.0 * F.least(common, short.cast("long")) / n)


def node_score(paths: Column, distance: Column, same_share: Column) -> Column:
    """Score of two nodes of one kind: path similarity, distance of the spans (null: unknown), share of equal properties (1: all)."""
    near = (F.lit(SPAN_NEAR) - distance) / SPAN_NEAR * 10.0
    span = F.when(distance.isNull(), 0.0).when(distance <= SPAN_NEAR, near).otherwise(-F.least(F.lit(20.0), distance.cast("double")))
    props = F.when(same_share == 1, 5.0).otherwise(same_share * 5.0 - 2.5)
    return F.greatest(F.lit(0.0), F.lit(100.0) + paths * 30.0 - 15.0 + span + props)


def node_matches(left: DataFrame, right: DataFrame, threshold: float = 50.0) -> DataFrame:
    """(graph_id, l_id, r_id, score): the best right node for each left one, then the best left one for each right one.

    left, right: graph_id, node_id, kind, name, start, end, path (array of kinds).
    """
    l, r = (n.select("graph_id", "kind", *[F.col(c).alias(f"{p}_{c}") for c in ("node_id", "name", "start", "end", "path")]) for n, p in ((left, "l"), (right, "r")))  # noqa: E741
    distance = F.abs(F.col("l_start") - F.col("r_start")) + F.abs(F.col("l_end") - F.col("r_end"))
    # properties: kind, equal here, and name where one of them has it
    share = F.when(F.col("l_name").eqNullSafe(F.col("r_name")), 1.0).otherwise(0.5)
    score = node_score(path_similarity(F.col("l_path"), F.col("r_path")), distance, share)
    scored = lambda left: left.join(r, ["graph_id", "kind"]).withColumn("score", score)
    # pairs are many more than nodes and are never sorted: plain numbers are aggregated by hash, so the best score comes first, then who has it
    best = scored(l).groupBy("graph_id", "l_node_id").agg(F.max("score").alias("best")).filter(F.col("best") > threshold)
    having = scored(l.join(best, ["graph_id", "l_node_id"])).filter("score = best")
    one = having.groupBy("graph_id", F.col("l_node_id").alias("l_id")).agg(F.min("r_node_id").alias("r_id"), F.max("score").alias("score"))
    back = one.groupBy("graph_id", "r_id").agg(F.max(F.struct("score", "l_id")).alias("b"))
    return back.select("graph_id", F.col("b.l_id").alias("l_id"), "r_id", F.col("b.score").alias("score"))


def edge_matches(left: DataFrame, right: DataFrame, nodes: DataFrame, l_sign: DataFrame, r_sign: DataFrame, threshold: float = 30.0) -> DataFrame:
    """(graph_id, l_src, l_dst, l_type, r_src, r_dst, r_type, score): edges matched by falling score, each right edge once; a left edge keeps the
    last right edge that chose it.

    left, right: graph_id, src, dst, edge_type; nodes: graph_id, l_id, r_id, the matched nodes; l_sign, r_sign: graph_id, node_id, sign.
    """
    side = lambda e, p: e.select("graph_id", *[F.col(c).alias(f"{p}_{n}") for c, n in (("src", "src"), ("dst", "dst"), ("edge_type", "type"))])
    l, r = side(left, "l"), side(right, "r")  # noqa: E741
    mapped = l
    for end in ("src", "dst"):
        m = nodes.select("graph_id", F.col("l_id").alias(f"l_{end}"), F.col("r_id").alias(f"to_{end}"))
        mapped = mapped.join(m, ["graph_id", f"l_{end}"], "left")
        s = l_sign.select("graph_id", F.col("node_id").alias(f"l_{end}"), F.col("sign").alias(f"l_{end}_sign"))
        mapped = mapped.join(s, ["graph_id", f"l_{end}"], "left")
        s = r_sign.select("graph_id", F.col("node_id").alias(f"r_{end}"), F.col("sign").alias(f"r_{end}_sign"))
        r = r.join(s, ["graph_id", f"r_{end}"], "left")
    pairs = [mapped.withColumn(f"r_{end}", F.col(f"to_{end}")).filter(f"to_{end} IS NOT NULL").join(r, ["graph_id", f"r_{end}"]) for end in ("src", "dst")]
    # a pair with both ends matched comes from the first join
    both = F.col("to_src").eqNullSafe(F.col("r_src")) & F.col("to_dst").eqNullSafe(F.col("r_dst"))
    pairs = pairs[0].unionByName(pairs[1].filter(~F.col("to_src").eqNullSafe(F.col("r_src"))))
    by_src = F.col("to_src").eqNullSafe(F.col("r_src"))
    same_sign = F.when(by_src, F.col("l_dst_sign") == F.col("r_dst_sign")).otherwise(F.col("l_src_sign") == F.col("r_src_sign"))
    ends = F.when(both, 90.0).when(same_sign.isNull(), 20.0).when(same_sign, 60.0).otherwise(25.0)
    kin = F.lit(False)
    for group in SIMILAR_TYPES:
        kin = kin | (F.col("l_type").isin(*group) & F.col("r_type").isin(*group))
    types = F.when(F.col("l_type") == F.col("r_type"), 10.0).when(kin, 5.0).otherwise(0.0)
    scored = pairs.withColumn("score", F.least(F.lit(100.0), ends + types)).filter(F.col("score") > threshold)
    left_key, right_key = ["l_src", "l_dst", "l_type"], ["r_src", "r_dst", "r_type"]
    chosen = scored.groupBy("graph_id", *right_key).agg(F.max(F.struct("score", *left_key)).alias("b")).select("graph_id", *right_key, "b.*")
    return chosen.groupBy("graph_id", *left_key).agg(F.min(F.struct("score", *right_key)).alias("b")).select("graph_id", *left_key, "b.r_src", "b.r_dst", "b.r_type", "b.score")


def node_changes(left: DataFrame, right: DataFrame, matches: DataFrame) -> DataFrame:
    """(graph_id, start, change, l_id, r_id, pos): deleted, added, modified and unchanged nodes in order of their span, then of the kind of change.

    left, right: graph_id, node_id, start, end, name, kind; matched nodes with other names or spans are modified.
    """
    side = lambda n, p: n.select("graph_id", F.col("node_id").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.struct("name", "start", "end").alias(f"{p}_what"))
    l = side(left, "l").join(matches.select("graph_id", "l_id", "r_id"), ["graph_id", "l_id"], "left")  # noqa: E741
    both = l.join(side(right, "r"), ["graph_id", "r_id"], "full_outer")
    change = F.when(F.col("l_start").isNull(), "added").when(F.col("r_start").isNull(), "deleted").when(F.col("l_what").eqNullSafe(F.col("r_what")), "unchanged").otherwise("modified")
    out = both.select("graph_id", F.coalesce("l_start", "r_start").alias("start"), change.alias("change"), "l_id", "r_id")
    rank = F
    for k, name in enumerate(CHANGE_ORDER):
        rank = rank.when(F.col("change") == name, k)
    w = Window.partitionBy("graph_id").orderBy("start", rank, "l_id", "r_id")
    return out.withColumn("pos", F.row_number().over(w))
