"""The graph access API: filters, adjacency, mutation, ordering and checks over nodes and edges.

nodes: graph_id, node_id, end_id, parent_id, child_ord, depth, kind, name, ... ; [node_id, end_id) is the subtree.
edges: graph_id, src, dst, edge_type (and var for data edges). All joins carry graph_id, the partitioning key.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kind of syntax -> node type. Kinds that are not listed are LanguageImplementation.
KIND_MAP = {
    "translation_unit": "TranslationUnit",
    "function_definition": "Function",
    "identifier": "Identifier",
    "field_identifier": "Identifier",
    "field_declarator": "Identifier",
    "declaration": "Statement",
    "expression_statement": "Statement",
    "call_expression": "Call",
    "return_statement": "Return",
    "if_statement": "Branch",
    "while_statement": "Loop",
    "for_statement": "Loop",
    "compound_statement": "Block",
    "break": "CFBreak",
    "continue": "CFContinue",
    "primitive_type": "Type",
    "type_identifier": "Type",
    "subscript_expression": "Expression",
    "parenthesized_expression": "Expression",
    "parameter_list": "Expression",
    "argument_list": "Expression",
    "field_expression": "Expression",
    "assignment_expression": "Expression",
    "binary_expression": "Expression",
    "update_expression": "Expression",
    "init_declarator": "Expression",
    "conditional_expression": "Expression",
    "comment": "Comment",
}
#: Node types that control flow descends into, and the colour of each type in drawings.
DESCEND = ("Statement", "Expression", "Call", "Block", "Branch", "Loop", "Function", "Return")
CONTAINERS = ("Block", "Function", "TranslationUnit")
TYPE_COLOURS = {"TranslationUnit": "grey", "Function": "lightblue", "Branch": "orange", "Loop": "orange", "Return": "red"}
LANGUAGE_ALIASES = {"c": "C", "h": "C", "c++": "C", "cpp": "C", "clang": "C", "py": "Python", "python": "Python"}


@dataclass(frozen=True)
class EdgeQuery:
    """A conjunction of optional predicates on edges; an unset one matches everything."""

    _src: int | None = None
    _dst: int | None = None
    _type: str | None = None

    def src(self, node: int) -> EdgeQuery:
        return replace(self, _src=node)

    def dst(self, node: int) -> EdgeQuery:
        return replace(self, _dst=node)

    def edge_type(self, name: str) -> EdgeQuery:
        return replace(self, _type=name)

    def query(self, edges: DataFrame) -> DataFrame:
        for column, value in (("src", self._src), ("dst", self._dst), ("edge_type", self._type)):
            if value is not None:
                edges = edges.filter(F.col(column) == value)
        return edges


def outgoing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that leave one of the nodes."""
    return edges.join(nodes.select("graph_id", F.col("node_id").alias("src")).distinct(), ["graph_id", "src"], "left_semi")


def incoming(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select("graph_id", F.col("node_id").alias("dst")).distinct(), ["graph_id", "dst"], "left_semi")


def kind_to_type(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in KIND_MAP.items() for x in kv])[kind], F.lit("LanguageImplementation"))


def typed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("node_type", kind_to_type(F.col("kind")))


def should_descend(node_type: Column) -> Column:
    return node_type.isin(*DESCEND)


def label(node_type: Column, name: Column) -> Column:
    return F.concat_ws(" ", node_type, name)


def colour(node_type: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_COLOURS.items() for x in kv])[node_type], F.lit("white"))


def language(alias: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LANGUAGE_ALIASES.items() for x in kv])[F.lower(alias)]


def child_edges(nodes: DataFrame) -> DataFrame:
    return nodes.filter("parent_id IS NOT NULL").select("graph_id", F.col("parent_id").alias("src"), F.col("node_id").alias("dst"), F.lit("SyntaxChild").alias("edge_type"))


def sibling_chain(nodes: DataFrame) -> DataFrame:
    """An edge from each child to its right sibling; running it again on changed nodes re-chains them."""
    nxt = F.lead("node_id").over(Window.partitionBy("graph_id", "parent_id").orderBy("child_ord", "node_id"))
    return nodes.filter("parent_id IS NOT NULL").select("graph_id", F.col("node_id").alias("src"), nxt.alias("dst"), F.lit("SyntaxSibling").alias("edge_type")).filter("dst IS NOT NULL")


def syntax_edges(nodes: DataFrame) -> DataFrame:
    return child_edges(nodes).unionByName(sibling_chain(nodes))


def ordered_children(nodes: DataFrame, processable: bool = False) -> DataFrame:
    """Children with their ordinal; processable: only those control flow descends into, numbered anew."""
    kids = nodes.filter("parent_id IS NOT NULL")
    if processable:
        kids = kids.filter(should_descend(kind_to_type(F.col("kind"))))
    w = Window.partitionBy("graph_id", "parent_id").orderBy("child_ord", "node_id")
    return kids.select("graph_id", "parent_id", "node_id", F.row_number().over(w).alias("ord"))


def top_level_units(nodes: DataFrame) -> DataFrame:
    """Function children of the root by name; of equal names the last one wins."""
    f = typed(nodes).filter("depth = 1 AND node_type = 'Function'")
    named = f.withColumn("name", F.coalesce("name", F.concat(F.lit("anonymous_"), "node_id")))
    return named.groupBy("graph_id", "name").agg(F.max("node_id").alias("node_id"))


def resolve(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Edges with the named columns of both ends, prefixed src_ and dst_."""
    out = edges
    for end in ("src", "dst"):
        side = nodes.select("graph_id", F.col("node_id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])
        out = out.join(side, ["graph_id", end])
    return out


def add_edges(edges: DataFrame, new: DataFrame, drop_loops: bool = False) -> DataFrame:
    """Union without repeated edges; drop_loops leaves out edges from a node to itself."""
    if drop_loops:
        new = new.filter("src <> dst")
    return edges.unionByName(new).dropDuplicates()


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone, [c for c in edges.columns if c in gone.columns], "left_anti")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge enters."""
    return nodes.join(edges.select("graph_id", F.col("dst").alias("node_id")), ["graph_id", "node_id"], "left_anti")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that does not exist."""
    ids = nodes.select("graph_id", "node_id")
    lost = [edges.join(ids.withColumnRenamed("node_id", end), ["graph_id", end], "left_anti").select(*edges.columns) for end in ("src", "dst")]
    return lost[0].unionByName(lost[1]).distinct()


def edge_histogram(edges: DataFrame) -> DataFrame:
    by = ["graph_id", "src", "edge_type"] + (["var"] if "var" in edges.columns else [])
    return edges.groupBy(*by).agg(F.count("*").alias("n"))


def navigate(nodes: DataFrame, path: list[int]) -> DataFrame:
    """(graph_id, node_id): from each root along child ordinals; graphs without such a child give no row."""
    here = nodes.filter("parent_id IS NULL").select("graph_id", "node_id")
    kids = nodes.select("graph_id", F.col("parent_id").alias("node_id"), "child_ord", F.col("node_id").alias("next"))
    for k in path:
        here = here.join(kids.filter(F.col("child_ord") == k), ["graph_id", "node_id"]).select("graph_id", F.col("next").alias("node_id"))
    return here


def canonical_edge_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A total order of each graph's edges by spans, edge type, kinds and target."""
    r = resolve(edges, nodes, "end_id", "kind")
    # a node without a span comes after all others
    last = lambda c: F.coalesce(F.col(c), F.lit((1 << 63) - 1))
    key = ["src", last("src_end_id"), "dst", last("dst_end_id"), "edge_type", "src_kind", "dst_kind"]
    return r.select("graph_id", "src", "dst", "edge_type", F.row_number().over(Window.partitionBy("graph_id").orderBy(*key)).alias("pos"))


def canonical_ids(nodes: DataFrame) -> DataFrame:
    """Ordinals in order of the first visit of a depth-first walk, from 1."""
    return nodes.select("graph_id", "node_id", F.row_number().over(Window.partitionBy("graph_id").orderBy("node_id")).alias("canonical_id"))


def tree_checks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a graph: whether its child edges form a tree: n - 1 edges, one root, no second parent, and no cycle.

    Where every edge goes up in numbers, as in pre-order, there can be no cycle. Graphs with other edges are checked by their components.
    """
    from graphtide.operators.components import connected_components

    kids = edges.filter("edge_type = 'SyntaxChild'")
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("parent_id").isNull()).alias("n_roots"))
    into = kids.groupBy("graph_id", "dst").agg(F.count("*").alias("into"), F.count_if(F.col("src") >= F.col("dst")).alias("back"))
    into = into.groupBy("graph_id").agg(F.sum("into").alias("n_edges"), F.max("into").alias("most"), F.sum("back").alias("back"))
    out = n.join(into, "graph_id", "left").fillna(0, ["n_edges", "most", "back"])
    odd = into.filter("back > 0").select("graph_id")
    if odd.isEmpty():
        out = out.withColumn("parts", F.lit(1))
    else:
        key = lambda c: F.concat_ws("/", "graph_id", c)
        found = connected_components(kids.join(odd, "graph_id", "left_semi").select(key("src").alias("src"), key("dst").alias("dst")))
        # nodes without an edge are parts of their own
        of = nodes.join(odd, "graph_id", "left_semi").select("graph_id", key("node_id").alias("node")).join(found, "node", "left")
        parts = of.groupBy("graph_id").agg(F.countDistinct(F.coalesce("component", "node")).alias("parts"))
        out = out.join(parts, "graph_id", "left").fillna(1, ["parts"])
    ok = (F.col("n_edges") == F.col("n_nodes") - 1) & (F.col("n_roots") == 1) & (F.col("most") <= 1) & (F.col("parts") == 1)
    return out.select("graph_id", "n_nodes", "n_edges", ok.alias("is_tree"))


def same_node(left: str = "l", right: str = "r") -> Column:
    """Equality of two nodes: name, kind and type, not spans or variables; nulls are equal."""
    a, b = (F.col(f"{x}.name") for x in (left, right)), (F.col(f"{x}.kind") for x in (left, right))
    a, b = list(a), list(b)
    return a[0].eqNullSafe(a[1]) & b[0].eqNullSafe(b[1])
