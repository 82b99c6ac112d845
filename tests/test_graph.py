import random
import re

import pytest
from pyspark.sql import functions as F

from graphtide.operators import compare, control, fixpoint, graph, spatial, tree
from graphtide.operators import frontends as fe
from graphtide.operators.components import connected_components
from graphtide.operators.graph import EdgeQuery
from graphtide.plans import adapters, flow_queries, source_queries
from graphtide.sources import sinks


def _tree(rng, n):
    parent = [None] + [rng.randrange(i) for i in range(1, n)]
    kids = {i: [k for k in range(n) if parent[k] == i] for i in range(n)}
    rows, order = [], []

    def walk(i, depth, up, nth):
        me = len(order)
        order.append(i)
        row = [7, me, None, up, nth, depth, rng.choice(list(graph.KIND_MAP)), f"n{i}"]
        rows.append(row)
        for k, c in enumerate(kids[i]):
            walk(c, depth + 1, me, k + 1)
        row[2] = len(order)

    walk(0, 0, None, 1)
    return rows


SCHEMA = "graph_id long, node_id long, end_id long, parent_id long, child_ord int, depth int, kind string, name string"


def test_random_trees_against_recursion(spark):
    rng = random.Random(5)
    for n in (1, 2, 17, 40):
        rows = _tree(rng, n)
        nodes = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
        kids = {r[1]: sorted((x for x in rows if x[3] == r[1]), key=lambda x: x[4]) for r in rows}
        post = []

        def walk(r):
            for c in kids[r[1]]:
                walk(c)
            post.append(r[1])

        walk(rows[0])
        assert [r["node_id"] for r in tree.postorder(nodes).orderBy("post").collect()] == post
        levels = {}

        def height(r):
            levels[r[1]] = 1 + max([height(c) for c in kids[r[1]]], default=0)
            return levels[r[1]]

        height(rows[0])
        assert {r["node_id"]: r["levels"] for r in tree.subtree_depth(nodes).collect()} == levels
        up = {r[1]: r for r in rows}

        def nearest(r, good):
            while r is not None and not good(graph.KIND_MAP[r[6]]):
                r = up.get(r[3])
            return r[1] if r else None

        want = {r[1]: nearest(r, lambda t: t in graph.CONTAINERS) for r in rows}
        assert {r["node_id"]: r["container_id"] for r in tree.nearest_container(nodes).collect()} == {k: k if v is None else v for k, v in want.items()}
        assert graph.tree_checks(nodes, graph.child_edges(nodes)).first()["is_tree"]
        gone = spark.createDataFrame([(7, n // 2)], "graph_id long, node_id long")
        left_nodes, left_edges = tree.remove_subtrees(nodes, graph.syntax_edges(nodes), gone)
        assert graph.dangling(left_edges, left_nodes).count() == 0
        top = rows[n // 2]
        assert {r["node_id"] for r in left_nodes.collect()} == {r[1] for r in rows if not top[1] <= r[1] < top[2]}


def test_edge_query_is_a_conjunction(spark):
    e = spark.createDataFrame([(1, 1, 2, "A"), (1, 1, 3, "B"), (1, 2, 3, "A")], "graph_id long, src long, dst long, edge_type string")
    assert EdgeQuery().query(e).count() == 3
    assert EdgeQuery().src(1).edge_type("A").query(e).collect()[0]["dst"] == 2
    assert EdgeQuery().dst(3).query(e).count() == 2
    assert graph.add_edges(e, e.limit(1)).count() == 3


def test_binned_joins_equal_plain_joins(spark):
    rng = random.Random(3)
    spans = [(g, k, a, a + rng.randint(0, 300), rng.choice(["Block", "Function", "Statement"])) for g in (1, 2) for k in range(40) for a in [rng.randint(0, 900)]]
    queries = [(g, k, a, a + rng.randint(-80, 200)) for g in (1, 2) for k in range(25) for a in [rng.randint(0, 1000)]]
    s = spark.createDataFrame(spans, "graph_id int, node_id int, start int, end int, node_type string")
    q = spark.createDataFrame(queries, "graph_id int, query_id int, q_start int, q_end int")
    for f, test in ((spatial.overlap, lambda a, z, s, e: a <= e and s < z), (spatial.within, lambda a, z, s, e: a < e and s < z)):
        got = sorted((r["graph_id"], r["query_id"], r["node_id"]) for r in f(s, q).collect())
        assert got == sorted((g, k, n) for g, k, x, y in queries for g2, n, a, b, _ in spans if g == g2 and test(min(x, y), max(x, y), a, b))
    points = q.select("graph_id", "query_id", F.col("q_start").alias("point"))
    got = sorted((r["graph_id"], r["query_id"], r["node_id"]) for r in spatial.stab(s, points).collect())
    assert got == sorted((g, k, n) for g, k, x, _ in queries for g2, n, a, b, _ in spans if g == g2 and a <= x < b)
    forward = [x for x in queries if x[2] <= x[3]]
    got = {(r["graph_id"], r["query_id"]): r["node_id"] for r in spatial.smallest_containing(s, spark.createDataFrame(forward, q.schema)).collect()}
    for g, k, x, y in forward:
        fits = [(b - a, spatial.PRIORITY.get(t, 4), a, n) for g2, n, a, b, t in spans if g == g2 and a <= x and y <= b]
        assert got.get((g, k)) == (min(fits)[3] if fits else None)


def test_nested_spans_example(spark):
    s = spark.createDataFrame([(1, 1, 0, 100, "Function"), (1, 2, 10, 50, "Block"), (1, 3, 20, 30, "Identifier")], "graph_id int, node_id int, start int, end int, node_type string")
    q = spark.createDataFrame([(1, 1, 25, 26), (1, 2, 15, 45), (1, 3, 5, 95), (1, 4, 200, 300)], "graph_id int, query_id int, q_start int, q_end int")
    assert {r["query_id"]: r["node_id"] for r in spatial.smallest_containing(s, q).collect()} == {1: 3, 2: 2, 3: 1}


def test_remap_and_merge(spark):
    pts = spark.createDataFrame([("a", 0), ("a", 5), ("a", 12), ("b", 3)], "path string, pos long")
    edits = spark.createDataFrame([("a", 4, 8, 4, 6), ("a", 10, 10, 8, 11)], "path string, old_start long, old_end long, new_start long, new_end long")
    assert sorted(tuple(r) for r in spatial.remap(pts, edits).collect()) == [("a", 0, 0), ("a", 5, 4), ("a", 12, 13), ("b", 3, 3)]
    s = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10), (1, 1, 2)], "k int, start int, end int")
    assert sorted((r["start"], r["end"], r["n"]) for r in spatial.merge(s, ["k"]).collect()) == [(0, 7, 3), (9, 10, 1)]


def test_components_and_programs(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (4, 5), (6, 7), (7, 8), (9, 9), (None, 1)], "src long, dst long")
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6}
    assert {r["node"]: r["component"] for r in connected_components(e).collect()} == want
    labels, settled = fixpoint.min_labels(e.filter("src <> dst"))
    assert settled and {r["id"]: r["label"] for r in labels.collect()} == want
    assert connected_components(e.limit(0)).count() == 0
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    assert {r["component"] for r in connected_components(path).collect()} == {0}
    reach, _ = fixpoint.successor_sets(spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "src long, dst long"))
    assert {r["id"]: r["seen"] for r in reach.collect()} == {1: [1], 2: [1, 2, 3], 3: [1, 2, 3]}


def test_pagerank(spark):
    edges = [(1, 2), (1, 3), (2, 3), (2, 4), (3, 1), (3, 5), (4, 5), (5, 1)]
    rank = {i: 0.2 for i in range(1, 6)}
    for _ in range(50):
        new = {i: 0.03 for i in rank}
        for a, b in edges:
            new[b] += 0.85 * rank[a] / sum(x == a for x, _ in edges)
        rank = new
    got = {r["id"]: r["rank"] for r in fixpoint.pagerank(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(abs(got[i] - rank[i]) < 1e-4 for i in rank)


def test_bfs(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)], "src long, dst long")
    got = {r["id"]: (r["level"], r["parent"]) for r in fixpoint.bfs(e, spark.createDataFrame([(1,)], "id long")).collect()}
    assert got == {1: (0, None), 2: (1, 1), 3: (1, 1), 4: (2, 2)}


C = """// add
int add(int a, int b) {
    int c = a + b;
    if (c > 10) { c = c - 1; } else { c = 1; }
    while (c) { c -= 2; }
    return c;
}
int x = 5;
"""


def _nodes(spark, text, language="C"):
    return fe.build(spark.createDataFrame([("f", text)], "graph_id string, text string"), language)


def _edges(text, language="C"):
    names = [x.strip().split(" ")[0] for x in fe.NODE_SCHEMA.split(", ")]
    rows = [dict(zip(names, r, strict=True)) for r in fe.rows_of("f", text, language)]
    return rows, fe.control_flow(rows)


def test_front_end_shapes(spark):
    n = _nodes(spark, C)
    assert graph.tree_checks(n, graph.child_edges(n)).first()["is_tree"]
    kinds = {r["kind"] for r in n.collect()}
    assert {"translation_unit", "function_definition", "if_statement", "while_statement", "return_statement", "comment", "declaration"} <= kinds
    assert n.filter("kind = 'function_definition'").first()["name"] == "add"
    d = n.filter("kind = 'declaration' AND depth = 3").first()
    assert d["df_writes"] == ["c"] and d["df_reads"] == ["a", "b"]
    for r in n.collect():
        assert 0 <= r["start_byte"] <= r["end_byte"] <= len(C)


@pytest.mark.parametrize("text", ["", "int", "int x = ;", "}{)(", "int f( { return", 'x = "abc', "if (", "for (;;) { }", "é = 1;", "/* open", "int a[3] = f(1, 2);"])
def test_broken_input_gives_nodes(text):
    rows = fe.rows_of("f", text, "C")
    assert rows[0][6] == "translation_unit" and all(r[3] is None or r[3] < r[1] < rows[r[3]][2] for r in rows)


def test_control_flow_of_branch_and_loop():
    rows, edges = _edges(C)
    by = {r["node_id"]: r for r in rows}
    kind = lambda i: by[i]["kind"] if i >= 0 else "exit"
    has = {(kind(a), kind(b), t) for a, b, t in edges}
    assert ("if_statement", "parenthesized_expression", "ControlFlowEpsilon") in has
    assert ("parenthesized_expression", "compound_statement", "ControlFlowTrue") in has
    assert ("parenthesized_expression", "else_clause", "ControlFlowFalse") in has
    assert ("return_statement", "exit", "ControlFlowEpsilon") in has
    assert not [e for e in edges if kind(e[0]) == "return_statement" and e[1] >= 0]
    ends = {b for _, b, _ in edges if b < 0}
    assert ends == {fe.EXIT - next(r["node_id"] for r in rows if r["node_type"] == "Function")}


def test_cf_pass_and_errors(spark):
    n = _nodes(spark, C)
    assert fe.cf_pass(n).filter("error IS NOT NULL").count() == 0
    bad = n.filter("NOT (role = 'condition')")
    assert "lacks" in fe.cf_pass(bad).first()["error"]


def test_python_front_end():
    rows, edges = _edges("def f(n):\n    if n < 1:\n        return 1\n    while n:\n        n -= 1\n    return n\n", "Python")
    assert [r["name"] for r in rows if r["node_type"] == "Function"] == ["f"]
    assert {t for _, _, t in edges} == {"ControlFlowEpsilon", "ControlFlowTrue"}
    assert fe.rows_of("g", "def (", "Python")[1][6] == "ERROR"


def test_reaching_definitions_on_source(spark):
    flow = spark.createDataFrame([(1, 1, [], ["x"]), (1, 2, ["x"], []), (1, 3, [], ["x"]), (1, 4, ["x"], ["y"]), (1, 5, ["x", "y"], [])], "graph_id int, node_id int, reads array<string>, writes array<string>")
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 2, 4), (1, 3, 4), (1, 4, 5)], "graph_id int, src int, dst int")
    got = {(r["writer"], r["reader"], r["var"]) for r in fixpoint.reaching_definitions(flow, edges).collect()}
    assert got == {(1, 2, "x"), (1, 4, "x"), (3, 4, "x"), (1, 5, "x"), (3, 5, "x"), (4, 5, "y")}


def test_incremental_equals_full(spark):
    rng = random.Random(11)
    names = ["alpha", "beta", "gamma", "delta"]

    def program():
        return [f"int {n}(int a) {{ int v = a + {rng.randint(0, 9)}; return v; }}" for n in names]

    old = {f"f{i}": program() for i in range(6)}
    new = {}
    for g, parts in old.items():
        parts = list(parts)
        op = rng.choice(["same", "value", "insert", "delete", "space"])
        if op == "value":
            parts[rng.randrange(4)] = parts[0].replace("alpha", rng.choice(names)).replace("+", "-")
        elif op == "insert":
            parts.insert(1, "int zeta(int q) { return q; }")
        elif op == "delete":
            parts.pop()
        elif op == "space":
            parts = ["\n  " + p for p in parts]
        new[g] = parts

    def frame(files):
        return spark.createDataFrame([(g, "\n".join(p)) for g, p in files.items()], "graph_id string, text string")

    def units(files):
        f = frame(files)
        n = fe.build(f)
        return fe.units(n, f).join(f, "graph_id").select("graph_id", "unit", "hash", F.lit(1).alias("one"))

    compute = lambda u: u.select("graph_id", "unit", F.concat("unit", F.lit("!"), "hash").alias("result"))
    a, b = units(old), units(new)
    got = control.incremental(compute(a), a, b, ["graph_id", "unit"], "hash", compute)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, compute(b).collect()))


def test_wl_hash_sees_structure(spark):
    n = spark.createDataFrame([(1, k, "x") for k in range(4)] + [(2, k, "x") for k in range(4)], "graph_id int, node_id int, label string")
    path, star = [(1, 0, 1), (1, 1, 2), (1, 2, 3)], [(2, 0, 1), (2, 0, 2), (2, 0, 3)]
    h = compare.wl_hash(n, spark.createDataFrame(path + star, "graph_id int, src int, dst int"), 2)
    by = {g: sorted(r["label"] for r in h.filter(f"graph_id = {g}").collect()) for g in (1, 2)}
    assert by[1] != by[2]


def test_sinks(spark, tmp_path):
    n = _nodes(spark, C)
    e = graph.child_edges(n)
    flat = n.select("graph_id", "node_id", "end_id", "kind", "name", "depth")
    text = sinks.dot(flat, e, rank_by_depth=True).first()["dot"]
    assert text.startswith("digraph G {") and text.count("->") == e.count() and "rank=same" in text
    s = sinks.sexp(flat, e.unionByName(spark.createDataFrame([("f", 1, 0, "Back")], e.schema))).first()["sexp"]
    bare = re.sub(r'"(?:[^"\\]|\\.)*"', "", s)
    assert bare.count("(") == bare.count(")") > 0
    assert '[visited "1"]' in s and ':canonical-id "1"' in s
    sinks.write_store(n, e, str(tmp_path / "store"), buckets=4)
    assert spark.read.parquet(str(tmp_path / "store/nodes")).count() == n.count()
    sinks.write_text(sinks.dot(flat, e), "dot", str(tmp_path / "dot"))
    assert spark.read.text(str(tmp_path / "dot")).count() > 3
    assert r"\_" in sinks.to_latex([("a_b", 1.0)], ["n", "v"])


def _order_tables(spark, folder):
    """Orders of customers inside and outside the ids that queries once kept."""
    priorities = ["1-URGENT", "2-HIGH", "5-LOW"]
    orders = [(o, c, priorities[o % 3], 10.0 * o) for o, c in enumerate([5, 5, 10, 10, 10, 250, 250, 1203, 5])]
    lines = [(o[0], n, o[0] * 7 + n, n, float(n), 1.0, 0.0, 0.0, "ANR"[n % 3], "FO"[n % 2], "1995-01-01") for o in orders for n in range(1, 3 + o[0] % 4)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double").write.parquet(f"{folder}/orders.parquet")
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string"
    spark.createDataFrame(lines, schema).write.parquet(f"{folder}/lineitem.parquet")


def test_tree_validation_covers_every_graph(spark, tmp_path):
    _order_tables(spark, tmp_path)
    size = {}
    for r in adapters.tree_nodes(spark, str(tmp_path)).collect():
        size[r["graph_id"]] = size.get(r["graph_id"], 0) + 1
    got = {r["component"]: r["n"] for r in flow_queries.tree_validation_by_program(spark, str(tmp_path)).collect()}
    assert set(size) == {5, 10, 250, 1203} and got == {g * 100000: n for g, n in size.items()}


def _reaching(nodes, edges):
    """Every definition is followed along the edges until the variable is written again."""
    out = set()
    for (g, i), (_, writes) in nodes.items():
        for var in writes:
            seen, todo = set(), list(edges.get((g, i), ()))
            while todo:
                j = todo.pop()
                if j in seen or (g, j) not in nodes:
                    continue
                seen.add(j)
                if var in nodes[g, j][0]:
                    out.add((g, i, j, var))
                if var not in nodes[g, j][1]:
                    todo += edges.get((g, j), ())
    return out


def test_source_data_dependence_covers_every_file(spark, tmp_path):
    parts = [(k, s) for k, s in zip([1, 2, 51, 101, 151, 152, 261, 999], [30, 7, 2, 10, 3, 6, 20, 5], strict=True)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    n = fe.build(source_queries.sources(spark, str(tmp_path))).cache()
    nodes = {(r["graph_id"], r["node_id"]): (r["df_reads"], r["df_writes"]) for r in n.collect()}
    edges = {}
    for r in fe.cf_pass(n).filter("dst >= 0").collect():
        edges.setdefault((r["graph_id"], r["src"]), []).append(r["dst"])
    got = [(r["graph_id"], r["writer"], r["reader"], r["var"]) for r in source_queries.data_dependence(spark, str(tmp_path)).collect()]
    assert {r[0] for r in got} == {"g0", "g1", "g2", "g3", "g5", "g19"}
    assert len(got) == len(set(got)) and set(got) == _reaching(nodes, edges)


def test_fixpoints_do_not_stop_on_long_paths(spark, monkeypatch):
    flow = spark.createDataFrame([(1, i, ["x"] if i in (55, 56) else [], ["x"] if i == 1 else []) for i in range(1, 57)], "graph_id int, node_id long, reads array<string>, writes array<string>")
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(1, 56)], "graph_id int, src long, dst long")
    assert {(r["writer"], r["reader"]) for r in fixpoint.reaching_definitions(flow, edges).collect()} == {(1, 55), (1, 56)}
    path = spark.createDataFrame([(i, i + 1) for i in range(103)], "src long, dst long").coalesce(1).cache()
    assert {r["id"]: r["level"] for r in fixpoint.bfs(path, path.filter("src = 0").select(F.col("src").alias("id"))).collect()} == {i: i for i in range(104)}
    monkeypatch.setattr(flow_queries, "_links", lambda spark, sf_dir: path.filter("src < 64"))
    assert {r["id"]: r["label"] for r in flow_queries.min_label_program(spark, "").collect()} == {i: 0 for i in range(65)}
