"""Incremental updates, matching, graphs read from text, and the operators that once stopped early, against plain recomputation."""

import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from graphtide.functions import diff, text
from graphtide.operators import compare, fixpoint, graph, incremental, matching, metrics, spatial, tree
from graphtide.operators import frontends as fe
from graphtide.runtime import Shelf
from graphtide.sources import files, sinks

SCHEMA = "graph_id long, node_id long, end_id long, parent_id long, child_ord int, depth int, kind string, name string"
KINDS = ["function_definition", "if_statement", "declaration", "identifier", "comment"]


def _rows(df):
    cols = sorted(df.columns)
    return sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())


def _tree(rng, n, g=1):
    parent = [None] + [rng.randrange(max(0, i - 4), i) for i in range(1, n)]
    kids = {i: [k for k in range(n) if parent[k] == i] for i in range(n)}
    rows = []

    def walk(i, depth, up, nth):
        me = len(rows)
        row = [g, me, 0, up, nth, depth, rng.choice(KINDS) if depth else "translation_unit", f"n{rng.randrange(4)}"]
        rows.append(row)
        for k, c in enumerate(kids[i]):
            walk(c, depth + 1, me, k + 1)
        row[2] = len(rows)

    walk(0, 0, None, 1)
    return [tuple(r) for r in rows]


OLD = {
    "a": "int f(int a) { int v = a; if (v > 1) { v = 2; } else v = 3; return v; }\nint g() { return 1; }\n",
    "b": "// first\nint x = 1;\nint h(int q) { while (q) { q = g(q); } return q; }\n",
    "c": "int k() { return 0; }",
    "gone": "int z;",
}
NEW = {
    "a": "/* new { */ int g() { return 1; }\nint f(int a) { int v = a; if (v > 1) { v = 5; } else v = 3; return v; }\n",
    "b": "// first\nint x = 1;\nint y = 2;\nint h(int q) { while (q) { q = g(q); } return q; }\n",
    "c": "int k() { return 0; ",
    "d": "struct S { int a; } t;\nint m() { int arr[] = {1, 2}; return 1; }",
    "e": "for (int i = 0; i < 3; i++) { g(); }\nif (x) { g(); } else { h(); }",
    "é": "é(); char *s = \"};\"; int n() { return '}'; }",
    "empty": "",
    "null": None,
}


def test_an_update_equals_the_whole_computation(spark):
    frame = lambda d: spark.createDataFrame(list(d.items()), "graph_id string, text string").cache()
    shelf = Shelf(spark)
    old = incremental.build(frame(OLD), shelf.put)
    new = incremental.update(old, frame(NEW), shelf.put)
    fresh = incremental.build(frame(NEW), shelf.put)
    known = {r["hash"] for r in old.units.collect()}
    assert any(r["hash"] in known for r in new.units.collect())
    want = fe.build(frame(NEW)).cache()
    flow = fe.cf_pass(want).cache()
    facts = want.select("graph_id", "node_id", F.col("df_reads").alias("reads"), F.col("df_writes").alias("writes"))
    data = fixpoint.reaching_definitions(facts, flow.filter("dst >= 0").select("graph_id", "src", "dst"))
    for store in (new, fresh):
        at = shelf.put(incremental.placed(store))
        assert _rows(incremental.nodes(store, at)) == _rows(want)
        assert _rows(incremental.flow(store, at)) == _rows(flow.filter("error IS NULL").drop("error"))
        assert _rows(incremental.data(store, at)) == _rows(data)
    shelf.clear()


@pytest.mark.parametrize("source", [*NEW.values(), "}{", "int a = 1", "'", "#define x {\nint f() { return 1; }", "f(;", "a;;b;"])
def test_units_concatenate_to_the_text(source):
    assert "".join(incremental.split_units(source or "")) == (source or "")


def test_random_sources_in_parts_equal_the_whole(spark):
    rng = random.Random(4)
    bits = ["int f() { return 1; }", "int x = 2;", "// c }\n", "if (a) { b(); }", "else { c(); }", "{", "}", ";", "int y", "f(", ")", "\n", "#p {\n", '"', "struct S { int q; };", "while (x) { x = x - 1; }"]
    cases = {f"g{k}": " ".join(rng.choices(bits, k=rng.randrange(1, 9))) for k in range(150)}
    df = spark.createDataFrame(list(cases.items()), "graph_id string, text string").cache()
    shelf = Shelf(spark)
    store = incremental.build(df, shelf.put)
    assert _rows(incremental.nodes(store, shelf.put(incremental.placed(store)))) == _rows(fe.build(df))
    shelf.clear()


def test_operations_and_pairs_of_versions(spark):
    a = spark.createDataFrame([("g", OLD["a"])], "graph_id string, text string")
    b = spark.createDataFrame([("g", OLD["a"].replace("v = 2", "w = 2") + "int t;")], "graph_id string, text string")
    old, new = fe.build(a).cache(), fe.build(b).cache()
    got = {r["path"]: r for r in incremental.operations(old, new).collect()}
    assert {r["op"] for r in got.values()} >= {"keep", "update", "insert"} and len(got) == new.count()
    assert sum(r["l_id"] is not None for r in got.values()) == old.count()
    edits = diff.edits(a.withColumnRenamed("text", "old").join(b.withColumnRenamed("text", "new"), "graph_id"), ["graph_id"])
    span = lambda d: d.select("graph_id", "node_id", "start_byte", "end_byte")
    pairs = {r["l_id"]: r["r_id"] for r in incremental.repaired(span(old), edits, span(new)).collect()}
    kind = lambda d: {r["node_id"]: (r["kind"], r["start_byte"]) for r in d.collect()}
    before, after = kind(old), kind(new)
    last = max(i for i, (k, _) in before.items() if k == "function_definition")
    assert after[pairs[last]] == before[last]
    assert incremental.repaired(span(old), edits.limit(0), span(old)).filter("l_id <> r_id").join(span(old).withColumnRenamed("node_id", "l_id"), ["graph_id", "l_id"]).count() < old.count()


def test_function_returns(spark):
    n = fe.build(spark.createDataFrame([("g", "int f(int a) { a = 1; if (a) { return a; } return a + a; }\nint g() { return 2; }")], "graph_id string, text string")).cache()
    flow = fe.cf_pass(n)
    facts = n.select("graph_id", "node_id", F.col("df_reads").alias("reads"), F.col("df_writes").alias("writes"))
    data = fixpoint.reaching_definitions(facts, flow.filter("dst >= 0").select("graph_id", "src", "dst"))
    functions = sorted(r["node_id"] for r in n.filter("node_type = 'Function'").collect())
    assert sorted(r["node_id"] for r in fe.function_returns(n).collect()) == sorted(-1 - f for f in functions)
    got = [(r["edge_type"], r["dst"], r["var"]) for r in fe.return_edges(n, flow, data).collect()]
    assert sorted(got, key=str) == sorted([("ControlFlowFunctionReturn", -1 - f, None) for f in functions] + [("PDData", -1 - functions[0], "a")] * 2, key=str)


def _path(rows, r):
    up = {x[1]: x for x in rows}
    out = []
    while r is not None:
        out.append(r[6])
        r = up[r[3]] if r[3] is not None else None
    return out[::-1]


def test_node_and_edge_matches_against_all_pairs(spark):
    rng = random.Random(8)
    for n in (1, 9, 24):
        left = _tree(rng, n)
        right = [(*r[:7], rng.choice([r[7], "other"])) for r in left if r[1] % 7 != 5]
        frames = []
        for rows in (left, right):
            d = spark.createDataFrame(rows, SCHEMA).withColumns({"start": F.col("node_id"), "end": F.col("end_id")})
            p = spark.createDataFrame([(1, r[1], _path(left, next(x for x in left if x[1] == r[1]))) for r in rows], "graph_id long, node_id long, path array<string>")
            frames.append(d.join(p, ["graph_id", "node_id"]).cache())
        score = {}
        for a, b in itertools.product(left, right):
            if a[6] == b[6]:
                x, y = _path(left, a), _path(left, next(r for r in left if r[1] == b[1]))
                pre = next((k for k, (i, j) in enumerate(zip(x, y)) if i != j), min(len(x), len(y)))
                post = next((k for k, (i, j) in enumerate(zip(x[::-1], y[::-1])) if i != j), min(len(x), len(y)))
                sim = 2 * min(pre + post, len(x), len(y)) / (len(x) + len(y))
                far = abs(a[1] - b[1]) + abs(a[2] - b[2])
                score[a[1], b[1]] = max(0, 100 + 30 * sim - 15 + ((25 - far) / 25 * 10 if far <= 25 else -min(20, far)) + (5 if a[7] == b[7] else 0))
        best = {}
        for (i, j), s in sorted(score.items()):
            if s > 50 and (i not in best or s > score[i, best[i]] + 1e-9):
                best[i] = j
        back = {}
        for i, j in sorted(best.items()):
            if j not in back or score[i, j] >= score[back[j], j] - 1e-9:
                back[j] = i
        m = matching.node_matches(*frames).cache()
        assert {r["r_id"]: r["l_id"] for r in m.collect()} == back
        to = {i: j for j, i in back.items()}
        sign = {p: {r[1]: (r[6], r[7]) for r in rows} for p, rows in (("l", left), ("r", right))}
        ids = {r[1] for r in right}
        le, re_ = ([(r[3], r[1]) for r in rows if r[3] is not None] for rows in (left, right))
        re_ = [e for e in re_ if e[0] in ids]
        scored = []
        for a, b in itertools.product(le, re_):
            s, d = to.get(a[0]) == b[0], to.get(a[1]) == b[1]
            if s or d:
                ends = 90 if s and d else 60 if (sign["l"][a[1]] == sign["r"][b[1]] if s else sign["l"][a[0]] == sign["r"][b[0]]) else 25
                scored.append((ends + 10, a, b))
        used, want = set(), {}
        for s, a, b in sorted(scored, reverse=True):
            if s > 30 and b not in used:
                used.add(b)
                want[a] = (b, s)
        right_edges = graph.child_edges(frames[1]).join(frames[1].select("graph_id", F.col("node_id").alias("src")), ["graph_id", "src"], "left_semi")
        of = lambda d: d.select("graph_id", "node_id", F.struct("kind", "name").alias("sign"))
        got = matching.edge_matches(graph.child_edges(frames[0]), right_edges, m, of(frames[0]), of(frames[1]))
        assert {(r["l_src"], r["l_dst"]): ((r["r_src"], r["r_dst"]), r["score"]) for r in got.collect()} == want
        changes = matching.node_changes(*frames, m).collect()
        assert sorted(r["pos"] for r in changes) == list(range(1, len(changes) + 1)) and sum(r["l_id"] is not None for r in changes) == len(left)


def test_path_similarity_is_the_ratio_of_one_replaced_stretch(spark):
    cases = [("a/b/c", "a/x/c"), ("a", "a"), ("a/b", "c/d"), ("a/b/c/d", "a/d"), ("a/a", "a")]
    df = spark.createDataFrame(cases, "x string, y string").select("x", "y", matching.path_similarity(F.split("x", "/"), F.split("y", "/")).alias("s"))
    for r in df.collect():
        assert r["s"] == pytest.approx(SequenceMatcher(None, r["x"].split("/"), r["y"].split("/")).ratio())


def test_sexp_graphs_come_back(spark):
    rows = _tree(random.Random(2), 30)
    nodes = spark.createDataFrame(rows, SCHEMA)
    back = spark.createDataFrame([(1, 7, 0, "Back")], "graph_id long, src long, dst long, edge_type string")
    edges = graph.child_edges(nodes).unionByName(back)
    got_nodes, got_edges = files.sexp_graph(files.parsed_sexp(sinks.sexp(nodes, edges), ["graph_id"], "sexp"), ["graph_id"])
    # a marked node's edges are written before the tree goes on, so numbers follow the first visit: spans tell the nodes apart
    number = {r["start"]: r["node_id"] for r in got_nodes.collect()}
    assert sorted(number) == [r[1] for r in rows]
    assert sorted((r["src"], r["dst"], r["edge_type"], r["visited"]) for r in got_edges.collect()) == sorted(
        [(number[r[3]], number[r[1]], "SyntaxChild", False) for r in rows if r[3] is not None] + [(number[7], number[0], "Back", True)]
    )


def test_merging_on_either_axis(spark):
    rng = random.Random(6)
    cols = "graph_id long, old_start long, old_end long, new_start long, new_end long"
    for n in (0, 1, 6, 18):
        rows = [(1, a, a + rng.randrange(1, 5), b, b + rng.randrange(1, 5)) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(n))]
        left = list(dict.fromkeys(rows))
        while True:
            hit = next(((x, y) for x, y in itertools.combinations(left, 2) if (x[1] < y[2] and y[1] < x[2]) or (x[3] < y[4] and y[3] < x[4])), None)
            if hit is None:
                break
            x, y = hit
            left = list(dict.fromkeys([r for r in left if r not in hit] + [(1, min(x[1], y[1]), max(x[2], y[2]), min(x[3], y[3]), max(x[4], y[4]))]))
        got = spatial.merge_old_or_new(spark.createDataFrame(rows, cols), ["graph_id"])
        assert sorted(tuple(r)[:5] for r in got.select("graph_id", "old_start", "old_end", "new_start", "new_end").collect()) == sorted(left)
        assert n == 0 or got.agg(F.sum("n")).first()[0] == n


def test_children_are_aligned(spark):
    one = [(1, 0, k, k + 1, kind, name) for k, (kind, name) in enumerate([("a", "x"), ("b", "y"), ("c", "z")], 1)]
    two = [(1, 0, k, k + 1, kind, name) for k, (kind, name) in enumerate([("a", "x"), ("q", "n"), ("b", "w")], 1)]
    schema = "graph_id long, parent_id long, node_id long, end_id long, kind string, name string"
    got = compare.aligned_children(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema), ["graph_id", "parent_id"])
    assert sorted((r["op"], r["l_id"], r["r_id"]) for r in got.collect() if r["op"] in ("keep", "modify")) == [("keep", 1, 1), ("modify", 2, 3)]
    assert sorted(r["op"] for r in got.collect()) == ["delete", "insert", "keep", "modify"]


def test_deep_trees_and_subtree_counts(spark):
    chain = [(1, i, 90, i - 1 if i else None, 1, i, "function_definition" if i in (3, 50) else "translation_unit" if i == 0 else "declaration", f"n{i}") for i in range(90)]
    deep = spark.createDataFrame(chain, SCHEMA)
    got = {r["node_id"]: r["function_id"] for r in tree.containing_function(deep).collect()}
    assert got == {i: 50 if i >= 50 else 3 if i >= 3 else None for i in range(90)}
    assert {r["node_id"]: r["container_id"] for r in tree.nearest_container(deep).collect()} == {i: 50 if i >= 50 else 3 if i >= 3 else 0 for i in range(90)}
    rng = random.Random(3)
    for n in (1, 2, 40):
        rows = _tree(rng, n)
        want = {r[1]: sum(r[1] <= x[1] < r[2] and x[6] == "function_definition" for x in rows) for r in rows}
        found = tree.functions_in_subtree(spark.createDataFrame(rows, SCHEMA), F.col("kind") == "function_definition")
        assert {r["node_id"]: r["n_functions"] for r in found.collect()} == {k: v for k, v in want.items() if v}
        flat = spark.createDataFrame(rows, SCHEMA)
        paths = {r["node_id"]: r["path"] for r in tree.child_paths(flat).collect()}
        assert sorted(paths, key=lambda i: paths[i]) == sorted(paths)
        assert {r["node_id"]: r["found"] for r in tree._climbed(flat, F.col("kind") == "if_statement", n).collect()} == {
            r[1]: max((x[1] for x in rows if x[1] <= r[1] < x[2] and x[6] == "if_statement"), default=None) for r in rows
        }


def test_first_mismatch_looks_into_the_whole_subtree(spark):
    row = lambda i, end, up, nth, depth, kind, name: (1, i, end, up, nth, depth, kind, name)
    left = [row(0, 6, None, 1, 0, "translation_unit", "t"), row(1, 6, 0, 1, 1, "function_definition", "f"), row(2, 5, 1, 1, 2, "if_statement", "i"), row(3, 4, 2, 1, 3, "identifier", "a"), row(4, 5, 2, 2, 3, "identifier", "b"), row(5, 6, 1, 2, 2, "identifier", "c")]
    # the function stands second, and differs three levels down
    right = [row(0, 7, None, 1, 0, "translation_unit", "t"), row(1, 2, 0, 1, 1, "comment", "x")] + [row(r[1] + 1, r[2] + 1, 0 if r[3] == 0 else r[3] + 1, 2 if r[1] == 1 else r[4], r[5], "declaration" if r[7] == "b" else r[6], "d" if r[7] == "c" else r[7]) for r in left[1:]]
    l, r = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)  # noqa: E741
    changed = compare.compare_graphs(l, r).filter("status = 'changed'")
    assert [(x["name"], x["path"], x["child_ord"]) for x in compare.first_mismatch(changed, l, r).collect()] == [("f", "0000001/0000002", 1)]


def test_a_cycle_beside_a_tree_is_no_tree(spark):
    nodes = spark.createDataFrame([(1, 0, None), (1, 1, 0), (1, 2, 3), (1, 3, 2), (2, 0, None), (2, 2, 0), (2, 1, 2)], "graph_id long, node_id long, parent_id long")
    edges = spark.createDataFrame([(1, 0, 1), (1, 2, 3), (1, 3, 2), (2, 0, 2), (2, 2, 1)], "graph_id long, src long, dst long").withColumn("edge_type", F.lit("SyntaxChild"))
    assert {r["graph_id"]: r["is_tree"] for r in graph.tree_checks(nodes, edges).collect()} == {1: False, 2: True}


def test_running_totals_and_decisions(spark):
    values = random.Random(1).choices(range(50), k=300)
    df = spark.createDataFrame(list(enumerate(values)), "i long, v long")
    got = {r["i"]: r["s"] for r in metrics.running_total(df, ["v", "i"], "v", "s").collect()}
    order = sorted(range(300), key=lambda i: (values[i], i))
    assert got == dict(zip(order, itertools.accumulate([0] + [values[i] for i in order]), strict=False))
    counts = spark.createDataFrame([(0, 0, 0, 4, False, False), (0, 0, 0, 4, True, False), (0, 0, 0, 4, False, True), (1, 1, 1, 0, False, False)], "n_insert long, n_delete long, n_modify long, n_keep long, type_changed boolean, unsupported boolean")
    assert sorted((r["type_changed"], r["unsupported"], r["n_keep"], r["decision"]) for r in compare.decision(counts).collect()) == [(False, False, 0, "rebuild"), (False, False, 4, "patch"), (False, True, 4, "rebuild"), (True, False, 4, "rebuild")]


def test_text_arrays_and_context(spark):
    rows = [(x,) for x in ("", "th", "xthth", "aaa", "a\nb\n", "é th ü", "ab" * 300, "\n" * 300)]
    df = spark.createDataFrame(rows, "t string")
    for needle in ("th", "aa", "ab"):
        for r in df.select("t", text.find_all(F.col("t"), needle).alias("f")).collect():
            assert r["f"] == [i for i in range(len(r["t"])) if r["t"].startswith(needle, i)]
    for r in df.select("t", text.line_starts(F.col("t")).alias("f")).collect():
        sizes = [len(x.encode()) + 1 for x in r["t"].split("\n")]
        assert r["f"] == [sum(sizes[:k]) for k in range(len(sizes))]
    segments = diff.char_segments("abcxdef", "abcydef", context=True)
    assert [s for s in segments if s[0] != "equal"] == [("replace", 2, 5, 2, 5)] and diff.char_segments("abcxdef", "abcydef")[1] == ("replace", 3, 4, 3, 4)
    for a, b in (("", ""), ("a", ""), ("no end", "no end\n"), ("x\ny", "x\nz"), ("a\r\nb\n", "a\nb\n"), ("same\n", "same\n")):
        d = spark.createDataFrame([(a, b)], "a string, b string").select(diff.patched("a", diff.unified_diff("a", "b")).alias("p")).first()["p"]
        assert d == b


def test_generated_patches_apply_one_after_the_other(spark):
    source = "int f(int a) {\n  int v = 3;\n  v = v + 12;\n  g(v);\n  return v;\n}\n"
    from graphtide.functions import patchgen

    made = patchgen.sequence(source, 12, seed=5)
    assert [p[1] for p in made[:5]] == list(patchgen.OPERATIONS) and made == patchgen.sequence(source, 12, seed=5)
    now = source
    for _, _, _, d in made:
        now = diff.apply_patch(now, d)
    assert now != source and "gen2" in now and "// note 5" in now
    assert patchgen.safe_statements(source.splitlines()) == [2, 3]
    assert patchgen.base(source, 1) == source.replace("  v = v + 12;\n", "")
    assert [p[1] for p in patchgen.sequence("", 3)] == ["add-comment", "add-comment", "add-comment"]
    df = spark.createDataFrame([("d", source), ("e", None)], "dir string, content string")
    assert patchgen.patches(df, 4).count() == 8


def test_strategies_logs_and_queues(spark, tmp_path):
    from graphtide.streaming import changes

    rng = random.Random(2)
    spans = spark.createDataFrame([(1, i, a, a + rng.randrange(1, 90)) for i, a in enumerate(rng.choices(range(300), k=40))], "graph_id long, node_id long, start long, end long")
    queries = spark.createDataFrame([(1, q, a, a + rng.randrange(1, 9)) for q, a in enumerate(rng.choices(range(300), k=15))], "graph_id long, query_id long, q_start long, q_end long")
    for find in ("overlapping", "containing"):
        found = [sorted(tuple(sorted(r.asDict().items())) for r in getattr(spatial.RangeIndex(spans, s, 16), find)(queries).collect()) for s in spatial.RangeIndex.STRATEGIES]
        assert found[0] == found[1] == found[2] and found[0]
    with pytest.raises(ValueError, match="unknown"):
        spatial.RangeIndex(spans, "tree")
    done = fixpoint.work_off(spark.createDataFrame([(1,), (1,), (40,)], "n long"), lambda q: q.select((F.col("n") * 2).alias("n")).filter("n < 100"))
    assert sorted(r["n"] for r in done.collect()) == [1, 2, 4, 8, 16, 32, 40, 64, 80]
    with pytest.raises(RuntimeError):
        fixpoint.work_off(spark.createDataFrame([(1,)], "n long"), lambda q: q.select((F.col("n") + 1).alias("n")), max_rounds=3)
    changes.change_log(spark.createDataFrame([(1, "order", 2)], "node_id long, key string, value int"), str(tmp_path / "log"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [(1, "order", "2")]
    nodes = spark.createDataFrame(_tree(rng, 5), SCHEMA).withColumn("name", F.lit("a_b"))
    text_ = sinks.serialize(nodes, graph.child_edges(nodes), "tikz").first()["text"]
    assert text_.count(r"a\_b") == 5 and text_.count(r"\draw") == 4 and text_.startswith(r"\begin{tikzpicture}")
    with pytest.raises(ValueError, match="unknown"):
        sinks.serialize(nodes, nodes, "gif")


def test_late_versions_come_out_as_late(spark, tmp_path):
    from graphtide.streaming import changes

    schema = "path string, step long, content_hash string"
    for step in (2, 1):
        spark.createDataFrame([("p", step, "x")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = changes.drained(changes.commit_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path / "run"))
    assert sorted((r["step"], r["action"]) for r in got.collect()) == [(1, "late"), (2, "baseline")]


def test_parents_of_ranges_against_all_spans(spark):
    rng = random.Random(9)
    types = ["TranslationUnit", "Block", "Function", "Statement", "Call"]
    for n in (0, 1, 30):
        spans = [(1, i, a, a + rng.randrange(0, 200), rng.choice(types[1:] if n == 30 else types)) for i, a in enumerate(rng.choices(range(40, 300), k=n))]
        asked = [(g, q, a, a + rng.randrange(-20, 60)) for g in (1, 2) for q, a in enumerate(rng.choices(range(20, 320), k=25))]
        want = {}
        for g, q, a, z in asked:
            fits = [(spatial.PRIORITY.get(t, 4), max(z - e, 0), a - s, i) for _, i, s, e, t in spans if g == 1 and s <= a]
            if fits:
                want[q] = min(fits)[3]
        s = spark.createDataFrame(spans, "graph_id long, node_id long, start long, end long, node_type string")
        q = spark.createDataFrame(asked, "graph_id long, query_id int, q_start long, q_end long")
        got = spatial.parent_for_range(s, q).collect()
        assert {r["query_id"]: r["node_id"] for r in got} == want and all(r["graph_id"] == 1 for r in got)


def _next_statements(rows, edges):
    """For each statement, return and function, the statements, returns and exits that come next along the flow."""
    kind = {r["node_id"]: r["node_type"] for r in rows}
    after = {}
    for src, dst in edges:
        after.setdefault(src, set()).add(dst)
    out = set()
    for start, what in kind.items():
        if what in ("Statement", "Return", "Function"):
            seen, todo = set(), list(after.get(start, ()))
            while todo:
                n = todo.pop()
                if n in seen:
                    continue
                seen.add(n)
                if n < 0 or kind.get(n) in ("Statement", "Return"):
                    out.add((start, n))
                else:
                    todo += after.get(n, ())
    return out


def test_flow_by_messages_has_the_same_next_statements(spark):
    from graphtide.operators import control

    source = (
        "int f(int a) { a = 1; if (a) { a = 2; a = 3; } else a = 4; while (a) { a = a - 1; if (a) { a = 9; } } for (a = 0; a < 3; a = a + 1) { a = 5; } return a; }\n"
        "int g() { if (g) { return 1; } g(); }\nint h() { }\nint k(int a) { while (a) { while (a) { a = 1; } } }"
    )
    nodes = fe.build(spark.createDataFrame([("x", source), ("y", "int m() { return 1; }")], "graph_id string, text string")).cache()
    got, want = control.flow_by_messages(nodes).collect(), fe.cf_pass(nodes).collect()
    for g in ("x", "y"):
        rows = nodes.filter(F.col("graph_id") == g).collect()
        pairs = [_next_statements(rows, [(r["src"], r["dst"]) for r in e if r["graph_id"] == g]) for e in (got, want)]
        assert pairs[0] == pairs[1]
    kinds = lambda e: {(r["graph_id"], r["src"], r["dst"]) for r in e if r["edge_type"] in ("ControlFlowTrue", "ControlFlowFalse")}
    assert kinds(got) == kinds(want)


def _checkpoints(spark):
    from graphtide.runtime import ensure_checkpoint_dir, listed

    folder = ensure_checkpoint_dir(spark)
    return sum(len([n for n in listed(spark, f"{folder}/{d}") if n.startswith("rdd-")]) for d in listed(spark, folder))


def test_loops_leave_the_tables_of_one_round(spark):
    """However long a path is, and so however many rounds, what a loop leaves behind is its result."""
    from graphtide.operators import components, fixpoint

    def path(n):
        return spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long")

    def left(of):
        out = []
        for n in (3, 24):
            before = _checkpoints(spark)
            rows = of(path(n)).count()
            assert rows >= n
            out.append(_checkpoints(spark) - before)
        return out

    flow = lambda e: e.select(F.lit(1).alias("graph_id"), F.col("src").alias("node_id"), F.array(F.lit("v")).alias("reads"), F.when(F.col("src") == 0, F.array(F.lit("v"))).otherwise(F.array().cast("array<string>")).alias("writes"))
    assert left(components.connected_components) == [1, 1]
    assert left(lambda e: fixpoint.min_labels(e, None)[0]) == [1, 1]
    assert left(lambda e: fixpoint.min_labels_active(e)[0]) == [1, 1]
    assert left(lambda e: fixpoint.work_off(e.select("src"), lambda q: q.select((F.col("src") % 5 + 1).alias("src")))) == [1, 1]
    assert max(left(lambda e: fixpoint.bfs(e, spark.createDataFrame([(0,)], "id long")))) <= 5
    assert left(lambda e: fixpoint.reaching_definitions(flow(e), e.select(F.lit(1).alias("graph_id"), "src", "dst")).unionByName(spark.range(24).selectExpr("1 graph_id", "id writer", "id reader", "'x' var"))) == [1, 1]


def test_numbers_and_rows_before_of_hot_keys(spark):
    """One key holds most rows, one is null, several rows tie with no other key: equal to a window over each key."""
    from pyspark.sql import Window

    from graphtide.operators import metrics

    rows = [("hot", i, i * 7 % 11) for i in range(400)] + [(None, i, i) for i in range(9)] + [(f"k{i % 30}", i, None) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(7)
    w = Window.partitionBy("k").orderBy("i")
    want = df.select("k", "i", "v", F.row_number().over(w).alias("step"), F.lag("v").over(w).alias("previous_v")).collect()
    got = metrics.consecutive(df, ["k"], ["i"], ["v"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    assert metrics.consecutive(df.limit(0), ["k"], ["i"], ["v"]).count() == 0
