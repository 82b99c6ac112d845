"""Changed ranges of two trees against a comparison position by position, and against expectations."""

import random

from graphtide.operators import tree, treediff

NODES = "graph_id long, node_id long, parent_id long, start long, end long, depth int, path string"


def _tree(rng, graph, size=40):
    """Random nested spans; children follow each other, with gaps."""
    rows, todo = [], [(None, 0, size, 0, "")]
    while todo:
        parent, a, z, depth, path = todo.pop()
        own = len(rows)
        path = f"{path}/{rng.choice('xyz')}"
        rows.append((graph, own, parent, a, z, depth, path))
        at = a
        while depth < 4 and at < z and rng.random() < 0.7:
            lo = at + rng.randrange(2)
            hi = min(z, lo + rng.randrange(0, 9))
            if lo <= hi:
                todo.append((own, lo, hi, depth + 1, path))
            at = max(hi, at + 1)
    return rows


def _signature(rows, p):
    inside = [(r[5], r[1], r[6]) for r in rows if r[3] <= p < r[4]]
    return max(inside)[2] if inside else ""


def _brute(old, new):
    out, last = [], None
    for p in range(-1, 60):
        differs = _signature(old, p) != _signature(new, p)
        if differs and last is None:
            last = p
        elif not differs and last is not None:
            out.append((last, p))
            last = None
    return out


def test_ranges_equal_brute_force(spark):
    rng = random.Random(8)
    old, new, want = [], [], []
    for g in range(25):
        a = _tree(rng, g)
        b = [(*r[:6], r[6].replace("x", "w") if rng.random() < 0.2 else r[6]) for r in a] if g % 2 else _tree(rng, g)
        a, b = ([] if g == 3 else a), ([] if g == 5 else b)
        old, new = old + a, new + b
        want += [(g, *r) for r in _brute(a, b)]
    got = treediff.changed_ranges(spark.createDataFrame(old, NODES), spark.createDataFrame(new, NODES))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    same = spark.createDataFrame(old, NODES)
    assert treediff.changed_ranges(same, same).count() == 0


def test_expectations(spark):
    found = spark.createDataFrame([("s", 1, 4, 9), ("s", 1, 12, 15), ("s", 2, 0, 3)], "suite string, case_no int, start long, end long")
    expected = spark.createDataFrame([("s", 1, 4, None), ("s", 1, 12, 14), ("s", 3, 1, 2)], found.schema)
    rows = {tuple(r) for r in treediff.met(found, expected, ["suite", "case_no"], ["start", "end"]).collect()}
    assert rows == {("s", 1, 4, 9, "hit"), ("s", 1, 12, 15, "unexpected"), ("s", 1, 12, 14, "missing"), ("s", 2, 0, 3, "unexpected"), ("s", 3, 1, 2, "missing")}


def test_paths_of_parents_spare_the_join_and_deep_trees_are_followed_by_level(spark):
    rows = [(g, n, n - 1 if n else None, n, 12 - n, n, None if n == 2 else f"k{(g + n) % 3}") for g in range(3) for n in range(6)]
    nodes = spark.createDataFrame(rows, "graph_id long, node_id long, parent_id long, start long, end long, depth int, kind string")
    path = lambda g, n: "/".join(r[6] for r in rows if r[0] == g and r[1] <= n and r[6])
    want = sorted((g, n, path(g, n), path(g, n - 1)) for g in range(3) for n in range(6))
    flat, deep = tree.with_paths(nodes), tree.with_paths(nodes, max_depth=3)
    for got in (flat, deep):
        assert sorted((r.graph_id, r.node_id, r.path, r.above) for r in got.collect()) == want
    assert sorted(map(tuple, treediff.signatures(flat).collect())) == sorted(map(tuple, treediff.signatures(flat.drop("above")).collect()))
