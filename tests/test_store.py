"""The co-located store: joins without an exchange, lookups by pushed filters."""

import re

import pytest

from graphtide.sources.store import GraphStore

NODES = [(g, n, f"k{n % 3}") for g in range(20) for n in range(30)]
EDGES = [(g, n, (n * 7) % 30, "SyntaxChild") for g in range(20) for n in range(1, 30)] + [(3, 5, 5, "loop")]


@pytest.fixture(scope="module")
def store(spark):
    nodes = spark.createDataFrame(NODES, "graph_id long, node_id long, kind string")
    edges = spark.createDataFrame(EDGES, "graph_id long, src long, dst long, edge_type string")
    s = GraphStore.write(nodes, edges, "test_store", buckets=4)
    yield s
    s.drop()


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_have_no_exchange(spark, store):
    for df in (store.sources("kind"), store.targets("kind"), store.degrees()):
        plan = _plan(df)
        assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_adjacency_equals_plain_joins(store):
    kind = {(g, n): k for g, n, k in NODES}
    assert sorted(tuple(r[c] for c in ("graph_id", "src", "dst", "edge_type", "src_kind")) for r in store.sources("kind").collect()) == sorted((*e, kind[e[0], e[1]]) for e in EDGES)
    assert sorted(tuple(r[c] for c in ("graph_id", "src", "dst", "edge_type", "dst_kind")) for r in store.targets("kind").collect()) == sorted((*e, kind[e[0], e[2]]) for e in EDGES)
    degree = {(r.graph_id, r.node_id): (r.n_out, r.n_in) for r in store.degrees().collect()}
    assert degree == {(g, n): (sum(e[:2] == (g, n) for e in EDGES), sum((e[0], e[2]) == (g, n) for e in EDGES)) for g, n, _ in NODES}


def test_a_lookup_is_pushed_to_the_scan(store):
    df = store.at(3, 5)
    assert sorted(r["dst"] for r in df.collect()) == [5, 5]
    assert re.search(r"PushedFilters: .*EqualTo\(graph_id,3\), EqualTo\(src,5\)", _plan(df))


def test_a_store_is_replaced(spark, store):
    again = GraphStore.write(spark.createDataFrame([(1, 2, "a")], "graph_id long, node_id long, kind string"), spark.createDataFrame([], "graph_id long, src long, dst long"), "second_store", 2)
    GraphStore.write(spark.createDataFrame([(1, 3, "b")], "graph_id long, node_id long, kind string"), spark.createDataFrame([], "graph_id long, src long, dst long"), "second_store", 2)
    assert [tuple(r) for r in again.degrees().collect()] == [(1, 3, 0, 0)]
    again.drop()
    assert not spark.catalog.tableExists("second_store_nodes")
