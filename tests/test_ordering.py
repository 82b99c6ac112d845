"""Labels of siblings: the order of a full renumbering, with few rows written."""

import random

import pytest

from graphtide.operators import ordering

CHILDREN = "graph_id long, parent_id long, node_id long, child_ord int"
NEW = "graph_id long, parent_id long, node_id long, after long, seq int"


def _lists(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.graph_id, r.parent_id), []).append((r.label, r.node_id, r.next_id))
    return {k: sorted(v) for k, v in out.items()}


def _checked(table, want):
    got = _lists(table)
    assert {k: [n for _, n, _ in v] for k, v in got.items()} == {k: v for k, v in want.items() if v}
    for rows in got.values():
        labels = [x for x, _, _ in rows]
        assert len(set(labels)) == len(labels) and 0 <= labels[0] and labels[-1] < 1 << ordering.BITS
        assert [n for _, _, n in rows] == [n for _, n, _ in rows[1:]] + [None]


def _apply(want, new):
    for (g, p, after), rows in new.items():
        own = want.setdefault((g, p), [])
        at = 0 if after is None else own.index(after) + 1
        own[at:at] = rows


def _spark_rows(new):
    return [(g, p, n, after, i) for (g, p, after), rows in new.items() for i, n in enumerate(rows)]


@pytest.mark.parametrize("bits", [62, 9])
def test_random_inserts(spark, monkeypatch, bits):
    """With few labels every batch has narrow gaps."""
    monkeypatch.setattr(ordering, "BITS", bits)
    monkeypatch.setattr(ordering, "LEVELS", (*range(2, bits, 3), bits))
    rng = random.Random(bits)
    want = {(1, 0): [1, 2, 3], (1, 5): [10], (2, 0): [1]}
    table = ordering.labelled(spark.createDataFrame([(g, p, n, i) for (g, p), v in want.items() for i, n in enumerate(v)], CHILDREN))
    _checked(table, want)
    fresh = 100
    for _ in range(4):
        new = {}
        for _ in range(8):
            g, p = rng.choice([(1, 0), (1, 5), (2, 0), (3, 7)])
            after = rng.choice([None, *want.get((g, p), [])])
            rows = list(range(fresh, fresh + rng.randrange(1, 4)))
            fresh += len(rows)
            new.setdefault((g, p, after), []).extend(rows)
        done = ordering.insert(table, spark.createDataFrame(_spark_rows(new), NEW))
        before = {k: list(v) for k, v in want.items()}
        _apply(want, new)
        table = spark.createDataFrame(done.table().collect(), table.schema)
        _checked(table, want)
        edges = lambda lists: {(g, a, b) for (g, _), v in lists.items() for a, b in zip(v, v[1:], strict=False)}
        assert {tuple(r) for r in done.edges_added().collect()} == edges(want) - edges(before)
        assert {tuple(r) for r in done.edges_removed().collect()} == edges(before) - edges(want)


def test_few_rows_are_written(spark):
    """A thousand children: one insert writes itself and its neighbour; forty at one place write few others."""
    n = 1000
    table = ordering.labelled(spark.createDataFrame([(1, 0, i, i) for i in range(n)], CHILDREN))
    one = ordering.insert(table, spark.createDataFrame([(1, 0, 5000, 500, 0)], NEW))
    assert sorted((r.node_id, r.is_new) for r in one.writes.collect()) == [(500, False), (5000, True)]
    # a narrow gap in the middle: the neighbours have adjoining labels
    rows = [(r.graph_id, r.parent_id, r.node_id, r.label, r.next_id) for r in table.collect()]
    at = {r[2]: r[3] for r in rows}
    tight = spark.createDataFrame([(g, p, i, at[500] + 1 if i == 501 else x, y) for g, p, i, x, y in rows], table.schema)
    many = ordering.insert(tight, spark.createDataFrame([(1, 0, 5000 + i, 500, i) for i in range(40)], NEW))
    written = many.writes.collect()
    assert len(written) <= 45 and [r.node_id for r in sorted(many.table().collect(), key=lambda r: r.label)] == [*range(501), *range(5000, 5040), *range(501, n)]


def test_refused_and_empty(spark):
    table = ordering.labelled(spark.createDataFrame([(1, 0, 1, 1)], CHILDREN))
    assert ordering.insert(table, spark.createDataFrame([], NEW)).writes.count() == 0
    with pytest.raises(Exception, match="not there"):
        ordering.insert(table, spark.createDataFrame([(1, 0, 2, 77, 0)], NEW)).writes.count()
