"""Active-set programs and mergeable sketches."""

import random

from pyspark.sql import functions as F

from graphtide.operators import fixpoint
from graphtide.operators import metrics as M


def test_active_vertices_send_less_and_less(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [tuple(rng.sample(range(200, 240), 2)) for _ in range(60)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got, rounds = fixpoint.min_labels_active(df)
    want, stable = fixpoint.min_labels(df, max_rounds=None)
    assert stable and {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    sent, changed = [r[1] for r in rounds.rows], [r[2] for r in rounds.rows]
    assert sent[0] == 2 * len({frozenset(e) for e in edges}) and changed[-1] == 0
    # the star and the dense part are settled in a few rounds; then the path alone is awake
    assert max(sent[6:]) < sent[0] / 3 and sent == sorted(sent, reverse=True)
    assert rounds.rows[0][3] > 1


def test_sketches(spark):
    rng = random.Random(3)
    rows = [(k, d, rng.lognormvariate(0, 2) if k else float(rng.randrange(5))) for k in (0, 1) for d in range(6) for _ in range(2000)] + [(0, 0, None)]
    df = spark.createDataFrame(rows, "k int, day int, x double").repartition(5)
    ranks = [0.01, 0.25, 0.5, 0.9, 0.99]
    daily = M.quantile_sketches(df, ["k", "day"], "x")
    merged = M.sketch_quantiles(M.merge_sketches(daily, ["k"]), ["k"], ranks).collect()
    once = M.sketch_quantiles(M.quantile_sketches(df, ["k"], "x"), ["k"], ranks).collect()
    for r in merged + once:
        own = sorted(x for k, _, x in rows if k == r["k"] and x is not None)
        low, high = sum(x < r["value"] for x in own) / len(own), sum(x <= r["value"] for x in own) / len(own)
        assert r["n"] == len(own) == 12000 and low - 0.01 <= r["rank"] <= high + 0.01
    assert M.quantile_sketches(df.filter(F.col("x") < 0), ["k"], "x").count() == 0


def test_loops_make_their_edges_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long").write.parquet(str(tmp_path / "edges"))
    edges, plans, cut = spark.read.parquet(str(tmp_path / "edges")), [], fixpoint.cut
    monkeypatch.setattr(fixpoint, "cut", lambda df, *old: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df, *old))[1])
    assert {r["level"] for r in fixpoint.bfs(edges, spark.createDataFrame([(0,)], "id long")).collect()} == set(range(7))
    assert {r["label"] for r in fixpoint.min_labels(edges, None)[0].collect()} == {0}
    assert len(plans) > 10 and not any(str(tmp_path) in p for p in plans)


def test_components_end_when_only_stars_are_left(spark, monkeypatch):
    from graphtide.operators import components

    rounds, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df, *old: (rounds.append(1), cut(df, *old))[1])
    trees = spark.createDataFrame([(10 * g, 10 * g + k) for g in range(5) for k in range(1, 4)], "src long, dst long")
    found = {r["node"]: r["component"] for r in components.connected_components(trees).collect()}
    assert found == {10 * g + k: 10 * g for g in range(5) for k in range(4)} and len(rounds) == 2
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    assert {r["component"] for r in components.connected_components(path).collect()} == {0}
