"""Stored aggregates against a batch computation after every micro-batch, and a feed that outlives its session."""

import random

import pytest
from pyspark.sql import functions as F

from graphtide.streaming import durable, views

FEED = "id long, message long, sign int"


def _want(rows):
    left = {}
    for i, m, sign in rows:
        left.setdefault(i, []).append(m) if sign > 0 else left[i].remove(m)
    return sorted((i if i is not None else -99, len(v), sum(v), min(v), max(v)) for i, v in left.items() if v)


def _got(view):
    return sorted((r.id if r.id is not None else -99, r.n, r.total, r.least, r.greatest) for r in view.read().collect())


def test_view_equals_a_batch_after_every_epoch(spark, tmp_path):
    rng = random.Random(2)
    view, all_rows, alive = views.View(spark, str(tmp_path / "v"), ["id"], {"total": "message"}, {"least": "message"}, {"greatest": "message"}, buckets=4), [], []
    with pytest.raises(ValueError, match="no batch"):
        view.read()
    recomputed = []
    for epoch in range(4):
        batch = []
        for _ in range(30):
            if alive and rng.random() < 0.15 * epoch:
                batch.append((*alive.pop(rng.randrange(len(alive))), -1))
            else:
                row = (rng.choice([1, 2, 3, 4, 5, None]), rng.randrange(6))
                alive.append(row)
                batch.append((*row, 1))
        df = spark.createDataFrame(batch, FEED)
        view.apply(df, epoch)
        view.apply(df, epoch)  # a retry
        recomputed.append(view.recomputed)
        all_rows += batch
        assert _got(view) == _want(all_rows)
    assert recomputed[0] == 0 and any(recomputed)
    # everything goes; another object on the same folder reads the same
    view.apply(spark.createDataFrame([(*r, -1) for r in alive], FEED), 9)
    again = views.View(spark, str(tmp_path / "v"), ["id"], {"total": "message"}, {"least": "message"}, {"greatest": "message"}, buckets=4)
    assert _got(again) == [] and again.epochs() == [0, 1, 2, 3, 9]
    again.apply(spark.createDataFrame([(1, 5, 1)], FEED), 10)
    assert _got(again) == [(1, 1, 5, 5, 5)]
    with pytest.raises(Exception, match="more rows go"):
        again.apply(spark.createDataFrame([(1, 5, -1), (1, 5, -1)], FEED), 11)


def test_only_touched_buckets_are_written(spark, tmp_path):
    view = views.View(spark, str(tmp_path / "v"), ["id"], buckets=8)
    view.apply(spark.createDataFrame([(i, 0, 1) for i in range(200)], FEED), 0)
    view.apply(spark.createDataFrame([(7, 0, 1)], FEED), 1)
    where = view._manifest(1)
    assert len(where) == 8 and list(where.values()).count(1) == 1
    assert {r.id: r.n for r in view.read().collect()} == dict.fromkeys(range(200), 1) | {7: 2}


def test_a_stream_keeps_the_view(spark, tmp_path):
    for part in ([(1, 4, 1), (2, 9, 1), (1, 2, 1)], [(1, 2, -1), (2, 9, -1)]):
        spark.createDataFrame(part, FEED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    view = views.inboxes(spark, str(tmp_path / "v"))
    feed = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    feed.writeStream.foreachBatch(view.apply).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert _got(view) == [(1, 1, 4, 4, 4)] and view.epochs() == [0, 1]


def _batch(spark, k):
    return spark.createDataFrame([(k, "name", f"n{k}"), (k, "order", str(k))], "node_id long, key string, value string")


def test_suspension_ends_in_another_session(spark, tmp_path):
    feed = durable.DurableListeners(spark, str(tmp_path / "feed"))
    feed.on("name", "names", durable.by_epoch(str(tmp_path / "names")))
    feed.attach(_batch(spark, 0), 0)
    feed.suspend()
    for k in (1, 2):
        feed.attach(_batch(spark, k), k)
    assert feed.offset("names") == 0
    # nothing of the first object is left: a new session has the folder only
    other = spark.newSession()
    later = durable.DurableListeners(other, str(tmp_path / "feed"))
    later.on("name", "names", durable.by_epoch(str(tmp_path / "names")))
    seen = []
    later.on(later.ALL, "all", lambda rows, epoch: seen.append((epoch, rows.count())))
    assert later.suspended()
    later.attach(_batch(other, 3), 3)
    assert seen == []
    later.resume()
    later.attach(_batch(other, 3), 3)  # a retry of a batch
    names = [r["value"] for r in spark.read.parquet(str(tmp_path / "names")).orderBy("node_id").collect()]
    assert names == ["n0", "n1", "n2", "n3"] and seen == [(0, 2), (1, 2), (2, 2), (3, 2)]
    later.start("all", 1)
    later.resume()
    assert seen[4:] == [(2, 2), (3, 2)]


def test_a_call_that_fails_is_made_again(spark, tmp_path):
    feed = durable.DurableListeners(spark, str(tmp_path / "feed"))
    calls = []

    def flaky(rows, epoch):
        calls.append(epoch)
        durable.by_epoch(str(tmp_path / "out"))(rows, epoch)
        if len(calls) == 2:
            raise RuntimeError("lost")

    feed.on(feed.ALL, "one", flaky)
    feed.attach(_batch(spark, 0), 0)
    with pytest.raises(RuntimeError):
        feed.attach(_batch(spark, 1), 1)
    feed.attach(_batch(spark, 1), 1)
    assert calls == [0, 1, 1] and spark.read.parquet(str(tmp_path / "out")).filter(F.col("key") == "name").count() == 2
