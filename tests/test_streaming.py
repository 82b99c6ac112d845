from pyspark.sql import functions as F

from graphtide.plans.flow_queries import commit_stream_state
from graphtide.streaming import changes


def _run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_commit_stream_equals_the_batch_twin(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("b", 1, "y"), ("a", 3, "z"), ("b", 2, "q")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "path string, step long, content_hash string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, step long, content_hash string").option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    got = sorted((r["path"], r["step"], r["action"]) for r in _run(spark, changes.commit_stream(stream), "commits").collect())
    assert got == [("a", 1, "baseline"), ("a", 2, "unchanged"), ("a", 3, "changed"), ("b", 1, "baseline"), ("b", 2, "changed")]
    assert commit_stream_state


def test_windows_and_sessions(spark, tmp_path):
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1)
    rows = [(1, t, "click", 1.0), (1, t + timedelta(minutes=1), "click", 2.0), (1, t + timedelta(hours=2), "view", 3.0), (2, t + timedelta(days=2), "view", 0.0)]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("user_id long, ts timestamp_ntz, event_type string, value double").parquet(str(tmp_path / "e"))
    got = sorted((r["event_type"], r["n"], r["value"]) for r in _run(spark, changes.tumbling(stream, "5 minutes"), "tumbling").collect())
    assert ("click", 2, 3.0) in got
    s = _run(spark, changes.sessions(stream, "30 minutes"), "sessions")
    assert sorted((r["user_id"], r["n"]) for r in s.collect())[:2] == [(1, 1), (1, 2)]


def test_listeners(spark):
    heard = []
    feed = changes.Listeners()
    feed.on("name", "one", lambda d: heard.append(("name", d.count())))
    feed.on(feed.ALL, "log", lambda d: heard.append(("all", d.count())))
    batch = spark.createDataFrame([(1, "name", "x"), (1, "order", "2")], "node_id long, key string, value string")
    feed.attach(batch)
    feed.suspend()
    feed.attach(batch)
    assert heard == [("all", 2), ("name", 1)]
    feed.resume()
    feed.on("name", "one", lambda d: heard.append("replaced"))
    feed.off(feed.ALL, "log")
    feed.attach(batch)
    assert heard == [("all", 2), ("name", 1)] * 2 + ["replaced"]


def test_insert_child_shifts_siblings(spark):
    schema = "graph_id int, parent_id int, node_id int, child_ord int"
    c = spark.createDataFrame([(1, 0, 10, 1), (1, 0, 11, 2), (1, 0, 12, 3)], schema)
    out = changes.insert_child(c, spark.createDataFrame([(1, 0, 99, 2)], schema))
    assert [r["node_id"] for r in out.orderBy("child_ord").collect()] == [10, 99, 11, 12]
    assert out.agg(F.max("child_ord")).first()[0] == 4
