"""The commit stream with its own source: batches by offset, state by file, restart in mid-stream, timers and time to live."""

import time

from graphtide.streaming import commits

VERSIONS = "path string, step long, file string, content_hash string"


def _versions():
    rows = []
    for p in ("a", "b", "c"):
        for step in range(6):
            for f in ("x", "y"):
                if (step + len(f) + ord(p)) % 4:
                    rows.append((p, step, f, f"{p}{f}{step // 2 if f == 'x' else step // 3}"))
    return rows


def _want(rows):
    known, out = {}, []
    for p, step, f, h in sorted(rows, key=lambda r: (r[1], r[0], r[2])):
        old = known.get((p, f))
        out.append((p, step, f, "baseline" if old is None else "unchanged" if old == h else "changed"))
        known[p, f] = h
    return sorted(out)


def _run(stream, folder, batches=None):
    """To the end of what is there, or killed after a number of batches."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append")
    q = q.trigger(processingTime="0 seconds").start()
    until = time.time() + 120
    while time.time() < until and q.isActive:
        done = [p for p in q.recentProgress if p.numInputRows > 0]
        if batches is not None and len(done) >= batches:
            break
        if batches is None and done and q.recentProgress[-1].numInputRows == 0:
            break
        if batches is None and not done and len(q.recentProgress) > 5:
            break
        time.sleep(0.2)
    q.stop()
    assert q.exception() is None
    return len(done)


def test_killed_and_restarted(spark, tmp_path):
    """Stopped after two of six batches and started again: every version once, with the state of before."""
    own = commits.with_rocksdb(spark)
    rows = _versions()
    commits.write_versions(own.createDataFrame(rows, VERSIONS), str(tmp_path / "v"))
    _run(commits.commits(commits.version_stream(own, str(tmp_path / "v"))), str(tmp_path), batches=2)
    first = own.read.parquet(str(tmp_path / "out")).count()
    assert 0 < first < len(rows)
    again = commits.with_rocksdb(spark)
    _run(commits.commits(commits.version_stream(again, str(tmp_path / "v"))), str(tmp_path))
    got = sorted(tuple(r) for r in again.read.parquet(str(tmp_path / "out")).collect())
    assert got == _want(rows)


def test_reader_offsets():
    import json

    reader = commits._VersionReader({"files": json.dumps({"0": ["p0"], "2": ["p2", "q2"], "10": ["p10"]}), "batchesPerTrigger": "2"})
    assert reader.initialOffset() == {"after": -1} and reader.latestOffset() == {"after": 2}
    assert [p.url for p in reader.partitions({"after": -1}, {"after": 2})] == ["p0", "p2", "q2"]
    assert reader.latestOffset() == {"after": 10} and reader.latestOffset() == {"after": 10}
    # a new reader is told where the last run ended before it offers more
    fresh = commits._VersionReader({"files": json.dumps({"0": ["p0"], "2": ["p2"], "3": ["p3"]})})
    assert [p.url for p in fresh.partitions({"after": 0}, {"after": 2})] == ["p2"] and fresh.latestOffset() == {"after": 3}


def test_idle_paths_and_forgotten_files(spark, tmp_path):
    own = commits.with_rocksdb(spark)
    for i, batch in enumerate([[("a", 0, "x", "h")], [("b", 0, "x", "h")]]):
        commits.write_versions(own.createDataFrame(batch, VERSIONS), str(tmp_path / f"v{i}"))
    stream = commits.commits(commits.version_stream(own, str(tmp_path / "v0")), ttl_ms=60_000, idle_ms=300)
    q = stream.writeStream.format("memory").queryName("idle_paths").outputMode("append").option("checkpointLocation", str(tmp_path / "s")).trigger(processingTime="0 seconds").start()
    until = time.time() + 90
    while time.time() < until and own.table("idle_paths").filter("action = 'idle'").isEmpty():
        time.sleep(0.3)
    q.stop()
    assert sorted((r["path"], r["action"]) for r in own.table("idle_paths").collect()) == [("a", "baseline"), ("a", "idle")]
