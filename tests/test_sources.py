import json
import subprocess

import pytest

from graphtide.sources import files, sinks


def test_worktree_and_listing(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.c").write_bytes(b"int x;\xff")
    (tmp_path / "a/y.h").write_text("h")
    (tmp_path / "z.c").write_text("z")
    f = files.worktree(spark, str(tmp_path), "*.c")
    assert sorted((r["path"].rsplit("/", 1)[1], r["n_bytes"]) for r in f.collect()) == [("x.c", 7), ("z.c", 1)]
    assert len({r["content_hash"] for r in f.collect()}) == 2
    every = files.worktree(spark, str(tmp_path))
    assert sorted(map(tuple, files.listing(every, str(tmp_path)).collect())) == [("a", True), ("z.c", False)]
    assert "int x;" in files.text(f.filter("n_bytes > 0")).first()["text"]
    with pytest.raises(Exception):  # noqa: B017
        files.worktree(spark, str(tmp_path / "none")).count()
    e = files.empty(spark).first()
    assert bytes(e["content"]) == b"" and e["n_bytes"] == 0


def test_git_source(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@x", "-C", str(tmp_path), *a], check=True, capture_output=True)
    git("init", "-q")
    for i, text in enumerate(["int a;", "int a;", "int b;"]):
        (tmp_path / "f.c").write_text(text)
        (tmp_path / "n.txt").write_text(str(i))
        git("add", ".")
        git("commit", "-qm", str(i))
    df = files.git(spark, str(tmp_path), commits=5)
    got = {r["step"]: bytes(r["content"]) for r in df.collect()}
    assert got == {0: b"int a;", 1: b"int a;", 2: b"int b;"}
    from pyspark.sql import functions as F

    steps = files.changed(df.withColumn("content_hash", F.sha2("content", 256)))
    assert sorted((r["step"], r["same"]) for r in steps.collect()) == [(0, 2), (2, None)]


def test_patches(spark, tmp_path):
    (tmp_path / "001_insert-decl_x_y.patch").write_text("@@\n+a\n")
    (tmp_path / "002_rename-local_v.patch").write_text("@@\n-a\n")
    got = sorted((r["patch_index"], r["op"], r["info"]) for r in files.patches(spark, str(tmp_path)).collect())
    assert got == [(1, "insert-decl", "x_y"), (2, "rename-local", "v")]
    (tmp_path / "002_add-comment_w.patch").write_text("@@\n")
    with pytest.raises(Exception, match="one index"):
        files.patches(spark, str(tmp_path)).collect()


def test_metrics_round_trip_and_older_columns(spark, tmp_path):
    head = "patch_name,edits_count,full_timings_ms,incremental_timings_ms,same,full_nodes,full_edges,incremental_nodes,incremental_edges,lines_changed"
    (tmp_path / "old.csv").write_text(head + '\n"a,b",3,0,x,1,5,6,5,6,2\n')
    r = files.metrics_csv(spark, str(tmp_path / "old.csv")).first()
    assert (r["patch_name"], r["incremental_timings_ms"], r["file_path"], r["repo"]) == ("a,b", None, None, "old")
    sinks.write_metrics_csv(files.metrics_csv(spark, str(tmp_path / "old.csv")).drop("repo"), str(tmp_path / "new"), ["patch_name"])
    assert files.metrics_csv(spark, str(tmp_path / "new")).first()["edits_count"] == 3


def test_benchmark_json(spark, tmp_path):
    one = [{"step": 1, "commit": "c", "files": [{"file": "a.c", "full_nodes": 4, "detailed_timings": {"text_diff_time_ms": 1.5}, "file_metrics": {"line_count": 9.0}}]}]
    (tmp_path / "benchmark_my_repo_fast.json").write_text(json.dumps(one))
    (tmp_path / "benchmark_other_slow.json").write_text("{ broken")
    rows, bad = files.benchmark_json(spark, str(tmp_path))
    r = files.flattened(rows, "detailed_timings", "timing", ["text_diff_time_ms"]).first()
    assert (r["repo"], r["tactic"], r["file"], r["timing_text_diff_time_ms"]) == ("my_repo", "fast", "a.c", 1.5)
    assert [x["name"] for x in bad.collect()] == ["benchmark_other_slow.json"]


GOLDEN = """======
First case
c
======
int a;

int b;
------
int a;
------
{0,6,(0,0),(1,-)}
======
Second
c
======
x
------
y
------
{0,1,(0,0),(0,1)}
"""


def test_golden(spark, tmp_path):
    (tmp_path / "g.txt").write_text(GOLDEN)
    t = files.golden_tests(spark, str(tmp_path / "g.txt")).orderBy("case_no")
    got = [(r["name"], r["lang"], r["original"], r["modified"]) for r in t.collect()]
    assert got == [("First case", "c", "int a;\nint b;\n", "int a;\n"), ("Second", "c", "x\n", "y\n")]
    ends = [(r["case_no"], r["end"], r["end_col"]) for r in files.expected_ranges(t).orderBy("case_no").collect()]
    assert ends == [(0, 6, None), (1, 1, 1)]


def test_sexp_lines(spark, tmp_path):
    text = '(Unit :canonical-id "1" :span "(0, 9)"\n  (-> SyntaxChild\n    (Function :canonical-id "2" :span "(1, 5)" :name "f"\n    )\n  )\n  (-> Back\n    Unit [visited "1"]\n  )\n)'
    (tmp_path / "g.sexp").write_text(text)
    rows = files.sexp_lines(spark, str(tmp_path / "g.sexp")).orderBy("line").collect()
    assert [(r["kind"], r["cid"], r["ref"]) for r in rows] == [("Unit", 1, None), ("SyntaxChild", None, None), ("Function", 2, None), ("Back", None, None), ("Unit", None, 1)]
