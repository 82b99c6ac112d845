import difflib
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from graphtide.functions import diff as D
from graphtide.functions import text as X
from graphtide.plans import catalog, text_queries  # noqa: F401  the module registers its queries


def _lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_edit_scripts_are_minimal_and_rebuild_the_text():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(2))
        cost, out, at = 0, "", 0
        for i, n, j, m in D.middle_snake_edits(a, b):
            out, at, cost = out + a[at:i] + b[j:m], n, cost + n - i + m - j
        assert out + a[at:] == b
        assert cost == len(a) + len(b) - 2 * _lcs(a, b)
        old, new = " ".join(a), "  ".join(b)
        assert D.apply_edits(old, new, D.token_edits(old, new)) == new
        segments = D.char_segments(a, b)
        assert "".join(a[s[1] : s[2]] for s in segments) == a and "".join(b[s[3] : s[4]] for s in segments) == b


@pytest.mark.parametrize("table_bits", [1, 30, D.TABLE_BITS])
def test_scripts_by_rows_of_bits_are_minimal(table_bits):
    rng = random.Random(3)
    for k in range(400):
        a = rng.choices("abcd", k=rng.randint(0, 20))
        b = [x for x in a if rng.random() < 0.9] if k % 2 else rng.choices("abcde", k=rng.randint(0, 20))
        script, out, at = D.shortest_edits(a, b, table_bits), [], 0
        for i, n, j, m in script:
            out, at = out + a[at:i] + b[j:m], n
        assert out + a[at:] == b and all(x[1] < y[0] and x[3] < y[2] for x, y in zip(script, script[1:]))
        assert sum(n - i + m - j for i, n, j, m in script) == len(a) + len(b) - 2 * _lcs(a, b)


def test_texts_of_which_little_is_equal_do_not_cost_the_square_of_what_differs(monkeypatch):
    rounds = []
    middle = D._middle
    monkeypatch.setattr(D, "_middle", lambda *a: rounds.append(a[6:]) or middle(*a))
    rng = random.Random(4)
    old, new = (" ".join(rng.choices("abcdefghijklmnop", k=2000)) for _ in range(2))
    assert D.apply_edits(old, new, D.token_edits(old, new)) == new
    assert all(limit for limit in rounds)


def test_rows_of_one_turn_are_rebuilt_by_themselves(spark, tmp_path):
    rows = [(1, t, r, f"{t} {r} one two three"[: 30 - 7 * t]) for t in range(3) for r in ("assistant", "user")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalog.QUERIES["token_edit_scripts"](spark, str(tmp_path)).collect()
    want = [(1, x[1], hashlib.sha256(y[3].encode()).hexdigest()) for x, y in zip(rows, rows[1:])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_patches_apply_and_misfits_are_refused():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("\n".join(rng.choices("abcd", k=rng.randint(1, 9))) + "\n" for _ in range(2))
        patch = "".join(difflib.unified_diff(a.splitlines(True), b.splitlines(True), "o", "n"))
        assert D.apply_patch(a, patch) == b
    with pytest.raises(ValueError):
        D.apply_patch("x\n", "@@ -1 +1 @@\n-y\n+z\n")


def test_fold_patches(spark):
    bases = spark.createDataFrame([("d", "a\nb\nc\n")], "dir string, content string")
    diffs = ["@@ -1,3 +1,3 @@\n-a\n+A\n b\n c\n", "@@ -1,3 +1,2 @@\n A\n-b\n c\n"]
    patches = spark.createDataFrame([("d", i + 1, x) for i, x in enumerate(diffs)], "dir string, patch_index int, diff string")
    got = {r["patch_index"]: r["content"] for r in D.fold_patches(bases, patches).collect()}
    assert got == {1: "A\nb\nc\n", 2: "A\nc\n"}


def test_alignment():
    same = lambda x, y: 1.0 if x[0] == y[0] else 0.0
    assert D.align(["a1", "b1", "c1"], ["a1", "c2", "d1"], same) == [("keep", 0, 0), ("delete", 1, None), ("modify", 2, 1), ("insert", None, 2)]
    assert D.align([], ["x"], same) == [("insert", None, 0)]


def test_byte_offsets_and_slices(spark):
    df = spark.createDataFrame([(1, "é a\n\tb"), (2, ""), (3, None)], "id int, t string")
    rows = X.token_offsets(df, ["id"], "t").orderBy("id", "pos").collect()
    assert [(r["token"], r["start_byte"], r["end_byte"]) for r in rows] == [("é", 0, 2), (" ", 2, 3), ("a", 3, 4), ("\n\t", 4, 6), ("b", 6, 7)]
    assert [r["s"] for r in df.orderBy("id").select(X.node_source(F.col("t"), F.lit(0), F.lit(2)).alias("s")).collect()] == ["é", "", ""]
    assert [r["l"] for r in df.filter("id < 3").orderBy("id").select(X.line_starts(F.col("t")).alias("l")).collect()] == [[0, 5], [0]]


def test_uri_and_adjacent(spark):
    df = spark.createDataFrame([("ws://h",), ("wss://h:1/x",), ("http://h",), ("ws://a b",), (None,)], "u string")
    assert [r[0] for r in df.select(X.db_uri(F.col("u"))).collect()] == ["ws://h:8182", "ws://h:1", None, None, None]
    one = spark.range(1).select(X.adjacent_distinct(F.array(*map(F.lit, ["a", "a", "", "b", "a"]))).alias("x"))
    assert one.first()["x"] == ["a", "b", "a"]
