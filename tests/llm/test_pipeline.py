"""The pipeline against the same stages in plain Python over a small table."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


from .test_operators import _components, _secrets

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def _windows(text):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return w


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [_windows(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "secret_scan", "mixing"]
    stage = dict(corpus_pipeline.STAGES)
    one = stage["language_id"](spark, docs, str(SF)).cache()
    assert one.columns == docs.columns and one.count() >= 0.95 * docs.count()
    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    two = stage["near_dedup"](spark, one, str(SF)).cache()
    want = {i for i, (_, c) in _components(rows, 5, 80, 100).items() if i == c}
    assert {r["doc_id"] for r in two.collect()} == want and two.columns == docs.columns
    grams = {}
    for w in bench:
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(n, set()).add(tuple(w[k : k + n]))
    clean = set()
    for r in two.collect():
        w = _windows(r["text"])
        hit = set()
        for n, g in grams.items():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in g:
                    hit.update(range(k, k + n))
        if not hit or 20 * len(hit) < len(w):
            clean.add(r["doc_id"])
    three = stage["decontamination"](spark, two, str(SF)).cache()
    assert {r["doc_id"] for r in three.collect()} == clean and three.columns == docs.columns
    four = stage["secret_scan"](spark, three, str(SF)).cache()
    before = {r["doc_id"]: r["text"] for r in three.collect()}
    for r in four.collect():
        spans = _secrets(before[r["doc_id"]])
        out, at = [], 0
        for start, _, kind, stop in spans:
            if start >= at:
                out += [before[r["doc_id"]][at:start], f"<{kind}>"]
            at = max(at, stop)
        assert r["text"] == "".join([*out, before[r["doc_id"]][at:]]) and r["n_chars"] == len(r["text"])
    five = stage["mixing"](spark, four, str(SF))
    assert {r["doc_id"] for r in five.collect()} <= clean
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(SF)).collect()) == sorted(r["doc_id"] for r in five.collect())


def test_stages_take_nulls_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).unionByName(docs.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]))
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, odd, str(SF)).count() <= 4, name
        assert f(spark, docs.limit(0), str(SF)).count() == 0, name
