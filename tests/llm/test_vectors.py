"""Whitening, exact search and source divergence against brute force, over awkward tables."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphtide.llm import catalog, divergence, topk, tries, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def _vectors(n=230, d=6, seed=3):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.1 * (j + 1)) + (0.5 if i % 3 else 0) for j in range(d)], i % 4) for i in range(n)]
    same = rows[7][1]
    rows += [(n + i, list(same), 0) for i in range(60)]  # ties
    rows += [rows[5], rows[5], rows[50], (None, list(same), 1), (900, None, 1), (901, [0.1, None, 0.2, 0.1, 0.0, 0.3], 1), (950, [float("nan")] * d, 1), (951, [float("inf")] + [0.0] * (d - 1), 1)]
    return rows


def _good(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def _single(v):
    return [float(np.float32(c)) for c in v]


@pytest.fixture(scope="module")
def vectors():
    return [(i, _single(v) if _good(v) else v, c) for i, v, c in _vectors()]


@pytest.fixture(scope="module")
def folder(spark, vectors, tmp_path_factory):
    f = tmp_path_factory.mktemp("vectors")
    df = spark.createDataFrame(vectors, VECTORS)
    for name in ("score", "rank", "whitened", "deviation", "i", "q", "v", "__x"):
        df = df.withColumn(name, F.lit("clash"))
    df.repartition(7).write.parquet(f"{f}/embeddings.parquet")
    return f


def _whitened(vectors, components=8):
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v, _ in vectors if _good(v)], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True))) for row in x]
    centred = (x - s / n).astype(float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    return n, deviation, (centred @ u / np.sqrt(e))[:, :components], (e / e.sum())[:components]


def test_whitening_query(spark, folder, vectors):
    rows = catalog.QUERIES["op11_embedding_whitening"](spark, str(folder)).collect()
    n, deviation, white, explained = _whitened(vectors)
    good = [i for i, v, _ in vectors if _good(v)]
    assert len(rows) == n * min(8, white.shape[1]) and {r.n for r in rows} == {n}
    assert Counter(r.vec_id for r in rows) == Counter(i for i in good for _ in range(white.shape[1]))
    by = defaultdict(dict)
    for r in rows:
        by[r.vec_id][r.component] = r
    for k in range(white.shape[1]):
        sign = 1 if sum(by[i][k + 1].whitened * white[j, k] for j, i in enumerate(good)) > 0 else -1
        for j, i in enumerate(good):
            r = by[i][k + 1]
            assert r.whitened == pytest.approx(sign * white[j, k], abs=1e-8) and r.deviation == deviation[j]
            assert r.explained == pytest.approx(explained[k], rel=1e-9) and r.identity_error < 1e-9


def test_whitening_keeps_other_columns(spark, vectors):
    df = spark.createDataFrame(vectors, VECTORS).withColumn("deviation", F.lit(1)).withColumn("__k", F.lit("kept"))
    out = whitening.whiten(df, whitening.fit(df))
    assert out.columns == ["vec_id", "embedding", "label", "__k", "whitened", "deviation"]
    assert {r["__k"] for r in out.collect()} == {"kept"}


def test_whitening_of_little(spark):
    for rows, n in (([], 0), ([(1, None, 1), (2, [None], 1)], 0), ([(1, [1.0, 2.0], 1)], 1), ([(1, [1.0, 2.0], 1)] * 3 + [(2, [5.0], 1)], 3)):
        df = spark.createDataFrame(rows, VECTORS)
        out = whitening.whiten(df, whitening.fit(df)).collect()
        assert len(out) == n and all(r.whitened == [0.0, 0.0] and r.deviation == 0 for r in out)
    # two rows: one direction with variance, deviations beyond a long are exact
    df = spark.createDataFrame([(1, [1e9, 0.0], 1), (2, [-1e9, 0.0], 1)], VECTORS)
    found = whitening.fit(df)
    out = {r.vec_id: r for r in whitening.whiten(df, found).collect()}
    assert [abs(v) for v in out[1].whitened] == pytest.approx([1, 0]) and out[1].deviation == (2 * 1024 * 10**9) ** 2 and found.identity_error < 1e-9


def test_rotations_find_small_deviations():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 33):
        u, _ = np.linalg.qr(rng.normal(size=(200, d)))
        w, _ = np.linalg.qr(rng.normal(size=(d, d)))
        values = 10.0 ** -np.linspace(0, 9, d)
        turns, got = whitening.rotate(np.linalg.qr(u * values @ w.T, mode="r"))
        assert got == pytest.approx(values, rel=1e-6)
        assert np.abs(turns @ turns.T - np.eye(d)).max() < 1e-13


def test_many_triangles_meet(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=5).tolist(), 0) for i in range(400)], VECTORS).repartition(whitening.FAN + 9)
    assert whitening.fit(df).identity_error < 1e-10


def _first(rows, queries, k=5, scale=256):
    good = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if _good(v)]
    asked = {(i, tuple(v)) for i, v in queries if _good(v)}
    out = []
    for q, v in asked:
        x = [math.floor(scale * c) for c in v]
        scores = sorted(((-sum(a * b for a, b in zip(x, y, strict=False)), i is None, i or 0) for i, y in good if i is None or i != q))
        out += [(q, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(scores[:k])]
    return sorted(out, key=str)


def test_topk_query(spark, folder, vectors):
    rows = [tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in catalog.QUERIES["op12_exact_topk"](spark, str(folder)).collect()]
    pairs = [(i, v) for i, v, _ in vectors]
    assert sorted(rows, key=str) == _first(pairs, [(i, v) for i, v in pairs if i is not None and i % 50 == 0])


def test_topk_oracle(spark, tmp_path):
    rows = [r for r in _vectors(120) if r[0] is not None][:170]
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = [tuple(r[n] for n in ("query_id", "rank", "vec_id", "score")) for r in catalog.QUERIES["op12_exact_topk"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(c.sql(topk.ORACLE_SQL).fetchall())


@pytest.mark.parametrize("bins", [64, 512])
def test_topk_of_odd_vectors(spark, bins):
    rows = [(1, [0.5, 0.25, 1.0]), (2, [1.0]), (3, []), (4, [3e4, -3e4]), (4, [2e6, 2e6, 2e6]), (4, [0.5]), (None, [0.5, 0.25, 1.0]), (7, [1e300]), (8, [float("nan")]), (9, None), (10, [-1.0, -1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = [tuple(r) for r in topk.top_k(df, df, k=3, bins=bins, block_rows=3).collect()]
    pairs = [r for r in rows if r[0] != 7]
    assert sorted(got, key=str) == _first(pairs, pairs, k=3)
    none = df.filter("vec_id = 99")
    assert topk.top_k(none, df).count() == 0 and topk.top_k(df, none).count() == 0
    assert topk.top_k(df.filter("vec_id = 9"), df).count() == 0


def test_topk_sends_few_rows_for_many_ties(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3000)], "vec_id long, embedding array<float>").repartition(3)
    rows = topk.top_k(df.filter("vec_id = 100"), df).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(rows, key=lambda r: r["rank"])] == [(i + 1, i) for i in range(5)]


def _trie(words, group=lambda w: len(w) % 3):
    return tries.Trie.build(pa.array(words, pa.binary()), np.arange(len(words)), np.array([group(w) for w in words], np.int64), np.ones(len(words), np.int64), np.ones(len(words), np.int64))


def _leaves(t):
    ends = t.ends()
    return [(w.as_py(), {int(g): int(n) for g, n in zip(t.group[a:b], t.count[a:b], strict=True)}) for w, a, b in zip(t.terms, ends, ends[1:], strict=False)]


def test_trie_is_sorted_and_merges():
    rng = random.Random(5)
    words = ["".join(rng.choices("abü€𝄞", k=rng.randrange(0, 7))).encode() for _ in range(3000)] + [b"a" * 5000, b"a" * 4999]
    t, want = _trie(words), Counter(words)
    assert _leaves(t) == [(w, {len(w) % 3: n}) for w, n in sorted(want.items())]
    known = sorted(want)
    assert t.depth().tolist() == [0] + [len(os.path.commonprefix([a, b])) for a, b in zip(known, known[1:], strict=False)]
    for depth in (0, 1, 3, 6):
        pieces = list(t.pieces(depth))
        heads = [h for p in pieces for h in p.column(0).to_pylist()]
        assert heads == sorted({w[:depth] for w in words})
        twice = tries.Trie.merge([tries.Trie.of_pieces(p) for p in pieces + pieces])
        assert _leaves(twice) == [(w, {len(w) % 3: 2 * n}) for w, n in sorted(want.items())]
    low, high = t.cut(b"b")
    assert _leaves(low) + _leaves(high) == _leaves(t) and all(w < b"b" for w, _ in _leaves(low))
    assert len(tries.Trie.merge([])) == 0 and not list(tries.Trie.merge([]).pieces(3))


DOCS = "doc_id long, text string, lang string, source string, item string"


def _docs():
    rng = random.Random(9)
    vocab = ["alpha", "Beta", "be", "b", "ü", "über", "İz", "x1", "naïve", "中文", "a_b", "THE"] + [f"w{chr(97 + i)}" for i in range(14)]
    rows = []
    for i in range(420):
        words = rng.choices(vocab, weights=[1 + (i * j) % 5 for j in range(len(vocab))], k=rng.choice([0, 3, 20]))
        rows.append((i, " ".join(words), rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "ß", None, ""]), "clash"))
    rows += [(None, None, None, None, None), (1, None, "fr", "s9", None), (2, "", "fr", "s8", None), rows[3], rows[3], (5, "long Über " * 150_000, "en", "s0", None)]
    return rows


def _divergence(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        words = term.findall((text or "").translate(up))
        docs[lang or ""].update(set(words))
        counts[lang or "", source or ""].update(words)
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: c for (x, s), c in counts.items() if x == lang}

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q = shares(sum(own.values(), Counter()))
        p = {s: shares(c) for s, c in own.items()}
        for s in own:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s))
            marks = sorted(((q[t] - p[s][t], t.encode()) for t in kept if own[s][t] > 0 and p[s][t] > q[t]))[:top]
            for part, found in (("pair", pairs), ("term", marks)):
                out += [(lang, s, part, i.decode(), -v, r + 1) for r, (v, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("flush", "chunk", "heavy"), [(10, 100, 2000), (divergence.FLUSH, divergence.CHUNK, divergence.HEAVY)])
def test_divergence(spark, monkeypatch, flush, chunk, heavy):
    monkeypatch.setattr(divergence, "FLUSH", flush)
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "HEAVY", heavy)
    rows = _docs()
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    for least, top in ((30, 50), (1, 3), (10**6, 50)):
        got = [tuple(r) for r in divergence.divergence(df, least, top).collect()]
        assert sorted(got) == _divergence(rows, least, top)
    assert divergence.divergence(df.filter("doc_id = -1")).count() == 0


def test_divergence_query_and_oracle(spark, tmp_path):
    rows = _docs()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in catalog.QUERIES["op13_source_divergence"](spark, str(tmp_path)).collect())
    assert got == _divergence(rows, 30, 50)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(c.sql(divergence.ORACLE_SQL).fetchall()) == got


def test_slices_cut_no_term():
    text = ("über-all " * 300 + "x" * 500 + " end").encode()
    parts = [p.tobytes() for p in divergence.slices(np.frombuffer(text, np.uint8), 50)]
    assert b"".join(parts) == text and max(map(len, parts)) > 500
    term = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    assert [t for p in parts for t in term.findall(p)] == term.findall(text)


def test_shares_beyond_long():
    got = divergence.share(np.array([0, 10**10, 4 * 10**10]), 5 * 10**10, 3)
    assert got.tolist() == [1 + 10**9 * (c + 5) // (5 * 10**10 + 15) for c in (0, 10**10, 4 * 10**10)]
