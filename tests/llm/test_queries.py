"""Every registered query of the subpackage over tables of awkward rows, and models against plain recomputation."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from graphtide.llm import catalog, decontaminate, kernels, langid, mixing, near_dedup, quality, secrets, toxicity

from .test_operators import DOCS, _components, _oracle, _repeats, _rows, _secrets

BENCH = [(1, "alpha Beta gamma, delta. the of x1 alpha Beta gamma, delta. the of x1 alpha"), (2, "x1"), (3, None), (3, "changed the of alpha"), (None, "of the of the")]


def _held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def rows():
    base = _rows(seed=5, n=70)
    # repeated rows, one id with two texts, a very long text, ties
    return base + [base[3], base[3], (4, "another text under a known id " * 12, "de", "s1", 360), (400, "alpha Beta gamma, delta. the of x1 " * 4000 + "password = abcdefghijklmnop", "en", "s0", 140000), (401, base[5][1], "de", "s1", 1)]


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    """Tables with columns that clash with results."""
    folder = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("score", "kept", "y", "u", "n_words", "secrets", "component_id", "__lo", "h"):
        docs = docs.withColumn(name, F.lit("clash"))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(r[0], 1, int("changed" in (r[1] or ""))) for r in rows] + [(None, 1, 1), (5, 0, None), (9999, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    urls = ["http://example.net/en/x", "HTTPS://Sub.Example.COM/de/", "x", None, "", "ftp://a.org/fr/?q", "http://b.net", "http://b.net"]
    spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_every_query_takes_awkward_rows(spark, tables, rows, name):
    out = catalog.QUERIES[name](spark, tables)
    got = out.collect()
    assert len(got) == (8 if name.startswith("op3") else len(rows))


def test_queries_with_sql_equal_it(spark, tables):
    views = {t: spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "benchmark", "pages")}
    for name in ("op2_secret_scan", "op9_quality_rules"):  # rows of one id are judged by themselves; the other twins group by id
        cols, want = _oracle(catalog.ORACLES[name], **{"documents": views["documents"].select("doc_id", "text", "lang", "source").filter("doc_id <> 3 AND doc_id <> 4")})
        got = sorted((tuple(r[c] for c in cols) for r in catalog.QUERIES[name](spark, tables).filter("doc_id <> 3 AND doc_id <> 4").collect()), key=str)
        assert got == want, name


def test_repeats_of_the_registered_queries(spark, tables, rows):
    pairs = [(r[0], r[1]) for r in rows]
    for name, units, glue in (("op7_substring_words", lambda t: (t or "").encode().split(), b" "), ("op5_substring_bytes", lambda t: (t or "").encode(), None)):
        want = []
        for i, u, gone in _repeats(pairs, units, 50):
            kept = glue.join(x for x, g in zip(u, gone, strict=True) if not g) if glue else bytes(x for x, g in zip(u, gone, strict=True) if not g)
            want.append((i, len(u), sum(gone), hashlib.sha256(kept).hexdigest()))
        size = "n_words" if glue else "n_bytes"
        assert sorted((r["doc_id"], r[size], r["n_removed"], r["kept_sha256"]) for r in catalog.QUERIES[name](spark, tables).collect()) == sorted(want)


def test_near_duplicates_of_rows_with_one_id(spark, tables, rows):
    """Rows that share an id are judged by their texts: each row's group is that of its text."""
    texts = [(k, r[1]) for k, r in enumerate(rows)]
    group = _components(texts, 3, 85, 100)
    least = {}
    for k, (n, g) in group.items():
        least[g] = min(least.get(g, math.inf), rows[k][0])
    want = sorted((rows[k][0], n, least[g] if n else rows[k][0]) for k, (n, g) in group.items())
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in catalog.QUERIES["op4_near_dedup"](spark, tables).collect()) == want


def test_near_duplicates_without_ids(spark):
    words = [f"w{i}" for i in range(60)]
    near = words[:59] + ["other"]
    df = spark.createDataFrame([(None, " ".join(words)), (None, " ".join(near)), (7, " ".join(near[1:])), (None, " ".join(words))], "doc_id long, text string")
    got = near_dedup.components(df, 3, 85, 100).collect()
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(7, False)] * 3


def test_common_values_are_counted_exactly(spark):
    """Values that many sets share are hot by their own count; others stay cold however many sets there are."""
    rng = np.random.default_rng(2)
    vocab = [f"v{i}" for i in range(4000)]
    texts = [" ".join(rng.choice(vocab, 40)) for _ in range(3000)]
    texts += [t + " tail" for t in texts[:200]] + ["one passage that is in a great many of the texts here " + t for t in texts[200:400]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = near_dedup.sketches(docs, 3).select(F.col("doc_id").alias("node"), "n", "sketch").cache()
    found = near_dedup._prefixes(nodes, 0.85).collect()
    lists = {}
    for r in nodes.collect():
        for v in r["sketch"][: near_dedup.INDEXED]:
            lists.setdefault(v, set()).add(r["node"])
    assert found and all(len(lists[r["value"]]) > 1 and r["hot"] == (len(lists[r["value"]]) >= near_dedup.HOT) for r in found)
    assert sum(r["hot"] for r in found) < 0.2 * len(found)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.components(docs, 3, 85, 100).collect()}
    missed = sum(got[3000 + k] != got[k] for k in range(200))
    print(f"recall of 200 planted near copies: {1 - missed / 200}")
    assert missed == 0


def test_language_id_against_plain_compression(spark, tables, rows):
    got = {(r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 12)) for r in catalog.QUERIES["op1_language_id"](spark, tables).collect()}
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    models = langid.train(docs.select("doc_id", "text", "lang").filter(~langid.held_out()))
    assert {m[0] for m in models} == {r[2] for r in rows if r[2] and not _held(r[0]) and re.search(r"[^\W\d_]", r[1] or "")}
    want = set()
    for i, text, *_ in rows:
        letters = re.sub(r"[^\W\d_]+", "", text or "") != (text or "")
        folded = re.sub(r"(?:[\W\d_]|̇)+", " ", (text or "").lower()).encode()
        if not letters:
            want.add((i, _held(i), "und", 0.0))
            continue
        sizes = []
        for _, content in models:
            params = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, min_match=4, strategy=zstandard.STRATEGY_DFAST, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
            sizes.append(sum(len(pack.compress(folded[k : k + langid.CHUNK_BYTES])) for k in range(0, len(folded), langid.CHUNK_BYTES)))
        best = sizes.index(min(sizes))
        rest = sizes[:best] + sizes[best + 1 :]
        want.add((i, _held(i), models[best][0], round(1 - sizes[best] / min(rest) if rest else 1.0, 12)))
    assert got == want


def test_equal_sizes_go_to_the_most_frequent_language(spark):
    text = "same words in both languages"
    rows = [(i, text, "bb" if i % 3 else "aa") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = [("bb", b"x"), ("aa", b"x")]
    assert {(r["lang_pred"], r["rejected"]) for r in langid.predict(df, models).collect()} == {("bb", True)}


def _chain(model, emission):
    """P(toxic) of each token by plain forward-backward; emission: log potential of state toxic, the other word's where there is none."""
    n = len(emission)
    a, b = np.zeros((n, 2)), np.ones((n, 2))
    for k in range(n):
        e = np.exp(np.array([0.0, emission[k]]))
        a[k] = (np.exp(model.start) if k == 0 else a[k - 1] @ np.exp(model.move)) * e
        a[k] /= a[k].sum()
    for k in range(n - 2, -1, -1):
        b[k] = np.exp(model.move) @ (np.exp(np.array([0.0, emission[k + 1]])) * b[k + 1])
        b[k] /= b[k].sum()
    p = a * b
    return (p / p.sum(1, keepdims=True))[:, 1]


def test_toxicity_against_a_plain_chain(spark):
    rng = np.random.default_rng(4)
    clean = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    data = []
    for i in range(500):
        w = list(rng.choice(clean, rng.integers(5, 40)))
        if i % 4 == 0:
            w[rng.integers(len(w))] = "Vile"
            w.insert(0, "é foul")
        data.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int").withColumns({"y": F.lit(1), "u": F.lit(2.0), "score": F.lit("clash")})
    labels = df.select("doc_id", "toxic", F.lit("clash").alias("__y"))
    model = toxicity.train(df.drop("toxic"), labels)
    weight = dict(zip(model.codes.tolist(), model.weight.tolist(), strict=True))
    assert len(weight) >= 2
    for r in toxicity.score(df, model).collect():
        found = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z\u0080-\U0010FFFF]+", r["text"])]
        code = [kernels.span_codes(b := np.frombuffer(r["text"][s:e].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode(), np.uint8), np.array([0]), np.array([len(b)]))[0] for s, e in found]
        p = _chain(model, [weight.get(int(c), model.other) for c in code])
        hit = [k for k, c in enumerate(code) if int(c) in weight]
        top, total = max((p[k] for k in hit), default=0.0), sum(p[k] for k in hit)
        q = 1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * top + model.curve[2] * math.log1p(total))))
        assert r["score"] == pytest.approx(q, abs=1e-9) and r["predicted"] == int(q >= 0.5)
        assert r["spans"] == ",".join(f"{found[k][0]}:{found[k][1]}" for k in hit if p[k] >= toxicity.SPAN_MARGINAL)


def test_training_texts_stop_at_the_byte_bound(spark, monkeypatch):
    df = spark.createDataFrame([(i, "x" * 1000, i % 2) for i in range(40)], "doc_id long, text string, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 10_500)
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: seen.append(texts) or toxicity.Model(*[np.zeros(0)] * 2, 0.0, np.zeros(2), np.zeros((2, 2)), np.zeros(3)))
    toxicity.train(df, df.select("doc_id", "toxic"))
    assert len(seen[0]) == 10


def test_secrets_of_many_matches(spark):
    text = "é " + " ".join(f"{k:016x}" for k in range(3000))
    df = spark.createDataFrame([(1, text), (1, text), (2, "0123456789abcdef" * 3)], "doc_id long, text string")
    for r in secrets.scan(df.withColumn("secrets", F.lit("clash"))).collect():
        assert [(s["start"], s["ord"], s["kind"], s["stop"]) for s in r["secrets"]] == _secrets(r["text"])


def test_both_ways_of_the_decontamination(spark, tables, monkeypatch):
    docs, items = spark.read.parquet(f"{tables}/documents.parquet"), spark.createDataFrame(BENCH, "item_id long, text string")
    cols = ["doc_id", "n_words", "n_hit", "item_ids", "contaminated"]
    one = sorted((str(tuple(r[c] for c in cols)) for r in decontaminate.contamination(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert sorted((str(tuple(r[c] for c in cols)) for r in decontaminate.contamination(docs, items).collect())) == one


def test_targets_of_a_mix(spark):
    rows = [(i, "word " * (1 + i % 9), ("en", "de")[i % 2], ("a", "b", "c")[i % 3]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = {"source": {"a": 0.6, "b": 0.3, "c": 0.1, "absent": 0.5}, "lang": {"en": 3.0, "de": 1.0}}
    targets = {d: spark.createDataFrame([(v, s / 2) for v, s in t.items()] * 2, "value string, share double") for d, t in want.items()}
    cells = mixing.cells_of(docs).groupBy("__source", "__lang", "__topic").agg(F.sum("__tokens").alias("tokens"))
    raked = mixing.calibrate(cells, targets).cache()
    total = raked.agg(F.sum("tokens")).first()[0]
    for d, t in want.items():
        live = {v: s for v, s in t.items() if v != "absent"}
        for r in raked.groupBy(f"__{d}").agg(F.sum(F.col("tokens") * F.col("factor")).alias("w")).collect():
            assert r["w"] / total == pytest.approx(live[r[f"__{d}"]] / sum(live.values()), rel=1e-8)
    odd = spark.createDataFrame([(1, "x y", "en", "a"), (2, "x y z", "de", "b")], "doc_id long, text string, lang string, source string")
    with pytest.raises(ValueError, match="contradict"):
        mixing.mix(odd, {"lang": spark.createDataFrame([("en", 0.9), ("de", 0.1)], "value string, share double")})


def test_the_pipeline_takes_awkward_rows(spark, tables, rows):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables).cache()
        assert name == "mixing" or out.columns == docs.columns, name
        assert out.count() <= docs.count()
        docs = out
    assert corpus_pipeline.run(spark, tables).count() == docs.count()


def test_quality_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "ok words here, fine. " * 20)] * 3, "doc_id long, text string")
    assert quality.judge(df).distinct().count() == 1 and quality.judge(df).count() == 3


def test_packed_columns_come_back():
    from graphtide.llm import windows as W

    rng = np.random.default_rng(1)
    for kind in (np.uint64, np.int64, np.int32):
        for n in (0, 1, 7):
            x = rng.integers(-(2**31), 2**31 - 1, n).astype(kind)
            back, at = W._planed(memoryview(b"head" + W.planes(x)), 4, n, kind)
            assert (back == x).all() and at == 4 + n * np.dtype(kind).itemsize
    batches = [pa.RecordBatch.from_arrays([pa.array([1, 1, 2]), pa.array([b"a", b"b", b"c"], pa.binary())], names=["k", "b"]), pa.RecordBatch.from_arrays([pa.array([2, 3]), pa.array([b"d", b"e"], pa.binary())], names=["k", "b"])]
    assert [(k, [bytes(r[0]) for r in rows]) for k, rows in W._runs(iter(batches))] == [(1, [b"a", b"b"]), (2, [b"c", b"d"]), (3, [b"e"])]
