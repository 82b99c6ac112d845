"""Extra columns under the names that the operators use inside, and one document in very many rows."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphtide.llm import decontaminate, langid, mixing, near_dedup, quality, secrets, substring_bytes, substring_words, toxicity, url_filter
from graphtide.llm.columns import free_name

HERE = Path(near_dedup.__file__).parent
#: Every name that begins with "_" in a string of the subpackage.
INSIDE = sorted({n for p in HERE.glob("*.py") for n in re.findall(r"[\"'.](__?[a-z][a-z_]*)[\"'.\[]", p.read_text())})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(i, f"{'the cat of the house is here and password = abcdefghijkl12 ' * 4} number {i % 7}" if i % 2 else f"das ist der Hund von dem Haus und die Katze {i % 5} " * 6, "en" if i % 2 else "de", f"s{i % 3}", 1) for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    return df.select("*", *(F.concat(F.lit(f"{c} "), F.col("doc_id")).alias(c) for c in INSIDE)).repartition(3).cache()


def _kept(df):
    for r in df.collect():
        for c in INSIDE:
            assert r[c] == f"{c} {r['doc_id']}", c


def test_names_are_found():
    assert {"__lo", "__t", "__text", "__mask", "__w", "__tokens"} <= set(INSIDE)


@pytest.mark.parametrize("name", ["langid", "secrets", "substring_bytes", "substring_words", "mixing", "toxicity", "quality", "decontaminate", "url_filter"])
def test_clashing_columns_are_kept(spark, docs, name):
    labels = spark.createDataFrame([(r[0], int(r[0] % 3 == 0)) for r in ROWS], "doc_id long, toxic int")
    out = {
        "langid": lambda: langid.predict(docs, langid.train(docs)),
        "secrets": lambda: secrets.scan(docs),
        "substring_bytes": lambda: substring_bytes.dedup(docs),
        "substring_words": lambda: substring_words.dedup(docs),
        "mixing": lambda: mixing.mix(docs),
        "toxicity": lambda: toxicity.score(docs, toxicity.train(docs, labels)),
        "quality": lambda: quality.judge(docs),
        "decontaminate": lambda: decontaminate.contamination(docs, docs.select(F.col("doc_id").alias("item_id"), "text").limit(3)),
        "url_filter": lambda: url_filter.filter_urls(docs.withColumn("url", F.lit("http://a.net/x"))),
    }[name]()
    assert out.count() == len(ROWS)
    _kept(out)


def test_a_column_with_an_inner_name_can_be_the_text(spark):
    df = spark.createDataFrame([(1, "x = password: abcdefghijklmno")], "doc_id long, __mask string")
    out = secrets.scan(df, text="__mask").first()
    assert out["__mask"].startswith("x = ") and out["secrets"]


def test_pipeline_keeps_clashing_columns(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of this occurs")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(INSIDE) <= set(out.columns)
    _kept(out)


def test_free_name(spark):
    assert free_name(spark.createDataFrame([(1, 2)], "a int, A_ int"), "a") == "a__"


def test_repeated_rows_make_one_link(spark, monkeypatch):
    """Two near copies, 1000 rows each: one pair of sets, one link."""
    words = [f"w{i}" for i in range(60)]
    near = [*words[:-1], "other"]
    rows = [(1, " ".join(words)), (2, " ".join(near))] * 1000
    seen = {}

    def watched(links):
        seen["links"] = links.count()
        return before(links)

    before = near_dedup.connected_components
    monkeypatch.setattr(near_dedup, "connected_components", watched)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = near_dedup.components(df, 3, 85, 100)
    assert seen["links"] == 1
    assert out.count() == 2000 and out.filter("component_id = 1").count() == 2000 and out.filter("kept").count() == 1000
