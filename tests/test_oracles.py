"""Every query with a SQL twin gives the same rows in Spark and in DuckDB over the smallest tables."""

import math
import re
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def _plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in SF.iterdir():
        c.sql(f"CREATE VIEW {f.name.removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return c


LLM = re.compile(r"op\d+_|pipeline$")
NAMES = sorted(n for n in entry.oracle_sql() if not LLM.match(n))


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, str(SF))
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=str)
    q = duck.sql(entry.oracle_sql()[name])
    assert sorted(q.columns) == cols
    want = sorted((tuple(map(_plain, r)) for r in q.select(*[f'"{c}"' for c in cols]).fetchall()), key=str)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_rows_only_queries(spark):
    for name in set(entry.queries()) - set(entry.oracle_sql()):
        if not LLM.match(name):
            assert entry.queries()[name](spark, str(SF)).count() > 0, name
