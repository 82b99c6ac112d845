"""Mixing sources to target weights by iterative proportional fitting; built-in functions only.

Token counts are summed into cells of (source, language, topic). Each round rakes the cell weights to the target
marginals of one dimension after the other: a factor for each value of a dimension is the target over the current
sum. The factors, not the documents, are what the rounds pass on. A document's probability is its cell's factor
over the largest one, and a hash of its id decides, so that the kept tokens have the target marginals in the mean.

Targets are tables (value, share), one for each dimension; damped_targets makes them from the documents where none are given: shares of the
tokens raised to `power`, so that large values lose and small ones gain. Shares are normalised over the values that have
tokens. Rounds go on until every marginal is its target within TOLERANCE; targets that contradict each other (their cells
have no documents) raise an error. Defined results: a null source or language is the value "<null>"; null and empty texts
count no token and keep their probability; rows with equal id share their fate; an empty table gives an empty
one; a value without tokens has factor 1; a dimension value missing from a given target table has share 0, and of repeated values the
shares add up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphtide.llm.columns import guarded
from graphtide.runtime import cut, table

DIMENSIONS = ("source", "lang", "topic")
#: Rounds between two looks at the marginals (a plan of many rounds grows too deep), and at most.
ROUNDS, MAX_ROUNDS = 8, 400
#: Largest relative distance of a marginal from its target.
TOLERANCE = 1e-9
POWER = 0.5
#: A cell table up to so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
#: Strings that put a text into a topic class; the first class that has one of its strings wins.
TOPICS = (
    ("legal", ("icense", "opyright", "ights reserved")),
    ("contact", ("@",)),
    ("markup", ("|", "###", "$$$", "%%%", "&&&", "***")),
)


def topic(text: Column) -> Column:
    """The topic class of a text: legal, contact, markup or prose."""
    out = F
    for name, strings in TOPICS:
        out = out.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in strings]), name)
    return out.otherwise("prose")


def token_count(text: Column) -> Column:
    """Pieces between spaces and line ends; 0 for an empty text."""
    marks = sum((F.length(text) - F.length(F.replace(text, F.lit(x), F.lit(""))) for x in (" ", "\n")), F.lit(1))
    return F.when(F.length(text) == 0, 0).otherwise(marks).cast("long")


def cells_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with s, l, t (the cell) and tokens."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns(
        {
            "__source": F.coalesce(F.col("source").cast("string"), F.lit("<null>")),
            "__lang": F.coalesce(F.col("lang").cast("string"), F.lit("<null>")),
            "__topic": topic(t),
            "__tokens": token_count(t),
        }
    )


def damped_targets(cells: DataFrame, power: float = POWER) -> dict[str, DataFrame]:
    """For each dimension (value, share): the tokens of the value raised to power."""
    share = lambda d: cells.groupBy(F.col(f"__{d}").alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("share"))
    return {d: share(d) for d in DIMENSIONS}


def _goals(cells: DataFrame, targets: DataFrame, d: str) -> DataFrame:
    """(the dimension, g): the tokens that each value of it with tokens shall have."""
    given = targets.groupBy(F.col("value").cast("string").alias(d)).agg(F.sum(F.col("share").cast("double")).alias("share"))
    have = cells.groupBy(d).agg(F.sum("tokens").alias("n")).filter("n > 0").join(given, d, "left").select(d, "n", F.coalesce("share", F.lit(0.0)).alias("share"))
    both = have.agg(F.sum("n").alias("tokens"), F.sum("share").alias("shares"))
    return cut(have.crossJoin(F.broadcast(both)).select(d, F.try_divide(F.col("share") * F.col("tokens"), F.col("shares")).alias("g")))


def calibrate(cells: DataFrame, targets: dict[str, DataFrame] | None = None, power: float = POWER) -> DataFrame:
    """cells (__source, __lang, __topic, tokens) with factor: the product of the raked factors."""
    dims = [f"__{d}" for d in DIMENSIONS]
    cells = cut(cells)
    targets = damped_targets(cells, power) | (targets or {})
    goals = {d: _goals(cells, targets[d[2:]], d) for d in dims}
    now = lambda d: F.sum(F.col("tokens") * F.col("factor")).over(Window.partitionBy(d))
    raked = cells.withColumn("factor", F.lit(1.0))
    for _ in range(0, MAX_ROUNDS, ROUNDS):
        for _ in range(ROUNDS):
            for d in dims:
                # cells, not documents, are windowed: a window holds the combinations of the other dimensions
                raked = raked.withColumn("now", now(d)).join(goals[d], d, "left")
                step = F.when(F.col("now") > 0, F.coalesce("g", F.lit(0.0)) / F.col("now")).otherwise(1.0)
                raked = raked.select(*dims, "tokens", (F.col("factor") * step).alias("factor"))
        raked = cut(raked)
        far = F.abs(F.sum(F.col("tokens") * F.col("factor")) - F.max("g")) / F.greatest(F.max("g"), F.lit(1.0))
        off = [raked.join(goals[d], d).groupBy(d).agg(far.alias("far")).agg(F.max("far")).first()[0] or 0.0 for d in dims[:-1]]  # the last one was raked last
        if max(off) <= TOLERANCE:
            return raked
    raise ValueError(f"the targets contradict each other: after {MAX_ROUNDS} rounds a marginal is off by {max(off):.2g} of its target")


def unit(doc_id: Column) -> Column:
    """A value in [0, 1) for each id, the same wherever it is computed."""
    return F.conv(F.substring(F.sha2(F.coalesce(doc_id.cast("string"), F.lit("null")), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)


@guarded
def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, doc_id: str = "doc_id", text: str = "text", power: float = POWER) -> DataFrame:
    """docs with __source, __lang, __topic, __tokens, probability and kept."""
    held = cells_of(docs.drop("probability", "kept"), text)
    dims = [f"__{d}" for d in DIMENSIONS]
    raked = calibrate(held.groupBy(*dims).agg(F.sum("__tokens").alias("tokens")), targets, power)
    top = raked.agg(F.max("factor").alias("top"), F.count("*").alias("n")).first()
    p = raked.select(*dims, F.round(F.col("factor") / F.lit(float(top["top"] or 1.0)), 9).alias("probability"))
    out = held.join(F.broadcast(p) if top["n"] <= BROADCAST_ROWS else p, dims)
    return out.withColumn("kept", unit(F.col(doc_id)) < F.col("probability"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), F.round("probability", 6).alias("probability"), "kept")


#: Rounds of the SQL twin: many more than the test tables need.
SQL_ROUNDS = 60


def _sql() -> str:
    """The same rounds, unrolled."""
    out = [
        "WITH d AS (SELECT doc_id, coalesce(source, '<null>') AS source, coalesce(lang, '<null>') AS lang, CASE "
        + " ".join("WHEN " + " OR ".join(f"contains(coalesce(text, ''), '{x}')" for x in strings) + f" THEN '{name}'" for name, strings in TOPICS)
        + " ELSE 'prose' END AS topic, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE 1 + length(text) - length(replace(text, ' ', '')) + length(text) - length(replace(text, chr(10), '')) END AS BIGINT) AS n_tokens FROM documents), "
        "c0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CAST(1 AS DOUBLE) AS factor FROM d GROUP BY ALL)"
    ]
    for dim in DIMENSIONS:
        out.append(f"g_{dim} AS MATERIALIZED (SELECT {dim}, sqrt(n) / sum(sqrt(n)) OVER () * (SELECT sum(tokens) FROM c0) AS g FROM (SELECT {dim}, sum(tokens) AS n FROM c0 GROUP BY 1) WHERE n > 0)")
    k = 0
    for _ in range(SQL_ROUNDS):
        for dim in DIMENSIONS:
            out.append(
                f"c{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, factor * CASE WHEN now > 0 THEN coalesce(g, 0) / now ELSE 1 END AS factor FROM "
                f"(SELECT *, sum(tokens * factor) OVER (PARTITION BY {dim}) AS now FROM c{k}) LEFT JOIN g_{dim} USING ({dim}))"
            )
            k += 1
    out.append(f"p AS (SELECT source, lang, topic, round(factor / (SELECT max(factor) FROM c{k}), 9) AS probability FROM c{k})")
    return ", ".join(out) + (
        " SELECT doc_id, source, lang, topic, n_tokens, round(probability, 6) AS probability, CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0 < probability AS kept "
        "FROM d JOIN p USING (source, lang, topic)"
    )


ORACLE_SQL = _sql()
