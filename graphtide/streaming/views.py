"""Aggregates that are stored and kept up to date by a feed of signed changes.

A change is a row with a sign: 1 comes, -1 goes; an update is both. Counts and sums follow by addition. A minimum or
maximum follows too, unless the value that goes may be the one that holds it: then, and only then, its group is computed
again from the log of changes. State and log are dealt into buckets by the keys; a batch rewrites the buckets that it
touches and leaves all others where they are.

Every batch has an epoch. It is written whole before the manifest of its epoch names it, and an epoch that has a manifest
is not applied again: a batch that is retried after a failure counts once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.runtime import cut, exists, listed


class View:
    """Stored aggregates by keys: n, the sums and the least and greatest values of columns, each named by its result."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], sums: dict[str, str] | None = None, least: dict[str, str] | None = None, greatest: dict[str, str] | None = None, buckets: int = 32):
        self.spark, self.folder, self.keys, self.buckets = spark, folder, keys, buckets
        self.sums = sums or {}
        self.ends = {name: (c, F.min, F.least) for name, c in (least or {}).items()} | {name: (c, F.max, F.greatest) for name, c in (greatest or {}).items()}
        self._of = sorted({*self.sums.values(), *(c for c, _, _ in self.ends.values())})

    def epochs(self) -> list[int]:
        """The epochs that are applied."""
        return sorted(int(e) for e in listed(self.spark, f"{self.folder}/manifest") if exists(self.spark, f"{self.folder}/manifest/{e}/_SUCCESS"))

    def _manifest(self, epoch: int) -> dict[int, int]:
        """bucket -> the epoch that wrote it last."""
        return {r.bucket: r.epoch for r in self.spark.read.parquet(f"{self.folder}/manifest/{epoch}").collect()}

    def read(self) -> DataFrame:
        """The keys, n and the aggregates, as of the last epoch."""
        done = self.epochs()
        if not done:
            raise ValueError("no batch is applied yet")
        return self._state(self._manifest(done[-1])).drop("bucket")

    def _state(self, where: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/state/epoch={epoch}/bucket={b}" for b, epoch in sorted(where.items())]
        return self.spark.read.option("basePath", f"{self.folder}/state").parquet(*paths).drop("epoch") if paths else self.spark.read.parquet(f"{self.folder}/empty")

    def _log(self, buckets: list[int]) -> DataFrame:
        """All changes of some buckets so far."""
        paths = [f"{self.folder}/log/{e}" for e in listed(self.spark, f"{self.folder}/log") if exists(self.spark, f"{self.folder}/log/{e}/_SUCCESS")]
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(p) for p in paths]).filter(F.col("bucket").isin(buckets))

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """A foreachBatch function: batch has the keys, the columns and sign."""
        done = self.epochs()
        if done and epoch <= done[-1]:
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        batch.select(*self.keys, *self._of, F.col("sign").cast("int").alias("sign"), bucket.alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/log/{epoch}")
        rows = self.spark.read.parquet(f"{self.folder}/log/{epoch}")
        comes = lambda c: F.when(F.col("sign") > 0, F.col(c))
        goes = lambda c: F.when(F.col("sign") < 0, F.col(c))
        aggs: list[Column] = [F.sum("sign").cast("long").alias("d_n")]
        aggs += [F.sum(F.col(c) * F.col("sign")).alias(f"d_{name}") for name, c in self.sums.items()]
        for name, (c, end, _) in self.ends.items():
            aggs += [end(comes(c)).alias(f"in_{name}"), end(goes(c)).alias(f"out_{name}")]
        delta = cut(rows.groupBy("bucket", *self.keys).agg(*aggs))
        where = self._manifest(done[-1]) if done else {}
        touched = sorted(r.bucket for r in delta.select("bucket").distinct().collect())
        new = self._merged(delta, {b: where[b] for b in touched if b in where}, touched)
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/state/epoch={epoch}")
        written = {int(d.removeprefix("bucket=")) for d in listed(self.spark, f"{self.folder}/state/epoch={epoch}") if d.startswith("bucket=")}
        # a bucket whose last group went has no file and leaves the manifest
        where = {b: e for b, e in where.items() if b not in touched} | dict.fromkeys(written, epoch)
        if not exists(self.spark, f"{self.folder}/empty/_SUCCESS"):
            new.limit(0).write.mode("overwrite").parquet(f"{self.folder}/empty")
        self.spark.createDataFrame(sorted(where.items()), "bucket int, epoch long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{epoch}")

    def _merged(self, delta: DataFrame, where: dict[int, int], touched: list[int]) -> DataFrame:
        key = ["bucket", *self.keys]
        on = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"d.{k}")) for k in key])
        named = [F.coalesce(f"d.{k}", f"o.{k}").alias(k) for k in key]
        if where:
            both = self._state(where).alias("o").join(delta.alias("d"), on, "full")
            old = lambda c: F.col(f"o.{c}")
        else:
            both, named = delta.alias("d"), [F.col(f"d.{k}").alias(k) for k in key]
            old = lambda c: F.lit(None)
        added = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        out = [*named, added(old("n"), F.col("d.d_n")).cast("long").alias("n")]
        out += [added(old(name), F.col(f"d.d_{name}")).alias(name) for name in self.sums]
        lost = F.lit(False)
        for name, (_, _, pick) in self.ends.items():
            held = pick(old(name), F.col(f"d.in_{name}")) if where else F.col(f"d.in_{name}")
            out.append(held.alias(name))
            gone = F.col(f"d.out_{name}")
            # what goes is at or beyond the end that was held
            lost = lost | (gone.isNotNull() & (pick(gone, held) == gone))
        merged = both.select(*out, F.coalesce(lost, F.lit(False)).alias("lost"))
        bad = F.raise_error(F.lit("more rows go than have come"))
        merged = cut(merged.withColumn("n", F.when(F.col("n") < 0, bad).otherwise(F.col("n"))).filter("n > 0"))
        self.recomputed = merged.filter("lost").count()
        if not self.recomputed:
            return merged.drop("lost")
        asked = merged.filter("lost").select(*self.keys)
        same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"q.{k}")) for k in self.keys])
        left = self._log(touched).alias("l").join(asked.alias("q"), same, "left_semi").groupBy("bucket", *self.keys, *self._of).agg(F.sum("sign").alias("times")).filter("times > 0")
        again = left.groupBy("bucket", *self.keys).agg(*[end(c).alias(name) for name, (c, end, _) in self.ends.items()])
        kept = merged.filter("NOT lost").drop("lost")
        on = reduce(lambda a, b: a & b, [F.col(f"m.{k}").eqNullSafe(F.col(f"a.{k}")) for k in key])
        redone = merged.filter("lost").alias("m").join(again.alias("a"), on)
        return kept.unionByName(redone.select(*[F.col(f"{'a' if c in self.ends else 'm'}.{c}").alias(c) for c in kept.columns]))


def edge_counts(spark: SparkSession, folder: str) -> View:
    """How many edges of each type leave a node."""
    return View(spark, folder, ["graph_id", "src", "edge_type"])


def inboxes(spark: SparkSession, folder: str) -> View:
    """Messages combined for each target: their number, sum, least and greatest."""
    return View(spark, folder, ["id"], {"total": "message"}, {"least": "message"}, {"greatest": "message"})
