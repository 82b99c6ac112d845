"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of bounded size; a block is broadcast and scored against every candidate. Nothing but
counts leaves a task: per query, a histogram of its scores over BINS equal bins of a range that surely holds the kth
score. The bins' counts are added up over all tasks, the bin with the kth score becomes the next range, and rounds go
on until that range is one score. A last pass sends what lies above it, and of those equal to it the smallest ids.

A task leaves out the bins below the one that holds its own kth score (there are k better ones in this task alone), so
it sends at most k bins a query and round, and at most k rows a query in the last pass, however many scores are tied.

Defined results: vectors that are null, or hold a null or non-finite entry, take no part, nor those whose floored
entries have a square sum of 2^62 or more (no score of theirs is sure to fit a long). Vectors of unequal length are
multiplied as far as both reach. A candidate with the query's id is the query's own row; a null id is nobody's own and
comes last among ties. Repeated rows are candidates each; a query repeated with the same id and vector is asked once. Empty
tables and fewer than k candidates give fewer rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphtide.llm.vectors import Lists
from graphtide.runtime import Shelf, small_batches, table

#: Fixed values of the query: results a query, factor of the entries, every EACHth id is a query.
K, SCALE, EACH = 5, 256, 50
#: Bins of a histogram; a range of 2^62 scores is one score after seven rounds.
BINS = 512
#: A block of queries: at most so many, and about so many bytes of entries.
QUERIES, QUERY_BYTES = 2048, 8 << 20
#: Queries and candidates that are multiplied at once.
TILE = 512, 2048
_NONE = np.iinfo(np.int64).min


@dataclass
class Block:
    """A block of queries and, of each, the range [low, low + span) with the kth score and how many are still wanted in it."""

    ids: np.ndarray
    null_id: np.ndarray
    x: np.ndarray
    low: np.ndarray
    span: np.ndarray
    want: np.ndarray
    most: int
    bins: int

    def width(self) -> np.ndarray:
        return -(-self.span // self.bins)


def _whole(column: pa.Array | pa.ChunkedArray, scale: int, width: int | None = None) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Rows that take part, their floored entries (width, or the longest), and an upper bound of their square sums."""
    lists = Lists(column)
    x = lists.floors(scale, float(1 << 31))
    squares = np.concatenate([[0.0], np.cumsum(x.astype(np.float64) ** 2)])
    # the running sums are inexact only where entries are huge; those rows are summed again by themselves
    sums = squares[lists.off[1:]] - squares[lists.off[:-1]]
    if squares[-1] >= 2.0**53:
        sums = np.array([float(sum(v * v for v in x[a:b].tolist())) for a, b in zip(lists.off[:-1], lists.off[1:], strict=True)])
    rows = np.flatnonzero(lists.whole & (sums < 2.0**62))
    width = int(lists.lengths[rows].max(initial=0)) if width is None else width
    return rows, lists.matrix(x, rows, width), [int(v) + 1 for v in sums[rows]]


def _scores(block: Block, batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first query, scores of queries by candidates, candidate ids, which of them are null); own rows score _NONE."""
    order = np.argsort(block.ids, kind="stable")
    order = order[~block.null_id[order]]
    known = block.ids[order]
    left = block.x.astype(np.float64) if block.most < 1 << 53 else block.x
    for batch in batches:
        ids = batch.column(0)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        rows, x, _ = _whole(batch.column(1), scale, block.x.shape[1])
        for at in range(0, len(rows), TILE[1]):
            part = rows[at : at + TILE[1]]
            right = x[at : at + TILE[1]].T.astype(left.dtype)
            here, here_null = ids[part], null[part]
            lo, hi = np.searchsorted(known, here, side="left"), np.searchsorted(known, here, side="right")
            own = [(q, c) for c in np.flatnonzero((hi > lo) & ~here_null) for q in order[lo[c] : hi[c]]]
            for q0 in range(0, len(left), TILE[0]):
                s = (left[q0 : q0 + TILE[0]] @ right).astype(np.int64)
                for q, c in own:
                    if q0 <= q < q0 + len(s):
                        s[q - q0, c] = _NONE
                yield q0, s, here, here_null


def _count(block: Block, scale: int):
    """mapInArrow function: the counts of each query's bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nb = block.bins
        counts, width = np.zeros((len(block.x), nb), dtype=np.int64), block.width()
        floor, top = block.low.copy(), block.low + (block.span - 1)
        for q0, s, _, _ in _scores(block, batches, scale):
            q1 = q0 + len(s)
            q, c = np.nonzero((s >= floor[q0:q1, None]) & (s <= top[q0:q1, None]))
            if not len(q):
                continue
            bins = (s[q, c] - block.low[q0 + q]) // width[q0 + q]
            counts[q0:q1] += np.bincount(q * nb + bins, minlength=len(s) * nb).reshape(-1, nb)
            # from here on only what is not below this task's own kth score matters
            some = np.unique(q)
            above = np.cumsum(counts[q0 + some, ::-1], axis=1) >= block.want[q0 + some, None]
            full = above.any(axis=1)
            some, above = q0 + some[full], above[full]
            kth = nb - 1 - np.argmax(above, axis=1)
            floor[some] = block.low[some] + kth * width[some]
        first = (floor - block.low) // width
        q, b = np.nonzero((counts > 0) & (np.arange(nb) >= first[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(counts[q, b])], names=["q", "bin", "n"])

    return run


def _pick(block: Block, k: int, scale: int):
    """mapInArrow function: this task's k first rows, by score and id, of those that reach the kth score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        found: list[tuple] = []
        size = 0

        def best() -> list[np.ndarray]:
            q, score, null, vec = (np.concatenate([h, *new]) for h, new in zip(held, zip(*found, strict=True), strict=True)) if found else held
            order = np.lexsort((vec, null, -score, q))
            q, score, null, vec = q[order], score[order], null[order], vec[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
            return [v[rank < k] for v in (q, score, null, vec)]

        for q0, s, ids, null in _scores(block, batches, scale):
            q, c = np.nonzero((s >= block.low[q0 : q0 + len(s), None]) & (s != _NONE))
            if len(q):
                found.append((q0 + q, s[q, c], null[c].astype(np.int64), ids[c]))
                size += len(q)
            if size > 1 << 20:
                held, found, size = best(), [], 0
        q, score, null, vec = best()
        own = pa.array(block.ids[q], pa.int64(), mask=block.null_id[q])
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), own, pa.array(vec, pa.int64(), mask=null.astype(bool)), pa.array(score)], names=["q", "query_id", "vec_id", "score"])

    return run


def _bounds(candidates: DataFrame, scale: int) -> tuple[int, int]:
    """Of all candidates that take part: the largest square sum (or a little more) and the greatest length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, width = 0, 0
        for batch in batches:
            _, x, sums = _whole(batch.column(1), scale)
            most, width = max(most, *sums, 0), max(width, x.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array([Decimal(most)], pa.decimal128(38, 0)), pa.array([width], pa.int32())], names=["most", "width"])

    row = candidates.mapInArrow(run, "most decimal(38,0), width int").agg(F.max("most").alias("most"), F.max("width").alias("width")).first()
    return int(row.most or 0), int(row.width or 0)


def _block(rows: pa.Table, most: int, scale: int, k: int, bins: int) -> Block:
    took, x, sums = _whole(rows.column("v"), scale)
    ids = rows.column("query_id").combine_chunks().take(pa.array(took))
    reach = np.array([isqrt(s * most) + 1 for s in sums], dtype=np.int64)
    # no product of a row of x with a candidate is larger than the largest reach, by Cauchy and Schwarz, nor are its sums of fewer entries
    return Block(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), x, -reach, 2 * reach + 1, np.full(len(took), k, dtype=np.int64), int(reach.max(initial=0)), bins)


def _narrow(block: Block, counts: DataFrame) -> bool:
    """Set each query's range to the bin with its kth score; false if all ranges are one score already."""
    open_ = block.span > 1
    if not open_.any():
        return False
    by = Window.partitionBy("q").orderBy(F.desc("bin"))
    sums = counts.groupBy("q", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(by))
    width, seen = block.width(), np.zeros(len(open_), dtype=bool)
    want = pa.array(block.want)
    # of the bins with k scores at or above them, the highest
    firsts = sums.filter(F.col("upto") >= F.element_at(F.lit(want.to_pylist()).cast("array<bigint>"), F.col("q") + 1)).groupBy("q").agg(F.max(F.struct("bin", "n", "upto")).alias("b"))
    for row in firsts.collect():
        seen[row.q] = True
        if open_[row.q]:
            block.low[row.q] += row.b.bin * width[row.q]
            block.want[row.q] -= row.b.upto - row.b.n
            block.span[row.q] = width[row.q]
    # fewer than k scores in all: every one of them is a result
    block.span[~seen] = 1
    return True


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, scale: int = SCALE, id: str = "vec_id", vector: str = "embedding", bins: int = BINS, block_rows: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest inner products among the candidates with another id."""
    spark = candidates.sparkSession
    shelf = Shelf(spark)
    candidates = candidates.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    with small_batches(spark, 2 * TILE[1]):
        most, width = _bounds(candidates, scale)
        asked = shelf.put(queries.select(F.col(id).cast("long").alias("query_id"), F.col(vector).alias("v")).filter("v IS NOT NULL").distinct())
        blocks = -(-asked.count() // max(1, min(block_rows, QUERY_BYTES // (8 * max(1, width)))))
        found = []
        for b in range(blocks):
            block = _block(asked.filter(F.pmod(F.xxhash64("query_id", "v"), F.lit(blocks)) == b).toArrow(), most, scale, k, bins)
            if not len(block.x):
                continue
            block.x = block.x[:, :width]
            while _narrow(block, candidates.mapInArrow(_count(block, scale), "q int, bin int, n long")):
                pass
            rows = candidates.mapInArrow(_pick(block, k, scale), "q int, query_id long, vec_id long, score long")
            by = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
            found.append(shelf.put(rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return spark.read.parquet(*(f"{shelf.folder}/{i + 2}" for i in range(len(found))))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors.filter(f"vec_id % {EACH} = 0"), vectors)


ORACLE_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
