"""Near-duplicate detection with bottom-k sketches from one hash function.

1. Every text becomes the set of its word shingles' 64-bit hashes; equal sets (by a 128-bit digest) are one node.
2. A node's sketch is the SKETCH smallest hashes. Two sets of similarity t share a value of the union's
   bottom-k with probability t, independently enough to bound the shared values below by `least_shared`,
   at an error of MISS for a pair.
3. The INDEXED smallest values are ordered by rarity, by exact counts of the nodes that hold each, and only
   as many of the rarest stay as a pair with enough shared values cannot avoid; a value of one node alone makes no
   list. Inverted lists of the others give pairs.
4. Values of under HOT nodes give their lists' pairs, which the union-sketch estimate filters before full sets are compared.
   Longer lists are joined into groups, cut into blocks of bounded bytes by set size, and each pair of blocks is
   solved by inverted lists of full sets with a union-find: a member is compared with all others only
   while it is outside the largest component, so copies are never expanded into all pairs.
5. Links are exact similarities of full sets; components come from star rounds.

Defined results: null and empty texts have the empty set and link with nothing; a text of fewer words than a
shingle is one shingle; rows with equal text are linked; a row with a null id links like any other but never names a
component, and is kept only if its component has no id at all. Repeated rows with one id share the component; rows with one id
and different texts are judged by their texts. Other columns of the input are not read and not returned, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.llm import kernels as K
from graphtide.operators.components import connected_components
from graphtide.runtime import Shelf, small_batches, table

SKETCH, INDEXED = 64, 32
MISS = 1e-9
HOT = 64
BLOCK_BYTES = 16 << 20


def least_shared(k: int, t: float, miss: float = MISS) -> int:
    """The largest s such that fewer than s of k values are shared with probability under miss at similarity t."""
    total, s = 0.0, 0
    while s < k:
        total += math.comb(k, s) * t**s * (1 - t) ** (k - s)
        if total >= miss:
            break
        s += 1
    return max(1, s)


def shingle_sets(b: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    rows = len(offsets) - 1
    _, _, row, code = K.words_of(K.ascii_lower(b), offsets)
    bounds = K.row_bounds(row, rows)
    h = K.mix(code + np.uint64(0x5851F42D4C957F2D))
    whole = h
    n = len(code)
    if n >= size:
        h = h[: n - size + 1]
        for j in range(1, size):
            h = K.mix(h * np.uint64(0xD1342543DE82EF95) + code[j : n - size + 1 + j])
    out = []
    for r in range(rows):
        lo, hi = bounds[r], bounds[r + 1]
        if hi - lo >= size:
            out.append(np.unique(h[lo : hi - size + 1]))
        elif hi > lo:
            one = whole[lo : lo + 1]
            for j in range(1, hi - lo):
                one = K.mix(one * np.uint64(0xD1342543DE82EF95) + code[lo + j : lo + j + 1])
            out.append(K.mix(one + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, n, digest, sketch): h a hash of the text, digest of the whole set, sketch its smallest hashes (signed)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sketch = [], [], []
            for _, _, b, off in K.chunks(batch.column(2)):
                for s in shingle_sets(b, off, size):
                    n.append(len(s))
                    digest.append(_digest(s))
                    sketch.append(s[:SKETCH].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))], names=["doc_id", "h", "n", "digest", "sketch"]
            )

    return docs.select(F.col(doc_id).cast("long"), F.xxhash64(text), F.col(text)).mapInArrow(make, "doc_id long, h long, n long, digest binary, sketch array<long>")


def _prefixes(nodes: DataFrame, t: float) -> DataFrame:
    """(value, node, n, hot): the rarest indexed values of each node, without those that no other node has; hot: HOT nodes or more have the value."""
    need = least_shared(INDEXED, t)
    own = F.slice("sketch", 1, INDEXED)
    # one number for the set's size and the number of its indexed values keeps the rows narrow
    entries = nodes.select("node", (F.col("n") * (INDEXED + 1) + F.size(own)).alias("sizes"), F.explode(own).alias("value"))
    common = entries.groupBy("value").agg(F.count("*").alias("c")).filter("c > 1")
    held = entries.join(common, "value").groupBy("node").agg(F.first("sizes").alias("sizes"), F.array_sort(F.collect_list(F.struct("c", "value"))).alias("held"))
    k = F.col("sizes") % (INDEXED + 1)
    # values of the node alone are the rarest of all: they come before the ones held in common
    room = F.size("held") - F.greatest(F.lit(1), F.floor(k * need / INDEXED)) + 1
    return (
        held.withColumn("room", room.cast("int")).filter("room > 0")
        .select("node", F.floor(F.col("sizes") / (INDEXED + 1)).alias("n"), F.explode(F.slice("held", F.lit(1), F.col("room"))).alias("e"))
        .select(F.col("e.value").alias("value"), "node", "n", (F.col("e.c") >= HOT).alias("hot"))
    )


def _full_sets(docs: DataFrame, wanted: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """(node, n, items): the whole sets of the wanted (__id, __h, node, digest); a row without an id is found by its text's hash."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows that are repeated ask for the same set
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for i, node in enumerate(batch.column(0).to_pylist()):
                if node not in seen:
                    seen.add(node)
                    fresh.append(i)
            batch, items = batch.take(pa.array(fresh, pa.int64())), []
            for _, _, b, off in K.chunks(batch.column(1)):
                items += shingle_sets(b, off, size)
            # a hash of the text may be that of another text
            right = [_digest(x) == d for x, d in zip(items, batch.column(2).to_pylist(), strict=True)]
            seen.difference_update(n for n, ok in zip(batch.column(0).to_pylist(), right, strict=True) if not ok)
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in items], pa.int64()), pa.array([x.tobytes() for x in items], pa.binary())], names=["node", "n", "items"])
            yield out.filter(pa.array(right, pa.bool_()))

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("__text"))
    picked = rows.join(wanted.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")))
    return picked.select("node", "__text", "digest").mapInArrow(make, "node long, n long, items binary")


def _similar(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(src, dst) of the pairs whose full sets have den * intersection >= num * union."""
    a = sets.select(F.col("node").alias("src"), F.col("items").alias("x"))
    b = sets.select(F.col("node").alias("dst"), F.col("items").alias("y"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            xs, ys = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(xs[i].as_buffer(), np.uint64), np.frombuffer(ys[i].as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "src").join(b, "dst").select("src", "dst", "x", "y").mapInArrow(judge, "src long, dst long")


def _estimated(pairs: DataFrame, nodes: DataFrame, t: float) -> DataFrame:
    """The pairs whose union sketch does not rule out similarity t."""
    s = nodes.select("node", "sketch")
    a, b = s.select(F.col("node").alias("src"), F.col("sketch").alias("x")), s.select(F.col("node").alias("dst"), F.col("sketch").alias("y"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            xs, ys = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = np.asarray(xs[i].values).view(np.uint64), np.asarray(ys[i].values).view(np.uint64)
                union = np.union1d(x, y)[:SKETCH]
                both = np.intersect1d(x, y, assume_unique=True)
                k = len(union)
                keep.append(np.searchsorted(both, union[-1], side="right") >= (least_shared(k, t) if k == SKETCH else 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "src").join(b, "dst").select("src", "dst", "x", "y").mapInArrow(judge, "src long, dst long")


def _cold_pairs(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs within lists of fewer than HOT members whose sizes allow the similarity."""
    a = lists.select("value", F.col("node").alias("src"), F.col("n").alias("n1"))
    b = lists.select("value", F.col("node").alias("dst"), F.col("n").alias("n2"))
    return a.join(b, "value").filter(f"src < dst AND {den} * least(n1, n2) >= {num} * greatest(n1, n2)").select("src", "dst").distinct()


def linked_within(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that span the components of all links among the sets; exact.

    A link joins two components and is found from either end, so the members of the largest component need no
    comparison of their own once every other member has been compared with all.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    _, item = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(item, kind="stable")
    holder = np.searchsorted(bounds, order, side="right") - 1
    heads = np.searchsorted(item[order], np.arange(item.max() + 2))
    leader = np.arange(n)
    members: dict[int, list[int]] = {i: [i] for i in range(n)}
    links, compared, big = [], np.zeros(n, bool), 0
    while len(pending := np.flatnonzero(~compared & (leader != big))):
        for i in pending:
            if leader[i] == big:
                continue
            compared[i] = True
            own = item[bounds[i] : bounds[i + 1]]
            lo, length = heads[own], heads[own + 1] - heads[own]
            at = np.repeat(lo - (np.cumsum(length) - length), length) + np.arange(length.sum())
            both = np.bincount(holder[at], minlength=n)
            for j in np.flatnonzero((den * both >= num * (size + size[i] - both)) & (leader != leader[i])):
                a, b = leader[i], leader[j]
                if a == b:
                    continue
                links.append((int(i), int(j)))
                if len(members[a]) < len(members[b]):
                    a, b = b, a
                leader[members[b]] = a
                members[a] += members.pop(b)
                if len(members[a]) > len(members[big] if big in members else ()):
                    big = a
    return links


def _hot_links(prefixes: DataFrame, sets: DataFrame, num: int, den: int, shelf: Shelf) -> DataFrame:
    """(src, dst) that span the links among members of long lists."""
    hot = prefixes.filter("hot")
    first = hot.groupBy("node").agg(F.min("value").alias("first"))
    ties = hot.join(first, "node").select(F.col("first").alias("src"), F.col("value").alias("dst")).filter("src <> dst").distinct()
    group = connected_components(ties).select(F.col("node").alias("first"), "component")
    grouped = first.join(group, "first", "left").select("node", F.coalesce("component", "first").alias("g"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(den / num))).cast("long")
    sized = shelf.put(grouped.join(sets, "node").withColumn("band", band))
    shares = sized.groupBy("g", "band").agg(F.ceil(F.sum(F.length("items")) / F.lit(BLOCK_BYTES)).cast("int").alias("m"))
    after = shares.select("g", (F.col("band") - 1).alias("band"), F.col("m").alias("m_next"))
    before = shares.select("g", (F.col("band") + 1).alias("band"), F.col("m").alias("m_prev"))
    placed = (
        sized.join(shares, ["g", "band"]).join(after, ["g", "band"], "left").join(before, ["g", "band"], "left")
        .withColumn("i", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    )
    # blocks of one band meet each other, and those of the next band
    same = F.expr("transform(sequence(0, m - 1), j -> struct(band AS lo, least(i, j) AS a, band AS hi, greatest(i, j) AS b))")
    up = F.expr("CASE WHEN m_next IS NULL THEN array() ELSE transform(sequence(0, m_next - 1), j -> struct(band AS lo, i AS a, band + 1 AS hi, j AS b)) END")
    down = F.expr("CASE WHEN m_prev IS NULL THEN array() ELSE transform(sequence(0, m_prev - 1), j -> struct(band - 1 AS lo, j AS a, band AS hi, i AS b)) END")
    # a lone block of a band needs no meeting of its own if it meets a neighbour
    meet = placed.select("g", "node", "items", F.explode(F.concat(same, up, down)).alias("p"))

    def solve(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("node")
        nodes = frame["node"].to_numpy()
        links = linked_within([np.frombuffer(x, np.uint64) for x in frame["items"]], num, den) if len(frame) > 1 else []
        return pd.DataFrame({"src": [nodes[a] for a, _ in links], "dst": [nodes[b] for _, b in links]}, dtype="int64")

    return meet.select("g", "p.lo", "p.a", "p.hi", "p.b", "node", "items").groupBy("g", "lo", "a", "hi", "b").applyInPandas(solve, "src long, dst long")


def components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, node, component_id, kept), one row for each row of docs."""
    with small_batches(docs.sparkSession):
        return _components(docs, size, num, den, doc_id, text)


def _components(docs: DataFrame, size: int, num: int, den: int, doc_id: str, text: str) -> DataFrame:
    spark, t = docs.sparkSession, num / den
    shelf = Shelf(spark)
    made = shelf.put(sketches(docs, size, doc_id, text))
    nodes = made.filter("n > 0").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("one"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    # the shelf keeps the numbers as they were given
    nodes = shelf.put(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("one.doc_id").alias("id"), F.col("one.h").alias("h"), "n", "sketch"))
    prefixes = shelf.put(_prefixes(nodes, t))
    pairs = shelf.put(_estimated(_cold_pairs(prefixes.filter("NOT hot"), num, den), nodes, t))
    wanted = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).union(prefixes.filter("hot").select("node")).distinct()
    sets = shelf.put(_full_sets(docs, nodes.join(wanted, "node").select(F.col("id").alias("__id"), F.col("h").alias("__h"), "node", "digest"), size, doc_id, text))
    links = shelf.put(_similar(pairs, sets, num, den).unionByName(_hot_links(prefixes, sets, num, den, shelf)).distinct())
    label = connected_components(links)
    labelled = nodes.select("node", "digest", "id").join(label, "node", "left").select("node", "digest", "id", F.coalesce("component", "node").alias("label"))
    named = labelled.join(labelled.groupBy("label").agg(F.min("id").alias("component_id")), "label").select("node", "digest", "component_id")
    out = made.select("doc_id", "n", "digest").join(named, "digest", "left").drop("digest")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    # the result is narrow: it stays, on a shelf of its own
    out = Shelf(spark).put(out.withColumn("component_id", own).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())))
    shelf.clear()
    return out


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return components(docs, 3, 85, 100).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


ORACLE_SQL = None
