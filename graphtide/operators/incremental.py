"""Incremental update of source graphs, end to end.

A file is cut into units: pieces that end at a ";" or "}" outside all brackets. Nodes, control flow and data dependence of a unit
depend on its text alone, so they are kept under the hash of the text, with numbers and positions local to the unit. A new
version is cut again, which is cheap; only units whose hash the store does not hold are parsed. Placement then gives every unit
its numbers, byte offsets and place among the root's children by running sums over a file's units, so whatever moved is
re-chained without touching the rows of unchanged units.

The parser is stateless between top-level items, so the parts equal the parse of the whole file. Files whose brackets do not
balance, or with a unit that does not parse, are one unit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphtide.operators import frontends as fe
from graphtide.operators.tree import child_paths

_CUTS = re.compile(r"//[^\n]*|/\*.*?\*/|#[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[][(){};]", re.S)


def split_units(text: str) -> list[str]:
    """The pieces of a file, which concatenated give the text."""
    out, depth, last = [], 0, 0
    for m in _CUTS.finditer(text):
        mark = m.group()
        depth += (mark in "([{") - (mark in ")]}")
        if depth < 0:
            return [text]
        if not depth and mark in (";", "}"):
            out.append(text[last : m.end()])
            last = m.end()
    if depth:
        return [text]
    return out + [text[last:]] if text[last:] or not out else out


PIECES = "graph_id string, ord int, start_byte long, n_bytes long, hash string, text string"


def pieces(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The units of every file. files: graph_id, text; known: graph_id of files that are one unit each."""
    whole = files.withColumn("whole", F.lit(False))
    if known is not None:
        whole = files.join(known.select("graph_id").distinct().withColumn("one", F.lit(True)), "graph_id", "left").withColumn("whole", F.coalesce("one", F.lit(False)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for g, t, one in zip(batch["graph_id"], batch["text"], batch["whole"], strict=True):
                at = 0
                for k, piece in enumerate([t or ""] if one else split_units(t or "")):
                    raw = piece.encode()
                    rows.append((g, k, at, len(raw), hashlib.sha256(raw).hexdigest(), piece))
                    at += len(raw)
            yield pd.DataFrame(rows, columns=["graph_id", "ord", "start_byte", "n_bytes", "hash", "text"])

    return whole.select("graph_id", "text", "whole").mapInPandas(run, PIECES)


PARTS = "hash string, node_id long, end_id long, parent_id long, child_ord int, depth int, kind string, node_type string, role string, name string, start_byte long, end_byte long, df_reads array<string>, df_writes array<string>, flow array<struct<dst:long,edge_type:string>>, reached array<struct<reader:long,var:string>>, error string"


def parse_units(units: DataFrame, language: str = "C") -> DataFrame:
    """Node rows of each text, numbered within it (0 is its root), with the control flow that leaves each and the readers of what it
    writes. units: hash, text, distinct."""
    names = [x.strip().split(" ")[0] for x in fe.NODE_SCHEMA.split(", ")]

    def parts(h: str, text: str) -> list[tuple]:
        rows = fe.rows_of(h, text, language)
        error, leaving, reached = None, {}, {}
        facts = [dict(zip(names, r, strict=True)) for r in rows]
        try:
            edges = fe.control_flow(facts)
            for src, dst, kind in edges:
                leaving.setdefault(src, []).append({"dst": dst, "edge_type": kind})
            for writer, reader, var in fe.data_flow(facts, edges):
                reached.setdefault(writer, []).append({"reader": reader, "var": var})
        except fe.FlowError as e:
            error, leaving = str(e), {}
        return [(*r, leaving.get(r[1], []), reached.get(r[1], []), error) for r in rows]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = (x for batch in batches for x in zip(batch["hash"], batch["text"], strict=True))
        yield from fe.framed((parts(h, text) for h, text in texts), [x.strip().split(" ")[0] for x in PARTS.split(", ")])

    return units.select("hash", "text").mapInPandas(run, PARTS)


@dataclass
class Store:
    """What is known of a version: units (graph_id, ord, start_byte, n_bytes, hash) and the parts of their texts."""

    units: DataFrame
    parts: DataFrame


def _broken(units: DataFrame, parts: DataFrame) -> DataFrame:
    """graph_id of files of several units, one of which does not parse."""
    bad = parts.filter("depth = 1 AND kind = 'ERROR'").select("hash").distinct()
    return units.filter("ord > 0").select("graph_id").distinct().join(units.join(bad, "hash", "left_semi").select("graph_id").distinct(), "graph_id", "left_semi")


def build(files: DataFrame, keep, language: str = "C") -> Store:
    """The store of a version from nothing. keep: materialises a table (Shelf.put), so that nothing is parsed twice."""
    return update(None, files, keep, language)


def update(old: Store | None, files: DataFrame, keep, language: str = "C") -> Store:
    """The store of the new version: only texts that the old one does not hold are parsed."""
    cut = keep(pieces(files))
    new = cut.select("hash", "text").dropDuplicates(["hash"])
    fresh = keep(parse_units(new if old is None else new.join(old.parts.filter("node_id = 0").select("hash"), "hash", "left_anti"), language))
    broken = _broken(cut, fresh if old is None else _known(old, cut).unionByName(fresh))
    if not broken.isEmpty():
        one = keep(pieces(files.join(broken, "graph_id", "left_semi"), broken))
        fresh = keep(fresh.unionByName(parse_units(one.select("hash", "text").dropDuplicates(["hash"]).join(fresh.select("hash").distinct(), "hash", "left_anti"), language)))
        cut = cut.join(broken, "graph_id", "left_anti").unionByName(one)
    units = cut.drop("text")
    return Store(units, fresh if old is None else _known(old, units).unionByName(fresh))


def _known(old: Store, units: DataFrame) -> DataFrame:
    return old.parts.join(units.select("hash").distinct(), "hash", "left_semi")


def placed(store: Store) -> DataFrame:
    """Units with what their local numbers are moved by: shift (nodes), place (the root's children before), start_byte."""
    size = store.parts.groupBy("hash").agg((F.count("*") - 1).alias("n"), F.count_if(F.col("depth") == 1).alias("kids"))
    w = Window.partitionBy("graph_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    return store.units.join(size, "hash").select("graph_id", "ord", "hash", "start_byte", "n_bytes", "n", before("n").alias("shift"), before("kids").alias("place"))


def nodes(store: Store, at: DataFrame) -> DataFrame:
    """The node table of every file, as frontends.build gives it. at: placed(store)."""
    inner = at.withColumnRenamed("start_byte", "offset").join(store.parts.filter("node_id > 0"), "hash").select(
        "graph_id", (F.col("node_id") + F.col("shift")).alias("node_id"), (F.col("end_id") + F.col("shift")).alias("end_id"),
        F.when(F.col("parent_id") == 0, 0).otherwise(F.col("parent_id") + F.col("shift")).cast("long").alias("parent_id"),
        (F.col("child_ord") + F.when(F.col("depth") == 1, F.col("place")).otherwise(0)).cast("int").alias("child_ord"),
        "depth", "kind", "node_type", "role", "name", (F.col("start_byte") + F.col("offset")).alias("start_byte"), (F.col("end_byte") + F.col("offset")).alias("end_byte"), "df_reads", "df_writes",
    )
    empty = F.array().cast("array<string>")
    roots = at.groupBy("graph_id").agg(F.sum("n").alias("n"), F.sum("n_bytes").alias("b")).select(
        "graph_id", F.lit(0).cast("long").alias("node_id"), (F.col("n") + 1).alias("end_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(1).alias("child_ord"), F.lit(0).alias("depth"),
        F.lit("translation_unit").alias("kind"), F.lit("TranslationUnit").alias("node_type"), F.lit("").alias("role"), F.lit(None).cast("string").alias("name"),
        F.lit(0).cast("long").alias("start_byte"), F.col("b").alias("end_byte"), empty.alias("df_reads"), empty.alias("df_writes"),
    )
    return roots.unionByName(inner)


def flow(store: Store, at: DataFrame) -> DataFrame:
    """(graph_id, src, dst, edge_type): control flow of every file; dst below 0 is the return of function -1 - dst."""
    e = at.join(store.parts.select("hash", "node_id", F.explode("flow").alias("e")), "hash")
    inside = F.col("e.dst") + F.col("shift")
    leaves = F.when(F.col("e.dst") == fe.EXIT, F.col("e.dst")).otherwise(F.col("e.dst") - F.col("shift"))
    return e.select("graph_id", (F.col("node_id") + F.col("shift")).alias("src"), F.when(F.col("e.dst") >= 0, inside).otherwise(leaves).alias("dst"), F.col("e.edge_type").alias("edge_type"))


def data(store: Store, at: DataFrame) -> DataFrame:
    """(graph_id, writer, reader, var): data dependence of every file."""
    e = at.join(store.parts.select("hash", "node_id", F.explode("reached").alias("e")), "hash")
    return e.select("graph_id", (F.col("node_id") + F.col("shift")).alias("writer"), (F.col("e.reader") + F.col("shift")).alias("reader"), F.col("e.var").alias("var"))


def operations(old: DataFrame, new: DataFrame) -> DataFrame:
    """(graph_id, path, op, l_id, r_id, l_type): a surgical update as one merge of two versions' nodes by their path of child ordinals.

    keep: the same node, wherever it is now; move: only its numbers or position changed; update: name or kind too; insert; delete.
    Applied to old, the operations give new. Tables that lie in parts by graph are merged where they lie.
    """
    sides = []
    for nodes_, p in ((old, "l"), (new, "r")):
        of_type = [F.col("node_type").alias("l_type")] if p == "l" else []
        sides.append(child_paths(nodes_).select("graph_id", "path", *of_type, F.col("node_id").alias(f"{p}_id"), F.struct("kind", "name", "role").alias(f"{p}_what"), F.struct("node_id", "start_byte", "end_byte").alias(f"{p}_where")))
    both = sides[0].join(sides[1], ["graph_id", "path"], "full_outer")
    op = (
        F.when(F.col("r_id").isNull(), "delete").when(F.col("l_id").isNull(), "insert")
        .when(~F.col("l_what").eqNullSafe(F.col("r_what")), "update").when(~F.col("l_where").eqNullSafe(F.col("r_where")), "move").otherwise("keep")
    )
    return both.select("graph_id", "path", op.alias("op"), "l_id", "r_id", "l_type")


def repaired(old: DataFrame, edits: DataFrame, new: DataFrame) -> DataFrame:
    """(graph_id, l_id, r_id): for each old node the new one that starts where the old start is mapped to, of the nearest length.

    old, new: graph_id, node_id, start_byte, end_byte; edits: graph_id, old_start, old_end, new_start, new_end. Ties go to the outer node.
    """
    from graphtide.operators.spatial import remap

    points = old.select(F.col("graph_id").alias("path"), F.col("start_byte").alias("pos")).distinct()
    start = remap(points, edits.withColumnRenamed("graph_id", "path")).select(F.col("path").alias("graph_id"), F.col("pos").alias("start_byte"), "new_pos")
    l = old.join(start, ["graph_id", "start_byte"]).select("graph_id", F.col("node_id").alias("l_id"), (F.col("end_byte") - F.col("start_byte")).alias("length"), "new_pos")  # noqa: E741
    r = new.select("graph_id", F.col("node_id").alias("r_id"), F.col("start_byte").alias("new_pos"), (F.col("end_byte") - F.col("start_byte")).alias("r_length"))
    near = F.struct(F.abs(F.col("length") - F.col("r_length")).alias("gap"), "r_id")
    return l.join(r, ["graph_id", "new_pos"]).groupBy("graph_id", "l_id").agg(F.min(near).alias("b")).select("graph_id", "l_id", F.col("b.r_id").alias("r_id"))
