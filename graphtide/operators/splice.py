"""Rebuild of changed subtrees in place: what a new version of a tree writes follows what has changed, not the tree.

Nested-set numbers and byte offsets move behind every edit, so a stored tree has neither. A row's place is its path: a gapped
label for each level, so that siblings come and go between their neighbours. Its position is relative: lead, the bytes since
the sibling before (or the parent's start), and length. Rows outside a rebuilt subtree and its ancestors stay as they are;
numbers and offsets are made from the rows when they are read (renumbered).

Two versions are aligned from the root down, and only below nodes whose hash differs. Children of equal hash are anchors as far
as their order agrees; between two anchors, children are paired by place and kind and looked into, and what is left over is
removed or inserted as whole subtrees. Where two labels leave no room, the parent's children are written anew.

Each graph passes whole through Python once, as it does through the parser: jobs follow neither depth nor number of changes.

Tables: nodes as frontends.build gives them; rows: ROW. A graph that is not in the new nodes stays; empty tables give empty ones.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from graphtide.operators.components import parts
from graphtide.runtime import Shelf

OWN = ["kind", "node_type", "role", "name", "df_reads", "df_writes"]
ROW = ["graph_id", "path", "up", *OWN, "lead", "length", "hash"]
#: Free labels between two siblings of a table that is made whole; digits of a label in a path.
GAP, WIDTH = 1 << 20, 13


def _list(table: pa.Table, column: str) -> list:
    return table.column(column).to_numpy().tolist()


class _Tree:
    """One graph's nodes in pre-order: children by index, lead, length, and hash, which tells subtrees apart wherever they stand."""

    def __init__(self, nodes: pa.Table):
        self.table = nodes = nodes.sort_by("node_id")
        at = {n: i for i, n in enumerate(_list(nodes, "node_id"))}
        self.up = [at.get(p) for p in pc.fill_null(nodes.column("parent_id"), -1).to_numpy().tolist()]
        self.ord, self.kind = _list(nodes, "child_ord"), _list(nodes, "kind")
        start, end = _list(nodes, "start_byte"), _list(nodes, "end_byte")
        self.length = [z - a for a, z in zip(start, end, strict=True)]
        self.kids: list[list[int]] = [[] for _ in start]
        self.lead, self.size, self.hash = [], [1] * len(start), [""] * len(start)
        for i, p in enumerate(self.up):
            before = 0 if p is None else end[self.kids[p][-1]] if self.kids[p] else start[p]
            self.lead.append(start[i] - before)
            if p is not None:
                self.kids[p].append(i)
        own = _list(nodes, "own")
        for i in range(len(start) - 1, -1, -1):
            text = f"{own[i]}|{self.lead[i]}|{self.length[i]}|{','.join([self.hash[k] for k in self.kids[i]])}"
            self.hash[i] = hashlib.sha256(text.encode()).hexdigest()
            if self.up[i] is not None:
                self.size[self.up[i]] += self.size[i]

    def below(self, top: int, path: str, gap: int) -> list[str]:
        """Paths of a subtree made whole, in pre-order, if its top stands at path."""
        out = [path]
        for i in range(top + 1, top + self.size[top]):
            up = out[self.up[i] - top]
            cell = str(self.ord[i] * gap).zfill(WIDTH)
            out.append(f"{up}/{cell}" if up else cell)
        return out

    def rows(self, at: list[int], paths: list[str]) -> dict:
        """Columns of ROW."""
        took = self.table.take(pa.array(at, pa.int64()))
        above = [None if not p else p[: max(len(p) - WIDTH - 1, 0)] for p in paths]
        made = {"path": pa.array(paths, pa.string()), "up": pa.array(above, pa.string())}
        made |= {"lead": pa.array([self.lead[i] for i in at], pa.int64()), "length": pa.array([self.length[i] for i in at], pa.int64()), "hash": pa.array([self.hash[i] for i in at], pa.string())}
        return {c: made[c] if c in made else took.column(c) for c in ROW}


def _read(nodes: DataFrame):
    """What a tree is made of, by graph; own: the hash of what a node is by itself."""
    own = F.sha2(F.to_json(F.struct(*OWN)), 256)
    return nodes.select("graph_id", "node_id", "parent_id", "child_ord", "start_byte", "end_byte", *OWN, own.alias("own")).groupBy("graph_id")


def _row_types(nodes: DataFrame) -> StructType:
    """The columns of ROW, as a table of these nodes has them."""
    made = {"path": "string", "up": "string", "lead": "long", "length": "long", "hash": "string"}
    out = StructType()
    for c in ROW:
        out.add(c, made[c] if c in made else nodes.schema[c].dataType)
    return out


def rows(nodes: DataFrame) -> DataFrame:
    """The table of a version, made whole."""
    gap = GAP

    def whole(table: pa.Table) -> pa.Table:
        tree = _Tree(table)
        return pa.table(tree.rows(list(range(len(tree.kind))), tree.below(0, "", gap)))

    return _read(nodes).applyInArrow(whole, _row_types(nodes))


@dataclass
class Splice:
    """A new version as changes of a table: rows that go (graph_id, path), and rows to write (op: insert, update; ROW)."""

    removed: DataFrame
    written: DataFrame


def _aligned(left: list[tuple[str, str, str]], right: list[tuple[int, str, str]], gap: int) -> list[tuple] | None:
    """Children of a pair in order, (path, kind, hash) and (index, kind, hash): (old place, new place, equal, label); old None: inserted at the
    label; new None: removed. None where labels leave no room."""
    seen: dict[tuple[str, int], int] = {}
    number: Counter[str] = Counter()
    for i, (_, _, h) in enumerate(left):
        seen[h, number[h]] = i
        number[h] += 1
    number.clear()
    both = []
    for j, (_, _, h) in enumerate(right):
        if (h, number[h]) in seen:
            both.append((seen[h, number[h]], j))
        number[h] += 1
    # pairs of one rank on both sides stand in one order
    anchors = [a for a, b in zip(sorted(both), both, strict=True) if a == b]
    full: list[tuple[int | None, int | None, bool]] = []
    i = j = 0
    for a, b in [*anchors, (len(left), len(right))]:
        for t in range(max(a - i, b - j)):
            full.append((i + t if i + t < a else None, j + t if j + t < b else None, False))
        if a < len(left):
            full.append((a, b, True))
        i, j = a + 1, b + 1
    out: list[tuple] = []
    label = lambda i: int(left[i][0][-WIDTH:])
    after, at = 0, 0
    while at < len(full):
        i, j, equal = full[at]
        if i is not None:
            out.append((i, j, equal, None))
            after = after if j is None else label(i)
            at += 1
            continue
        # inserted children stand between the rows that stay at either side
        k = 1
        while at + k < len(full) and full[at + k][0] is None:
            k += 1
        until = next((label(x) for x, y, _ in full[at + k :] if x is not None and y is not None), after + (k + 1) * gap)
        step = (until - after) // (k + 1)
        if step < 1:
            return None
        out += [(None, full[at + t][1], False, after + (t + 1) * step) for t in range(k)]
        at += k
    return out


def _changes(old: pa.Table, nodes: pa.Table, gap: int) -> dict | None:
    """One graph's changes: columns op (remove, insert, update) and ROW; None if nothing changes."""
    new = _Tree(nodes)
    stored = sorted(zip(_list(old, "path"), _list(old, "kind"), _list(old, "hash"), strict=True))
    paths = [p for p, _, _ in stored]
    kids: dict[str, list[tuple[str, str, str]]] = {}
    for row in stored:
        if row[0]:
            kids.setdefault(row[0][: max(len(row[0]) - WIDTH - 1, 0)], []).append(row)
    if stored and stored[0][2] == new.hash[0]:
        return None
    gone: list[str] = []
    fresh: list[tuple[str, int]] = []
    pairs: list[tuple[str, int]] = []
    if stored and stored[0][1] == new.kind[0]:
        pairs.append(("", 0))
    else:
        gone, fresh = ([""] if stored else []), [("", 0)]
    # the list grows while it is read: pairs are looked into
    for path, node in pairs:
        under = lambda label, path=path: f"{path}/{str(label).zfill(WIDTH)}" if path else str(label).zfill(WIDTH)
        left, right = kids.get(path, []), [(k, new.kind[k], new.hash[k]) for k in new.kids[node]]
        found = _aligned(left, right, gap)
        if found is None:
            gone += [p for p, _, _ in left]
            fresh += [(under((j + 1) * gap), k) for j, (k, _, _) in enumerate(right)]
            continue
        for i, j, equal, label in found:
            if i is None:
                fresh.append((under(label), right[j][0]))
            elif j is None:
                gone.append(left[i][0])
            elif not equal and left[i][1] == right[j][1]:
                pairs.append((left[i][0], right[j][0]))
            elif not equal:
                gone.append(left[i][0])
                fresh.append((left[i][0], right[j][0]))
    removed: list[str] = []
    for top in gone:
        # the rows of a subtree lie together: "/" comes before the digits
        low, high = (0, len(paths)) if not top else (bisect_left(paths, top), bisect_left(paths, top + "0"))
        removed += paths[low:high]
    at, where = [k for _, k in pairs], [p for p, _ in pairs]
    for path, top in fresh:
        at += range(top, top + new.size[top])
        where += new.below(top, path, gap)
    ops = ["update"] * len(pairs) + ["insert"] * (len(at) - len(pairs)) + ["remove"] * len(removed)
    written, n = new.rows(at, where), len(removed)
    blank = {c: pa.nulls(n, v.type) for c, v in written.items()} | {"path": pa.array(removed, pa.string())}
    if n:
        blank["graph_id"] = old.column("graph_id").slice(0, 1).take(pa.array([0] * n, pa.int64()))
    flat = lambda v: v.chunks if isinstance(v, pa.ChunkedArray) else [v]
    return {"op": pa.array(ops, pa.string())} | {c: pa.chunked_array([*flat(written[c]), *flat(blank[c])], type=written[c].type) for c in ROW}


def splice(old: DataFrame, nodes: DataFrame) -> Splice:
    """What turns the table old into the one of the new version's nodes. nodes hold the changed graphs, whole.

    A graph passes whole through Python, as it does through the parser: the changes of all graphs are one job, however deep the trees.
    """
    gap, types = GAP, StructType().add("op", "string")
    for field in _row_types(nodes).fields:
        types.add(field)
    none = to_arrow_schema(types).empty_table()

    def change(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _changes(left, right, gap) if right.num_rows else None
        return none if found is None else pa.table(found)

    sides = old.select("graph_id", "path", "kind", "hash").groupBy("graph_id").cogroup(_read(nodes))
    found = Shelf(old.sparkSession).put(sides.applyInArrow(change, types), "graph_id", parts(old))
    removed = F.col("op") == "remove"
    return Splice(found.filter(removed).select("graph_id", "path"), found.filter(~removed))


def spliced(old: DataFrame, change: Splice) -> DataFrame:
    """The table of the new version."""
    stale = change.removed.unionByName(change.written.filter("op = 'update'").select("graph_id", "path"))
    return old.join(stale, ["graph_id", "path"], "left_anti").unionByName(change.written.select(*ROW))


_NUMBERS = {"node_id": "long", "end_id": "long", "parent_id": "long", "child_ord": "integer", "depth": "integer", "start_byte": "long", "end_byte": "long"}
_NODE = ["graph_id", "node_id", "end_id", "parent_id", "child_ord", "depth", "kind", "node_type", "role", "name", "start_byte", "end_byte", "df_reads", "df_writes"]


def _numbered(table: pa.Table) -> pa.Table:
    """One graph's rows with nested-set numbers, ordinals and byte spans: its open nodes are a stack, in order of paths."""
    table = table.sort_by("path")
    found: dict[str, list] = {c: [] for c in _NUMBERS}
    # of each open node: number, children so far, and the position from which the next child's lead counts
    open_: list[list[int]] = []
    for me, (path, lead, length) in enumerate(zip(_list(table, "path"), _list(table, "lead"), _list(table, "length"), strict=True)):
        depth = (len(path) + 1) // (WIDTH + 1)
        while len(open_) > depth:
            found["end_id"][open_.pop()[0]] = me
        parent, nth, start = None, 1, lead
        if open_:
            up = open_[-1]
            parent, start = up[0], up[2] + lead
            up[1] += 1
            nth, up[2] = up[1], start + length
        open_.append([me, 0, start])
        for c, v in zip(_NUMBERS, (me, 0, parent, nth, depth, start, start + length), strict=True):
            found[c].append(v)
    for node in open_:
        found["end_id"][node[0]] = table.num_rows
    types = {"long": pa.int64(), "integer": pa.int32()}
    return pa.table({c: pa.array(found[c], types[_NUMBERS[c]]) if c in _NUMBERS else table.column(c) for c in _NODE})


def renumbered(table: DataFrame) -> DataFrame:
    """The nodes of a table, as frontends.build numbers them: nested sets, ordinals and byte spans."""
    types = StructType()
    for c in _NODE:
        types.add(c, _NUMBERS[c] if c in _NUMBERS else table.schema[c].dataType)
    return table.select("graph_id", "path", *OWN, "lead", "length").groupBy("graph_id").applyInArrow(_numbered, types)
