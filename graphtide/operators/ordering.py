"""Order of siblings kept by gapped labels, so that an insert writes few rows.

A table of children has a label in [0, 2^BITS) and the next sibling of each row; labels rise along the chain. New rows get
labels between those of their neighbours. Where a gap is too narrow, the smallest dyadic window around it that is sparse
enough is spread evenly: a window of 2^i labels may hold (2 / CROWD)^i rows, so a spread leaves room for as many inserts
as rows that it wrote, up to a constant, and an insert costs O(log n) rows in the long run.

Windows are found by equi-joins on (graph_id, parent_id, label >> i), a few levels at a time; a parent with very many
children is dealt by window, never sorted as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphtide.runtime import cut

BITS, CROWD = 62, 1.3
#: Windows of 2^i labels that are tried.
LEVELS = (*range(4, BITS, 4), BITS)
KEY = ["graph_id", "parent_id"]
COLUMNS = [*KEY, "node_id", "label", "next_id"]
NONE = -1


def labelled(children: DataFrame, order: str = "child_ord") -> DataFrame:
    """children spread evenly over all labels, in the order given: the one full sort, when a table is made."""
    w = Window.partitionBy(*KEY).orderBy(order, "node_id")
    step = F.expr(f"{1 << BITS}L div (n + 1)")
    placed = children.select(*KEY, "node_id", F.row_number().over(w).alias("at"), F.count("*").over(Window.partitionBy(*KEY)).alias("n"), F.lead("node_id").over(w).alias("next_id"))
    return placed.select(*KEY, "node_id", (F.col("at") * step).alias("label"), "next_id")


@dataclass
class Insertion:
    """What an insert comes to: the rows written (new ones, and others with a new label or a new neighbour) and the sibling edges."""

    children: DataFrame
    writes: DataFrame
    new: DataFrame

    def table(self) -> DataFrame:
        """All children with the writes applied."""
        kept = self.children.join(self.writes.select(*KEY, "node_id"), [*KEY, "node_id"], "left_anti")
        return kept.select(*COLUMNS).unionByName(self.writes.select(*COLUMNS))

    def edges_added(self) -> DataFrame:
        """(graph_id, src, dst): sibling edges that come, touching new rows only."""
        after = self.new.filter("first AND after IS NOT NULL").select("graph_id", F.col("after").alias("src"), F.col("node_id").alias("dst"))
        return after.unionByName(self.new.filter("next_id IS NOT NULL").select("graph_id", F.col("node_id").alias("src"), F.col("next_id").alias("dst")))

    def edges_removed(self) -> DataFrame:
        """(graph_id, src, dst): sibling edges that a new row splits."""
        return self.new.filter("last AND after IS NOT NULL AND next_id IS NOT NULL").select("graph_id", F.col("after").alias("src"), F.col("next_id").alias("dst"))


def _placed(children: DataFrame, new: DataFrame) -> DataFrame:
    """new rows with prev and next label, their place among the m new rows of their gap, and their next sibling."""
    known = children.select(*KEY, F.col("node_id").alias("after"), F.col("label").alias("prev"), F.col("next_id").alias("then"))
    at = new.filter("after IS NOT NULL").join(known, [*KEY, "after"], "left")
    at = at.withColumn("prev", F.when(F.col("prev").isNull(), F.raise_error(F.lit("a row is inserted after one that is not there"))).otherwise(F.col("prev")))
    # without a row before them they come first
    heads = new.filter("after IS NULL").select(*KEY).distinct()
    first = children.join(heads, KEY, "left_semi").groupBy(*KEY).agg(F.min_by("node_id", "label").alias("then"))
    head = new.filter("after IS NULL").join(first, KEY, "left").withColumn("prev", F.lit(NONE).cast("long"))
    both = at.unionByName(head.select(*at.columns))
    following = children.select(*KEY, F.col("node_id").alias("then"), F.col("label").alias("next"))
    both = both.join(following, [*KEY, "then"], "left").fillna(1 << BITS, ["next"])
    gap = Window.partitionBy(*KEY, "prev")
    order = gap.orderBy("seq", "node_id")
    follows = F.lead("node_id").over(order)
    return both.select(
        *KEY, "node_id", "after", "prev", "next", F.row_number().over(order).alias("at"), F.count("*").over(gap).alias("m"),
        F.coalesce(follows, "then").alias("next_id"), (F.row_number().over(order) == 1).alias("first"), follows.isNull().alias("last"),
    )


def _window(label: str | Column, level: int) -> Column:
    return F.call_function("shiftright", F.greatest(F.col(label) if isinstance(label, str) else label, F.lit(0).cast("long")), F.lit(level))


def _windows(children: DataFrame, placed: DataFrame) -> list[tuple[int, DataFrame]]:
    """(level, (key, w, low, total)) of the windows that are spread; none lies in another."""
    pending = cut(placed.filter("next - prev - 1 < m").select(*KEY, "prev").distinct())
    found: list[tuple[int, DataFrame]] = []
    for level in LEVELS:
        if pending.isEmpty():
            break
        asked = pending.withColumn("w", _window("prev", level))
        wanted = asked.select(*KEY, "w").distinct()
        held = children.withColumn("w", _window("label", level)).join(wanted, [*KEY, "w"], "left_semi").groupBy(*KEY, "w").agg(F.min("label").alias("low"), F.count("*").alias("n"))
        coming = placed.withColumn("w", _window("prev", level)).join(wanted, [*KEY, "w"], "left_semi").groupBy(*KEY, "w").agg(F.count("*").alias("m"))
        total = F.coalesce("n", F.lit(0)) + F.col("m")
        # the first row of a window keeps its label, so that the gap before it stays as it is; nothing comes before window 0
        low = F.when(F.col("w") == 0, F.lit(NONE).cast("long")).otherwise(F.col("low"))
        sized = coming.join(held, [*KEY, "w"], "left").select(*KEY, "w", low.alias("low"), total.alias("total"))
        room = F.expr(f"shiftleft(w + 1, {level})") - F.col("low")
        good = cut(sized.filter((F.col("total") < room) & (F.lit(True) if level == BITS else F.col("total") <= room * F.lit(CROWD**-level))))
        found.append((level, good))
        pending = cut(asked.join(good, [*KEY, "w"], "left_anti").select(*KEY, "prev"))
    if not pending.isEmpty():
        raise ValueError("a parent has more children than labels")
    out = []
    for i, (level, windows) in enumerate(found):
        for above, larger in found[i + 1 :]:
            inside = larger.select(*KEY, F.col("w").alias("up"))
            windows = windows.withColumn("up", F.call_function("shiftright", "w", F.lit(above - level))).join(inside, [*KEY, "up"], "left_anti").drop("up")
        out.append((level, windows))
    return out


def insert(children: DataFrame, new: DataFrame) -> Insertion:
    """new: graph_id, parent_id, node_id, after (null: before all others), seq (order among those after one row)."""
    placed = cut(_placed(children, new))
    spread, windows = [], _windows(children, placed)
    rest = placed
    for level, found in windows:
        rows = children.select(*KEY, "node_id", F.col("label").alias("old"), F.col("label").alias("anchor"), F.lit(0).alias("at")).unionByName(
            placed.select(*KEY, "node_id", F.lit(None).cast("long").alias("old"), F.col("prev").alias("anchor"), "at")
        )
        inside = rows.withColumn("w", _window("anchor", level)).join(found, [*KEY, "w"])
        rank = F.row_number().over(Window.partitionBy(*KEY, "w").orderBy("anchor", "at")) - F.when(F.col("low") == NONE, 0).otherwise(1)
        step = F.expr(f"(shiftleft(w + 1, {level}) - low) div (total + 1)")
        spread.append(inside.select(*KEY, "node_id", "old", (F.greatest("low", F.lit(0).cast("long")) + rank * step).alias("label")))
        rest = rest.withColumn("w", _window("prev", level)).join(found.select(*KEY, "w"), [*KEY, "w"], "left_anti").drop("w")
    between = rest.select(*KEY, "node_id", F.lit(None).cast("long").alias("old"), F.expr("prev + at * ((next - prev) div (m + 1))").alias("label"))
    labels = cut(reduce(DataFrame.unionByName, spread, between))
    fresh = placed.join(labels.filter("old IS NULL").select(*KEY, "node_id", "label"), [*KEY, "node_id"])
    # other rows are written if their label or their neighbour changes
    moved = labels.filter("old IS NOT NULL AND label <> old").select(*KEY, "node_id", F.col("label").alias("to"))
    follower = placed.filter("first AND after IS NOT NULL").select(*KEY, F.col("after").alias("node_id"), F.col("node_id").alias("follower"))
    touched = moved.join(follower, [*KEY, "node_id"], "full")
    others = children.join(touched, [*KEY, "node_id"]).select(*KEY, "node_id", F.coalesce("to", "label").alias("label"), F.coalesce("follower", "next_id").alias("next_id"))
    writes = cut(fresh.select(*COLUMNS, F.lit(True).alias("is_new")).unionByName(others.withColumn("is_new", F.lit(False))))
    return Insertion(children, writes, placed)


def positions(children: DataFrame) -> DataFrame:
    """(key, node_id, child_ord): ordinals from 1, for readers that want them."""
    return children.select(*KEY, "node_id", F.row_number().over(Window.partitionBy(*KEY).orderBy("label")).alias("child_ord"))
