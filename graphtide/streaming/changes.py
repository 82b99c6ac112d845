"""Structured Streaming over versions and events: change feeds, stateful commits, windows.

Event-time columns without a zone are cast to timestamps first, as watermarks need them; the session's zone is UTC.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COMMIT_SCHEMA = "path string, step long, action string, content_hash string"
_STATE = "step long, content_hash string"


def commit_stream(versions: DataFrame) -> DataFrame:
    """What each version does to its path's state: baseline, unchanged or changed. versions: path, step, content_hash.

    The state of a path is its last step and hash. A version that is not newer than the state comes out as late and changes nothing.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        step, known = state.get if state.exists else (None, None)
        rows = []
        for r in pd.concat(list(batches)).sort_values("step").itertuples():
            if step is not None and r.step <= step:
                rows.append((key[0], r.step, "late", r.content_hash))
                continue
            rows.append((key[0], r.step, "baseline" if step is None else "unchanged" if known == r.content_hash else "changed", r.content_hash))
            step, known = r.step, r.content_hash
        if step is not None:
            state.update((int(step), known))
        yield pd.DataFrame(rows, columns=["path", "step", "action", "content_hash"])

    return versions.select("path", "step", "content_hash").groupBy("path").applyInPandasWithState(update, COMMIT_SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout)


def tumbling(events: DataFrame, size: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each event type by window of event time."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Events of a user without a pause of `gap`."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class Listeners:
    """Named callbacks on property changes, by key, with a wildcard that is told first; silent while suspended.

    A change feed is a DataFrame (node_id, key, value) for each micro-batch: attach() is its foreachBatch function. Callbacks
    get the rows of their key as a DataFrame, so that they stay distributed.
    """

    ALL = "*"

    def __init__(self):
        self._by_key: dict[str, dict[str, Callable[[DataFrame], None]]] = {}
        self._held: list[DataFrame] | None = None

    def on(self, key: str, name: str, call: Callable[[DataFrame], None]) -> None:
        """A listener of one name replaces the earlier one."""
        self._by_key.setdefault(key, {})[name] = call

    def off(self, key: str, name: str) -> None:
        self._by_key.get(key, {}).pop(name, None)

    def attach(self, batch: DataFrame, epoch: int = 0) -> None:
        if self._held is not None:
            self._held.append(batch)
            return
        for call in list(self._by_key.get(self.ALL, {}).values()):
            call(batch)
        for key, calls in self._by_key.items():
            if key != self.ALL and calls:
                rows = batch.filter(F.col("key") == key)
                for call in list(calls.values()):
                    call(rows)

    def suspend(self) -> None:
        self._held = [] if self._held is None else self._held

    def resume(self) -> None:
        held, self._held = self._held or [], None
        for batch in held:
            self.attach(batch)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """All that a stream gives for the input that is there now, as a table: run to its end with checkpoint and output in the folder."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def change_log(batch: DataFrame, folder: str) -> None:
    """A listener for Listeners.ALL that appends every property change to a table."""
    batch.select("node_id", "key", F.col("value").cast("string").alias("value")).write.mode("append").parquet(folder)


def insert_child(children: DataFrame, new: DataFrame) -> DataFrame:
    """children (graph_id, parent_id, node_id, child_ord) with new ones at their child_ord: later siblings move right by one.

    Orders are recomputed as a set; there is no chain of notifications from sibling to sibling.
    """
    from pyspark.sql import Window

    both = children.withColumn("__new", F.lit(1)).unionByName(new.withColumn("__new", F.lit(0)))
    w = Window.partitionBy("graph_id", "parent_id").orderBy("child_ord", "__new", "node_id")
    return both.withColumn("child_ord", F.row_number().over(w)).drop("__new")
