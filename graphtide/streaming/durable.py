"""A change feed that outlives its session: a log by epoch, listeners with offsets, suspension and replay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.runtime import exists, listed, mark, remove


class DurableListeners:
    """Named listeners on property changes that each get every batch of the log once, in order of epochs.

    A batch is first written to the log, then handed to the listeners from where each of them is; an offset moves on when
    the listener's call has returned. After a failure in between the call is made again with the same epoch, so a listener
    writes its output by epoch (overwriting it) to be exact. While the feed is suspended, batches are logged only. All of
    this is in the folder: another session goes on where the last one ended. A listener that is new starts at the beginning
    of the log, or where start() puts it.
    """

    ALL = "*"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._calls: dict[str, tuple[str, Callable[[DataFrame, int], None]]] = {}

    def on(self, key: str, name: str, call: Callable[[DataFrame, int], None]) -> None:
        """call(rows, epoch) for the changes of a key, or of ALL; a listener of one name replaces the earlier one and keeps its offset."""
        self._calls[name] = (key, call)

    def off(self, name: str) -> None:
        self._calls.pop(name, None)

    def epochs(self) -> list[int]:
        return sorted(int(e) for e in listed(self.spark, f"{self.folder}/log") if exists(self.spark, f"{self.folder}/log/{e}/_SUCCESS"))

    def offset(self, name: str) -> int:
        """The last epoch that a listener is done with; -1 at the beginning."""
        return max([-1, *(int(e) for e in listed(self.spark, f"{self.folder}/offsets/{name}"))])

    def start(self, name: str, epoch: int) -> None:
        """The listener gets everything after this epoch, again if need be."""
        remove(self.spark, f"{self.folder}/offsets/{name}")
        if epoch >= 0:
            mark(self.spark, f"{self.folder}/offsets/{name}/{epoch}")

    def attach(self, batch: DataFrame, epoch: int) -> None:
        """A foreachBatch function: batch has node_id, key and value. An epoch that is logged is not logged again."""
        if not exists(self.spark, f"{self.folder}/log/{epoch}/_SUCCESS"):
            batch.write.mode("overwrite").parquet(f"{self.folder}/log/{epoch}")
        if not self.suspended():
            self._deliver()

    def _deliver(self) -> None:
        epochs = self.epochs()
        for name, (key, call) in self._calls.items():
            done = self.offset(name)
            for epoch in (e for e in epochs if e > done):
                rows = self.spark.read.parquet(f"{self.folder}/log/{epoch}")
                call(rows if key == self.ALL else rows.filter(F.col("key") == key), epoch)
                mark(self.spark, f"{self.folder}/offsets/{name}/{epoch}")
                if done >= 0:
                    remove(self.spark, f"{self.folder}/offsets/{name}/{done}")
                done = epoch

    def suspended(self) -> bool:
        return exists(self.spark, f"{self.folder}/suspended")

    def suspend(self) -> None:
        mark(self.spark, f"{self.folder}/suspended")

    def resume(self) -> None:
        """What was held is handed out now."""
        remove(self.spark, f"{self.folder}/suspended")
        self._deliver()


def by_epoch(folder: str) -> Callable[[DataFrame, int], None]:
    """A listener that writes its changes to a table by epoch; a repeated call changes nothing."""

    def call(rows: DataFrame, epoch: int) -> None:
        rows.select("node_id", "key", F.col("value").cast("string").alias("value")).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return call
