"""A stream of versions with its own source, and a commit processor with state by file, timers and time to live.

VersionFeed is a streaming source over a table of versions: an offset is the number of the last batch of steps that was
read, so that a restarted query goes on behind it and a failed batch is read again as it was. A partition of a batch is a
few files, which the tasks read themselves: the folder must be one that pyarrow opens (local, HDFS, S3 or GCS).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from graphtide.runtime import listed

VERSION_SCHEMA = "path string, step long, file string, content_hash string"
COMMIT_SCHEMA = "path string, step long, file string, action string"


class _Batch(InputPartition):
    def __init__(self, url: str):
        super().__init__(url)
        self.url = url


class _VersionReader(DataSourceStreamReader):
    """Batches of steps are the folders steps=N of the table, in order of N; their files are named by the option `files` (a JSON map)."""

    def __init__(self, options):
        self.files: dict[str, list[str]] = json.loads(options["files"])
        self.steps = sorted(map(int, self.files))
        self.most = int(options.get("batchesPerTrigger", "1"))
        self.at = -1

    def initialOffset(self) -> dict:
        return {"after": -1}

    def latestOffset(self) -> dict:
        """At most so many further batches; the engine's own record says how far the last run came."""
        ahead = [s for s in self.steps if s > self.at][: self.most]
        self.at = ahead[-1] if ahead else self.at
        return {"after": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["after"])
        return [_Batch(u) for s in self.steps if start["after"] < s <= end["after"] for u in self.files[str(s)]]

    def read(self, partition: _Batch) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pfs
        import pyarrow.parquet as pq

        if "://" in partition.url or partition.url.startswith("file:"):
            fs, path = pfs.FileSystem.from_uri(partition.url if "://" in partition.url else partition.url.replace("file:", "file://", 1))
        else:
            fs, path = pfs.LocalFileSystem(), partition.url
        with fs.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(columns=["path", "step", "file", "content_hash"])


class VersionFeed(DataSource):
    """format("versions"): a stream over write_versions() folders."""

    @classmethod
    def name(cls) -> str:
        return "versions"

    def schema(self) -> str:
        return VERSION_SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _VersionReader(self.options)


def write_versions(versions: DataFrame, folder: str, steps_per_batch: int = 1) -> None:
    """versions (path, step, file, content_hash) as folders of batches of steps."""
    v = versions.withColumn("steps", F.floor(F.col("step") / steps_per_batch).cast("long"))
    v.repartition("steps").write.mode("overwrite").partitionBy("steps").parquet(folder)


def version_stream(spark: SparkSession, folder: str, batches_per_trigger: int = 1) -> DataFrame:
    # a name is known to the session that registered it alone, yet refused to all others: every stream has its own
    own = f"versions_{uuid.uuid4().hex}"
    spark.dataSource.register(type("VersionFeed", (VersionFeed,), {"name": classmethod(lambda cls: own)}))
    files = {d.removeprefix("steps="): [f"{folder}/{d}/{f}" for f in listed(spark, f"{folder}/{d}") if f.endswith(".parquet")] for d in listed(spark, folder) if d.startswith("steps=")}
    return spark.readStream.format(own).option("files", json.dumps(files)).option("batchesPerTrigger", str(batches_per_trigger)).load()


class CommitProcessor(StatefulProcessor):
    """Per path, what each version does to each of its files: baseline, unchanged or changed; late versions change nothing.

    State: the last step and hash by file (a map), which a file loses after it has been idle for ttl_ms (none: never). A path
    without news for idle_ms is reported by a timer, once, as idle.
    """

    def __init__(self, ttl_ms: int | None = None, idle_ms: int | None = None):
        self.ttl_ms, self.idle_ms = ttl_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "file string", "step long, content_hash string", self.ttl_ms)
        self.latest = handle.getValueState("latest", "step long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, last = [], self.latest.get()[0] if self.latest.exists() else -1
        for r in pd.concat(list(rows)).sort_values(["step", "file"]).itertuples():
            old = self.files.getValue((r.file,)) if self.files.containsKey((r.file,)) else None
            if old is not None and r.step <= old[0]:
                out.append((key[0], r.step, r.file, "late"))
                continue
            out.append((key[0], r.step, r.file, "baseline" if old is None else "unchanged" if old[1] == r.content_hash else "changed"))
            self.files.updateValue((r.file,), (int(r.step), r.content_hash))
            last = max(last, r.step)
        self.latest.update((int(last),))
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0])
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["path", "step", "file", "action"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(key[0], self.latest.get()[0], None, "idle")], columns=["path", "step", "file", "action"])

    def close(self) -> None:
        pass


def commits(versions: DataFrame, ttl_ms: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """The processor over a stream of versions; the state store of the session must be RocksDB (see with_rocksdb)."""
    timed = "processingTime" if ttl_ms is not None or idle_ms is not None else "none"
    return versions.groupBy("path").transformWithStateInPandas(CommitProcessor(ttl_ms, idle_ms), COMMIT_SCHEMA, "append", timed)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """A session of its own, so that no other query's setting changes, whose streams keep state in RocksDB."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.session.timeZone", "UTC")
    return own
