"""Session builder, table access and lineage cuts shared by the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def session(app: str = "graphtide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; a cluster's own settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MEASURED: list[tuple[SparkSession, SparkSession, dict[str, str]]] = []

#: For measured(): rows with megabytes of text. Few pass through Python at a time, a writer looks at its memory after every row and not first
#: after a hundred, and groups of rows are short, as a reader holds one at a time, up to 4096 rows, by their compressed size. The settings hold for whoever writes the result.
LONG_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4", "parquet.block.row.count.limit": "16", "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}


def measured(spark: SparkSession, also: dict[str, str] | None = None) -> SparkSession:
    """A session of its own with the caller's settings, in which a join broadcasts only what an exchange has measured to be small.

    Estimates are too low for compressed files and for tables that a parser makes longer: by them, the driver would hold a table
    that grows with the input. Settings are taken over at every call. also: further settings, in a session of their own.
    """
    if any(own is spark for _, own, _ in _MEASURED):
        return spark
    also = also or {}
    own = next((o for s, o, x in _MEASURED if s is spark and x == also), None)
    if own is None:
        own = spark.newSession()
        _MEASURED[:] = [x for x in _MEASURED if x[0].sparkContext.applicationId == spark.sparkContext.applicationId] + [(spark, own, also)]
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    own.conf.set(adaptive, spark.conf.get(adaptive, None) or spark.conf.get(static))
    own.conf.set(static, "-1")
    # rows that lie together by graph are joined by (graph, node) where they are
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    for key, value in also.items():
        own.conf.set(key, value)
    return own


#: Bytes of compressed input for each part of a table that is derived from it: a part is sorted in memory.
PART_BYTES = 8 << 20


def parts_of(spark: SparkSession, inputs: list[str]) -> int:
    """Parts for a table that is derived from these files: as many as the session runs at a time, and more as the files grow."""
    length = sum(fs.getContentSummary(at).getLength() for fs, at in (_at(spark, p) for p in inputs) if fs.exists(at))
    return max(1, spark.sparkContext.defaultParallelism, -(-length // PART_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only where it is unset (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphtide-ckpt-"))
    return sc.getCheckpointDir()


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tidy(spark: SparkSession):
    """Jobs that run inside leave no shuffle files behind: their results are tables, so nothing reads those again."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of fewer rows for the jobs that run inside: rows with whole texts or sets are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    return _set(spark, key, str(min(rows, before) if before > 0 else rows))


def cut(df: DataFrame, *instead: DataFrame) -> DataFrame:
    """Materialise in the checkpoint folder, so that a lost executor costs no recomputation.

    instead: tables that came from cut and that nothing reads any more once the new one is there; their files are taken
    down, so a loop holds the tables of one round however many rounds it has.
    """
    ensure_checkpoint_dir(df.sparkSession)
    with tidy(df.sparkSession):
        new = df.checkpoint(eager=True)
    for old in instead:
        uncut(old)
    return new


def uncut(*tables: DataFrame) -> None:
    """Take down tables that came from cut."""
    for df in tables:
        folder = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if folder.isDefined():
            remove(df.sparkSession, folder.get())


class Shelf:
    """Intermediate tables as compressed Parquet in the checkpoint folder, taken down together when they are done with.

    What is still up when the driver's process ends is taken down then: results that a caller may read until the end.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{ensure_checkpoint_dir(spark)}/shelf-{uuid.uuid4()}", 0
        self.named: list[str] = []

    def put(self, df: DataFrame, by: str | None = None, parts: int = 0) -> DataFrame:
        """by: rows of equal values lie in one of the parts, where windows, joins and groups that have the column among their keys find them."""
        if not self.n:
            atexit.register(self.clear)
        self.n += 1
        at, out = f"{self.folder}/{self.n}", df.write.option("compression", "zstd")
        with tidy(df.sparkSession):
            if by is None:
                out.parquet(at)
                return df.sparkSession.read.parquet(at)
            self.named.append(f"shelf_{uuid.uuid4().hex}")
            out.bucketBy(parts, by).format("parquet").option("path", at).saveAsTable(self.named[-1])
        return df.sparkSession.table(self.named[-1])

    def clear(self) -> None:
        atexit.unregister(self.clear)
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.folder)
        with suppress(Py4JError, OSError):  # at the end of the process the JVM may be gone
            for name in self.named:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            path.getFileSystem(sc._jvm.org.apache.hadoop.conf.Configuration() if sc._jsc is None else sc._jsc.hadoopConfiguration()).delete(path, True)


def _at(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none if it is not there."""
    fs, at = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def mark(spark: SparkSession, path: str) -> None:
    """An empty file."""
    fs, at = _at(spark, path)
    fs.create(at, True).close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


_STORES: dict[tuple, tuple[str, ...]] = {}


def _status(spark: SparkSession, path: str) -> tuple:
    """Length and latest change of a file or folder; empty if it is not there."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return ()
    files = [fs.getFileStatus(at), *fs.listStatus(at)]
    return len(files), sum(f.getLen() for f in files), max(f.getModificationTime() for f in files)


def stored(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame], by: str | None = None, parts: int = 0) -> DataFrame:
    """build() as a table of the checkpoint folder, written once for a session and unchanged inputs: what many queries start from. by, parts: as Shelf has them."""
    key = (spark.sparkContext.applicationId, name, *((p, *_status(spark, p)) for p in inputs))
    if key not in _STORES or not _status(spark, f"{_STORES[key][0]}/_SUCCESS"):
        shelf = Shelf(spark)
        shelf.put(build(), by, parts)
        _STORES[key] = f"{shelf.folder}/1", *shelf.named
    folder, *named = _STORES[key]
    return spark.table(named[0]) if named else spark.read.parquet(folder)
