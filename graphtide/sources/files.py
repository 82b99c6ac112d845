"""File sources: worktree files, empty sources, commits of a repository, patches, metric and benchmark files, golden tests."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphtide.runtime import cut

FILES_SCHEMA = "path string, rev string, content binary, n_bytes long, content_hash string"
METRICS_SCHEMA = (
    "patch_name string, edits_count long, full_timings_ms long, incremental_timings_ms long, same int, full_nodes long, full_edges long, "
    "incremental_nodes long, incremental_edges long, lines_changed long, file_size_bytes long, commit_hash string, file_path string"
)


def worktree(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """Files under a path or glob with their bytes and hash. A path that does not exist is an error; the reader leaves out files of no bytes."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    f = r.load(path)
    return f.select("path", F.lit(None).cast("string").alias("rev"), "content", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("content_hash"))


def empty(spark: SparkSession) -> DataFrame:
    """A source that exists and has no bytes."""
    none = F.lit("").cast("binary")
    return spark.range(1).select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("rev"), none.alias("content"), F.lit(0).cast("long").alias("n_bytes"), F.sha2(none, 256).alias("content_hash"))


def listing(files: DataFrame, folder: str) -> DataFrame:
    """Entries directly below a folder: files, and the folders that hold further ones."""
    rest = F.regexp_replace("path", "^.*?" + folder.rstrip("/").replace(".", r"\.") + "/", "")
    inside = files.filter(F.contains("path", F.lit(folder.rstrip("/") + "/"))).select(F.split(rest, "/").alias("p"))
    return inside.select(F.col("p")[0].alias("name"), (F.size("p") > 1).alias("is_folder")).distinct()


def exists(wanted: DataFrame, files: DataFrame) -> DataFrame:
    known = files.select("path").distinct().withColumn("found", F.lit(True))
    return wanted.join(known, "path", "left").fillna(False, ["found"])


def text(files: DataFrame) -> DataFrame:
    """Contents decoded; bytes that are not UTF-8 are replaced."""
    return files.withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))


def changed(files: DataFrame) -> DataFrame:
    """Versions that differ from the one before (new ones too). files: path, step, content_hash, ..."""
    before = F.lag("content_hash").over(Window.partitionBy("path").orderBy("step"))
    return files.withColumn("previous", before).filter(~F.col("previous").eqNullSafe(F.col("content_hash"))).withColumn("same", F.when(F.col("previous").isNull(), 2)).drop("previous")


class _Commit(InputPartition):
    def __init__(self, step: int, rev: str):
        super().__init__(step)
        self.step, self.rev = step, rev


class _GitReader(DataSourceReader):
    def __init__(self, options):
        self.repo, self.count, self.suffix, self.part = options["path"], int(options.get("commits", "10")), options.get("suffix", ".c"), options.get("contains", "")

    def _git(self, *args: str) -> bytes:
        return subprocess.run(["git", "-c", "safe.directory=*", "-C", self.repo, *args], check=True, capture_output=True).stdout

    def partitions(self):
        revs = self._git("rev-list", "--first-parent", f"--max-count={self.count + 1}", "HEAD").decode().split()
        return [_Commit(i, r) for i, r in enumerate(reversed(revs))]

    def read(self, partition) -> Iterator[tuple]:
        for line in self._git("ls-tree", "-r", "-z", partition.rev).decode(errors="replace").split("\0"):
            if not line:
                continue
            meta, path = line.split("\t", 1)
            if meta.split()[1] == "blob" and path.endswith(self.suffix) and self.part in path:
                content = self._git("cat-file", "blob", meta.split()[2])
                if content:
                    yield partition.step, partition.rev, path, content


class GitSource(DataSource):
    """format("git"): files of the newest commits of a repository, oldest first, one partition for each commit.

    Options: path, commits (10), suffix (.c), contains.
    """

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return "step int, rev string, path string, content binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _GitReader(self.options)


def git(spark: SparkSession, repo: str, commits: int = 10, suffix: str = ".c", contains: str = "") -> DataFrame:
    spark.dataSource.register(GitSource)
    return spark.read.format("git").option("commits", str(commits)).option("suffix", suffix).option("contains", contains).load(repo)


def patches(spark: SparkSession, path: str) -> DataFrame:
    """(dir, patch_index, op, info, diff) of *.patch files named NNN_op_info; a repeated index in a directory is an error."""
    f = spark.read.option("pathGlobFilter", "*.patch").option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), F.col("value").alias("diff"))
    parts = F.split(F.regexp_extract("p", r"([^/]+)\.patch$", 1), "_")
    out = f.select(F.regexp_extract("p", r"^(.*)/[^/]+$", 1).alias("dir"), parts[0].cast("int").alias("patch_index"), F.get(parts, 1).alias("op"), F.array_join(F.slice(parts, 3, 100), "_").alias("info"), "diff")
    once = out.groupBy("dir", "patch_index").agg(F.count("*").alias("n"), F.first("op").alias("op"), F.first("info").alias("info"), F.first("diff").alias("diff"))
    return once.filter(F.assert_true(F.col("n") == 1, F.lit("two patches have one index")).isNull()).drop("n")


def metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    """Metric files with a repo column from the file's name; older files without the last columns give nulls there."""
    df = spark.read.option("header", "true").option("enforceSchema", "false").option("mode", "PERMISSIVE").csv(path)
    want = T._parse_datatype_string(METRICS_SCHEMA)
    cols = [F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want.fields]
    return df.select(*cols, F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1).alias("repo"))


BENCHMARK_SCHEMA = (
    "step long, commit string, files array<struct<file:string, unchanged:boolean, full_nodes:long, full_edges:long, incremental_nodes:long, incremental_edges:long, comparison_result:string, "
    "full_parse_time_ms:double, incremental_parse_time_ms:double, cpg_update_time_ms:double, comparison_time_ms:double, detailed_timings:map<string,double>, file_metrics:map<string,double>>>"
)


def benchmark_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad files) of benchmark_<repo>_<tactic>.json: one row for each file of each commit; maps stay maps."""
    read = spark.read.schema(BENCHMARK_SCHEMA + ", _corrupt_record string").option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    raw = cut(read.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"[^/]+$", 0).alias("name")))
    named = raw.withColumns({"repo": F.regexp_extract("name", r"benchmark_(.+)_([^_]+)\.json$", 1), "tactic": F.regexp_extract("name", r"benchmark_(.+)_([^_]+)\.json$", 2)})
    rows = named.filter("_corrupt_record IS NULL").select("repo", "tactic", "step", "commit", F.explode("files").alias("f")).select("repo", "tactic", "step", "commit", "f.*")
    return rows, named.filter("_corrupt_record IS NOT NULL").select("name").distinct()


def flattened(rows: DataFrame, column: str, prefix: str, keys: list[str]) -> DataFrame:
    """A map's wanted keys as prefixed columns."""
    return rows.withColumns({f"{prefix}_{k}": F.col(column)[k] for k in keys}).drop(column)


def golden_tests(spark: SparkSession, path: str) -> DataFrame:
    """(suite, case_no, name, lang, original, modified, expected) of test files: cases between lines of "=", parts between lines of "-".

    Blank lines are dropped, as the expected offsets leave them out.
    """
    f = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("suite"), F.regexp_replace("value", r"\n\s*\n", "\n").alias("t"))
    blocks = f.select("suite", F.posexplode(F.split("t", r"(?m)^={3,}\s*$\n?")).alias("b", "block")).filter("trim(block) <> ''")
    # header and body alternate
    pairs = blocks.select("suite", F.floor((F.col("b") - 1) / 2).cast("int").alias("case_no"), (F.col("b") % 2 == 1).alias("head"), "block")
    c = pairs.groupBy("suite", "case_no").agg(F.max(F.when(F.col("head"), F.col("block"))).alias("h"), F.max(F.when(~F.col("head"), F.col("block"))).alias("body"))
    h, p = F.split(F.trim("h"), "\n"), F.split("body", r"(?m)^-{3,}\s*$\n?")
    return c.select("suite", "case_no", F.trim(h[0]).alias("name"), F.trim(F.get(h, 1)).alias("lang"), F.get(p, 0).alias("original"), F.get(p, 1).alias("modified"), F.trim(F.get(p, 2)).alias("expected"))


def expected_ranges(tests: DataFrame) -> DataFrame:
    """{start,end,(r,c),(r,c)} lines of the expected part; "-" is null and matches anything."""
    line = F.explode(F.split("expected", "\n")).alias("l")
    num = lambda i: F.regexp_extract("l", r"\{(\d+),(\d+),\((\d+),(\d+)\),\((\d+),(\d+|-)\)\}", i).try_cast("long")
    return tests.select("suite", "case_no", line).select("suite", "case_no", *[num(i).alias(n) for i, n in enumerate(("start", "end", "start_row", "start_col", "end_row", "end_col"), 1)]).filter("start IS NOT NULL")


def sexp_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, depth, kind, is_edge, cid, start, end, name, ref): one row for each line of S-expression files."""
    f = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), "value")
    return parsed_sexp(f, ["file"], "value")


def parsed_sexp(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """The lines of S-expressions, keyed by the columns of key; ref: the id of a visited marker."""
    f = texts.select(*key, F.posexplode(F.split(text, "\n")).alias("line", "l"))
    part = lambda p, i=1: F.nullif(F.regexp_extract("l", p, i), F.lit(""))
    return f.select(
        *key, "line", (F.length(F.regexp_extract("l", "^ *", 0)) / 2).cast("int").alias("depth"), F.coalesce(part(r"^\s*\((?:->\s+)?(\w+)"), part(r"^\s*(\w+) \[visited")).alias("kind"), F.contains("l", F.lit("(->")).alias("is_edge"),
        part(r':canonical-id "(\d+)"').cast("long").alias("cid"), part(r':span "\((\d+), (\d+)\)"').cast("long").alias("start"), part(r':span "\((\d+), (\d+)\)"', 2).cast("long").alias("end"), part(r':name "([^"]*)"').alias("name"),
        part(r'\[visited "(\d+)"\]').cast("long").alias("ref"),
    ).filter("kind IS NOT NULL")


def sexp_graph(lines: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of parsed lines. nodes: key, node_id, kind, start, end, name, parent_id; edges: key, src, dst, edge_type, visited.

    A line belongs to the last line one level up before it: the lines that offer themselves to a level and those that ask there
    stand in one window, and the last offer is carried forward. Visited markers give edges to nodes written before.
    """
    offer = lambda what, down: lines.filter(what).select(*key, (F.col("depth") + down).alias("at"), "line", F.struct("kind", "cid", "depth").alias("up"), F.lit(None).cast("struct<kind:string,cid:bigint,start:bigint,end:bigint,name:string,ref:bigint>").alias("own"))
    own = F.struct("kind", "cid", "start", "end", "name", "ref")
    asks = lines.filter("NOT is_edge").select(*key, F.col("depth").alias("at"), "line", F.lit(None).cast("struct<kind:string,cid:bigint,depth:int>").alias("up"), own.alias("own"))
    w = Window.partitionBy(*key, "at").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    carried = lambda offers: offers.unionByName(asks).withColumn("above", F.last("up", ignorenulls=True).over(w)).filter("own IS NOT NULL").select(*key, "line", "own", "above")
    node = carried(offer("cid IS NOT NULL", 2)).select(*key, "line", "own", F.col("above.cid").alias("parent"))
    edge = carried(offer("is_edge", 1)).select(*key, "line", F.col("above.kind").alias("edge_type"))
    both = node.join(edge, [*key, "line"])
    nodes = both.filter("own.ref IS NULL").select(*key, F.col("own.cid").alias("node_id"), "own.kind", "own.start", "own.end", "own.name", F.when(F.col("edge_type").isNotNull(), F.col("parent")).alias("parent_id"))
    edges = both.filter("edge_type IS NOT NULL AND parent IS NOT NULL").select(*key, F.col("parent").alias("src"), F.coalesce("own.ref", "own.cid").alias("dst"), "edge_type", F.col("own.ref").isNotNull().alias("visited"))
    return nodes, edges
