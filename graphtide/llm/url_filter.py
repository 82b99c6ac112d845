"""URL filter: a sorted array of 64-bit digests, probed by vectorised binary search.

Every rule is a host with a path prefix and an action. Its key, host + path, is digested with xxhash64; the
digests are sorted and written to a file that each Python worker maps into memory. A url gives one probe for
each suffix of its host and each path length that occurs among the rules; all probes of a batch are searched at
once, and a hit counts only if the stored full string is equal, so colliding digests do no harm.

Defined results: a null url, one without "://" or an empty one has an empty host and path and gets the default
verdict; no rule (an empty rule list) gives the default verdict for every row; of several rules that fit, the
one with the longest host + path wins, then the longest host. Rows are kept as they are, repeated ones too, and
other columns are not touched: the five result columns are appended under the names given, an existing column
of one of those names is replaced.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.llm.columns import guarded
from graphtide.runtime import table

#: The rules of the contract (host, path prefix, action).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: A rule list up to this many bytes is sent to the executors; a longer one is joined.
BROADCAST_BYTES = 32 << 20


class DigestArray:
    """Sorted digests in a memory-mapped file, with the full strings to confirm a hit."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        best = {}
        for host, path, action in rules:
            best[(host, path)] = action
        keys = sorted(best, key=lambda k: (xxhash.xxh64_intdigest(k[0] + k[1]), k))
        self.digests = np.array([xxhash.xxh64_intdigest(h + p) for h, p in keys], dtype=np.uint64)
        self.hosts = [h for h, _ in keys]
        self.paths = [p for _, p in keys]
        self.actions = [best[k] for k in keys]
        self.lengths = sorted({len(p) for p in self.paths}, reverse=True)
        self._mapped: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_mapped": None}

    def mapped(self) -> np.ndarray:
        """The digests as a memory map; the file has no name any more once it is mapped."""
        if self._mapped is None:
            if not len(self.digests):
                self._mapped = self.digests
            else:
                fd, name = tempfile.mkstemp(prefix="digests-")
                with os.fdopen(fd, "wb") as f:
                    f.write(self.digests.tobytes())
                self._mapped = np.memmap(name, dtype=np.uint64, mode="r")
                os.unlink(name)
        return self._mapped

    def search(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """The index of the winning rule for each (host, path), or -1."""
        keys = self.mapped()
        won = np.full(len(hosts), -1, dtype=np.int64)
        if not len(keys):
            return won
        owner, digest, tail, head = [], [], [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            if not host:
                continue
            at = 0
            while True:
                suffix = host[at:]
                for n in self.lengths:
                    if len(path) >= n:
                        owner.append(i)
                        digest.append(xxhash.xxh64_intdigest(suffix + path[:n]))
                        tail.append(suffix)
                        head.append(path[:n])
                dot = host.find(".", at)
                if dot < 0:
                    break
                at = dot + 1
        probes = np.array(digest, dtype=np.uint64)
        lo = np.searchsorted(keys, probes, side="left")
        hi = np.searchsorted(keys, probes, side="right")
        for j in np.flatnonzero(hi > lo):
            for k in range(lo[j], hi[j]):
                if self.hosts[k] == tail[j] and self.paths[k] == head[j]:
                    old = won[owner[j]]
                    if old < 0 or self._rank(k) > self._rank(old):
                        won[owner[j]] = k
        return won

    def _rank(self, k: int) -> tuple[int, int]:
        return len(self.hosts[k]) + len(self.paths[k]), len(self.hosts[k])


def host_path(url: str = "url") -> tuple:
    """Host and path columns, by built-in functions."""
    u = F.col(url)
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    host = F.translate(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


@guarded
def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict appended."""
    rules = list(rules)
    if sum(len(h) + len(p) + 16 for h, p, _ in rules) > BROADCAST_BYTES:
        return _joined(pages, rules, url, default)
    digests = pages.sparkSession.sparkContext.broadcast(DigestArray(rules))
    base = pages.drop("host", "path", "rule", "verdict").withColumns(dict(zip(("host", "path"), host_path(url), strict=True)))
    schema = base.schema.simpleString()[7:-1]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = digests.value
        for batch in batches:
            won = array.search(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            rule = pa.array([array.hosts[k] + array.paths[k] if k >= 0 else None for k in won], pa.string())
            verdict = pa.array([array.actions[k] if k >= 0 else default for k in won], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[*batch.schema.names, "rule", "verdict"])

    return base.mapInArrow(judge, _schema(base) + ", rule string, verdict string") if schema else base


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _joined(pages: DataFrame, rules: list[tuple[str, str, str]], url: str, default: str) -> DataFrame:
    """For rule lists of any length: probes are exploded and joined by digest; the longest confirmed rule wins."""
    spark = pages.sparkSession
    known = spark.createDataFrame(rules, "_h string, _p string, _a string").withColumn("_d", F.xxhash64(F.concat("_h", "_p")))
    lengths = sorted({len(p) for _, p, _ in rules})
    # a probe depends on the url alone: distinct urls are judged, then joined back
    host, path = host_path(url)
    urls = pages.select(F.col(url).alias("_u")).filter(F.col("_u").isNotNull()).distinct().withColumns(dict(zip(("_host", "_path"), host_path("_u"), strict=True)))
    parts = F.split("_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefixes = F.filter(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.when(F.length("_path") >= n, F.substring(F.col("_path"), F.lit(1), n))), lambda p: p.isNotNull())
    probes = (
        urls.filter("_host <> ''")
        .select("_u", F.explode(suffixes).alias("_s"), prefixes.alias("_ps"))
        .select("_u", "_s", F.explode("_ps").alias("_x"))
        .withColumn("_d", F.xxhash64(F.concat("_s", "_x")))
    )
    hit = probes.join(known, "_d").filter("_s = _h and _x = _p")
    best = hit.groupBy("_u").agg(F.max(F.struct((F.length("_h") + F.length("_p")).alias("n"), F.length("_h").alias("m"), "_h", "_p", "_a")).alias("_b"))
    out = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path}).join(best, F.col(url) == F.col("_u"), "left")
    return out.withColumns({"rule": F.concat("_b._h", "_b._p"), "verdict": F.coalesce("_b._a", F.lit(default))}).drop("_u", "_b")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id,
  translate(coalesce(regexp_extract(rest, '^[^/?#]*', 0), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(rh, rp, act) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(act, length(rh || rp)) AS act
  FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(act, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)
"""
