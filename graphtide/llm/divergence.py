"""Audit of how the sources of a language diverge: mergeable radix tries of terms.

1. Every task counts the terms of its documents and puts them into a byte trie, with counters of occurrences and
   documents by (language, source) at the leaves. A trie that has grown to FLUSH counters is sent on and a new one begun.
2. A trie goes out in pieces, cut at the nodes that are HEAD bytes deep. The pieces are dealt by ranges of prefixes and
   sorted, so that a task merges the tries of few prefixes at a time and holds no others. A prefix with more than HEAVY
   bytes in all tasks together is cut deeper first, again if need be.
3. The merged tries are walked in byte order, which is the order of UTF-8: terms in enough documents of a language are
   kept, with their counters by group.
4. With the totals of all groups known, a second walk streams through the kept terms: it adds up the distance of each
   pair of sources of a language, and keeps the first terms of each group, by value and then by byte order.

All arithmetic is on whole numbers. The list of groups and their totals is sent to all tasks; the result has all pairs
of them, so it is small.

Defined results: null text, lang and source count as ''. Rows are documents, repeated ones too, and doc_id is not
read. Texts of any length are counted in slices. A language without kept terms has pairs of value 0 and no terms. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphtide.llm import kernels
from graphtide.llm.tries import PIECE, Trie
from graphtide.runtime import Shelf, small_batches, table

#: Terms in at least LEAST documents of a language are kept, TOP terms are listed, the unit and the addend of shares.
LEAST, TOP, UNIT, ADD = 30, 50, 1_000_000_000, 5
#: Fixed value: the bytes of terms, [^\x00-\x40\x5B-\x60\x7B-\x7F] over UTF-8.
IN_TERM = np.array([not (b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F) for b in range(256)])
#: Bytes of text that are cut into terms at once; a longer text is cut by itself, in slices of this size.
CHUNK = 4 << 20
#: Counters (a term and a group) that a task holds before it sends its trie on.
FLUSH = 1 << 20
#: Bytes of the first prefix, and of terms and counters under one prefix beyond which it is cut deeper.
HEAD, HEAVY = 3, 64 << 20
#: Bytes of terms and counters that one merging task reads, about.
TASK_BYTES = 64 << 20


def slices(text: np.ndarray, size: int = CHUNK) -> Iterator[np.ndarray]:
    """The text in pieces of about size bytes, none of which ends inside a term."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text):
            out = np.flatnonzero(~IN_TERM[text[end : end + size]])
            if len(out):
                end += int(out[0])
                break
            end += size
        yield text[at:end]
        at = end


def _terms(text: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts, lower-cased, and the row of each."""
    text = kernels.ascii_lower(text)
    inside = IN_TERM[text]
    start, end, row = kernels.spans(inside, offsets)
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(text[inside])]), row


def _trie(text: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> Trie:
    """The trie of some texts; groups: the group of each row."""
    terms, row = _terms(text, offsets)
    coded = terms.dictionary_encode()
    n = max(1, len(coded.dictionary))
    # one entry for each term of a row, with its occurrences there
    key, count = np.unique(row * n + coded.indices.to_numpy(), return_counts=True)
    return Trie.build(coded.dictionary, key % n, groups[key // n], count, np.ones(len(key), np.int64))


def _long_trie(text: np.ndarray, group: int) -> Trie:
    """The trie of one long text, slice by slice; all of it is one document."""
    trie = Trie.merge([])
    for part in slices(text):
        trie = Trie.merge([trie, _trie(part, np.array([0, len(part)]), np.array([group]))])
    trie.docs = np.ones(len(trie), np.int64)
    return trie


def _count(groups: dict[tuple[str, str], int], flush: int, chunk: int):
    """mapInArrow function: (text, lang, source) to pieces of tries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Trie] = []
        for batch in batches:
            of = np.array([groups[name] for name in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], dtype=np.int64)
            for lo, hi, text, offsets in kernels.chunks(batch.column(0), chunk):
                held.append(_long_trie(text, int(of[lo])) if len(text) > chunk else _trie(text, offsets, of[lo:hi]))
                if sum(map(len, held)) >= flush:
                    held = [Trie.merge(held)]
                    # what merging has not made much smaller is sent on
                    if len(held[0]) >= flush // 2:
                        yield from held.pop().pieces(HEAD)
        yield from Trie.merge(held).pieces(HEAD)

    return run


def _deeper(depth: int):
    """mapInArrow function: pieces cut by prefixes of depth bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from Trie.of_pieces(batch).pieces(depth)

    return run


def _kept(trie: Trie, langs: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """Terms in at least so many documents of a language, with the counters of its groups."""
    if not len(trie):
        return
    lang = langs[trie.group]
    # groups are numbered language by language, so the counters of a term and a language stand together
    first = np.flatnonzero(np.concatenate([[True], (trie.line[1:] != trie.line[:-1]) | (lang[1:] != lang[:-1])]))
    good = np.add.reduceat(trie.docs, first) >= least
    size = np.diff(np.append(first, len(trie)))
    inside, ends = np.repeat(good, size), np.concatenate([[0], np.cumsum(size[good])])
    first = first[good]
    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v[inside], kind)) for v, kind in ((trie.group, pa.int32()), (trie.count, pa.int64()))]
    yield pa.RecordBatch.from_arrays([pa.array(lang[first], pa.int32()), trie.terms.take(pa.array(trie.line[first])), *lists], names=["lang", "term", "group", "count"])


def _merge(langs: list[int], least: int):
    """mapInArrow function: pieces sorted by head to the terms kept. What may go on in the next batch waits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = np.array(langs), Trie.merge([])
        for batch in batches:
            done, held = Trie.merge([held, Trie.of_pieces(batch)]).cut(batch.column(0)[-1].as_py())
            yield from _kept(done, of, least)
        yield from _kept(held, of, least)

    return run


def share(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + ADD) / (total + ADD * terms)), exact."""
    if UNIT * (int(count.max(initial=0)) + ADD) >= 1 << 63:
        return np.array([1 + UNIT * (int(c) + ADD) // (total + ADD * terms) for c in count.ravel()], dtype=np.int64).reshape(count.shape)
    return 1 + UNIT * (count + ADD) // (total + ADD * terms)


def _stream(lang_groups: dict[int, list[int]], totals: dict[int, int], terms: dict[int, int], top: int):
    """mapInArrow function: kept terms to (lang, group, other, term, value): sums of pairs, and each group's first terms of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = {lang: np.zeros((len(g), len(g)), dtype=np.int64) for lang, g in lang_groups.items()}
        place = {lang: {g: i for i, g in enumerate(gs)} for lang, gs in lang_groups.items()}
        best: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for batch in batches:
            langs = batch.column(0).to_numpy()
            for lang in np.unique(langs).tolist():
                rows, own = np.flatnonzero(langs == lang), lang_groups[lang]
                part = batch.take(pa.array(rows))
                names = part.column(1).to_pylist()
                step = max(1, (1 << 20) // len(own))
                for at in range(0, len(rows), step):
                    some = part.slice(at, step)
                    counts = np.zeros((len(own), some.num_rows), dtype=np.int64)
                    lists = some.column(2)
                    line = np.repeat(np.arange(some.num_rows), lists.value_lengths().to_numpy())
                    counts[[place[lang][g] for g in lists.flatten().to_pylist()], line] = some.column(3).flatten().to_numpy()
                    p = np.stack([share(counts[i], totals[g], terms[lang]) for i, g in enumerate(own)])
                    for i in range(len(own) - 1):
                        pairs[lang][i, i + 1 :] += np.abs(p[i + 1 :] - p[i]).sum(axis=1)
                    q = share(counts.sum(axis=0), sum(totals[g] for g in own), terms[lang])
                    for i, g in enumerate(own):
                        more = p[i] - q
                        last = -best[g][-1][0] if len(best[g]) == top else 1
                        found = [(-int(more[j]), names[at + j]) for j in np.flatnonzero((counts[i] > 0) & (more >= last))]
                        best[g] = heapq.nsmallest(top, best[g] + found)
        out = []
        for lang, sums in pairs.items():
            for i, j in np.argwhere(sums):
                a, b, v = lang_groups[lang][i], lang_groups[lang][j], int(sums[i, j])
                out += [(a, b, None, v), (b, a, None, v)]
        out += [(g, None, term, -v) for g, first in best.items() for v, term in first]
        group, other, term, value = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(other, pa.int32()), pa.array(term, pa.binary()), pa.array(value, pa.int64())], names=["group", "other", "term", "value"])

    return run


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of the sources of a language, and the terms that mark each source."""
    spark = docs.sparkSession
    shelf = Shelf(spark)
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    names = sorted((r.lang, r.source) for r in docs.select("lang", "source").distinct().collect())
    groups = {name: i for i, name in enumerate(names)}
    lang_names = sorted({lang for lang, _ in names})
    langs = [lang_names.index(lang) for lang, _ in names]
    with small_batches(spark):
        pieces = shelf.put(docs.mapInArrow(_count(groups, FLUSH, CHUNK), PIECE))
        depth, done = HEAD, []
        # prefixes that are too heavy for one trie are cut deeper; a term that ends at its prefix goes no deeper
        while True:
            heavy = pieces.groupBy("head").agg(F.sum("bytes").alias("all")).filter((F.col("all") > HEAVY) & (F.length("head") == depth)).select("head")
            if heavy.isEmpty():
                break
            done.append(pieces.join(heavy, "head", "left_anti"))
            depth *= 2
            pieces = shelf.put(pieces.join(heavy, "head", "left_semi").mapInArrow(_deeper(depth), PIECE))
        for more in done:
            pieces = pieces.unionByName(more)
        size = pieces.agg(F.sum("bytes")).first()[0] or 0
        dealt = pieces.repartitionByRange(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES)), "head").sortWithinPartitions("head")
        kept = shelf.put(dealt.mapInArrow(_merge(langs, least), "lang int, term binary, `group` array<int>, count array<long>"))
        terms = {r.lang: r.n for r in kept.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        counted = kept.select(F.explode(F.arrays_zip("group", "count")).alias("c")).groupBy(F.col("c.group").alias("g")).agg(F.sum("c.count").alias("n"))
        totals = dict.fromkeys(range(len(names)), 0) | {r.g: r.n for r in counted.collect()}
        lang_groups: dict[int, list[int]] = defaultdict(list)
        for g, lang in enumerate(langs):
            lang_groups[lang].append(g)
        found = shelf.put(kept.mapInArrow(_stream(dict(lang_groups), totals, terms, top), "`group` int, other int, term binary, value long"))
    known = spark.createDataFrame([(i, lang, source) for i, (lang, source) in enumerate(names)], "g int, lang string, source string")
    a, b = known.alias("a"), known.alias("b")
    # every pair occurs, with 0 where nothing was added; the result has as many rows
    pairs = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.g") != F.col("b.g"))).select(F.col("a.g").alias("group"), F.col("b.g").alias("other"), F.lit(0).cast("long").alias("value"))
    pairs = pairs.unionByName(found.filter("other IS NOT NULL").select("group", "other", "value")).groupBy("group", "other").agg(F.sum("value").alias("value"))
    pairs = pairs.join(known.select(F.col("g").alias("other"), F.col("source").alias("item")), "other").select("group", F.lit("pair").alias("part"), "item", "value")
    marks = found.filter("term IS NOT NULL").select("group", F.lit("term").alias("part"), F.decode("term", "UTF-8").alias("item"), "value")
    order = Window.partitionBy("group", "part").orderBy(F.desc("value"), "item")
    ranked = [p.withColumn("rank", F.row_number().over(order)) for p in (pairs, marks)]
    rows = ranked[0].unionByName(ranked[1].filter(F.col("rank") <= top))
    return rows.join(known, F.col("group") == F.col("g")).select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, count(term) AS v FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN k ON g.lang = k.lang GROUP BY g.lang),
n AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
p AS (
  SELECT n.lang, n.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (n.total + 5 * v.v) AS p
  FROM n JOIN v USING (lang) JOIN k ON k.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c.n) + 5)) // (any_value(t.total) + 5 * any_value(v.v)) AS q
  FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM n GROUP BY lang) t USING (lang) GROUP BY lang, term),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""
