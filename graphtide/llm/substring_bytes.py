"""Suffix-array dedup on bytes by threshold-bounded interval expansion.

Anchors are the least GRAM-byte strings of each window, so equal windows meet under one key. The different
fragments of a key's partition are concatenated, their suffixes sorted, and the Burrows-Wheeler transform is
extended backward breadth-first: level by level, the intervals of all strings of one length fix the boundaries between
suffixes whose common prefix has that length. The expansion stops at the minimum length; suffixes with no boundary between
them share at least that much, and the least id of each such interval is the answer for its windows.

Defined results: null and empty texts have no bytes; texts shorter than the minimum length lose nothing; equal ids
never remove from each other; rows with a null id lose nothing and remove nothing. Kept bytes may cut a
character, so kept_bytes is binary. Result columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.llm import kernels as K
from graphtide.llm import windows as W
from graphtide.llm.columns import guarded
from graphtide.runtime import table

MIN_LENGTH = 50
GRAM = 20
#: Fragments are solved in blocks of whole keys of about so many bytes.
BLOCK_BYTES = 1 << 18
_U = np.uint64


def make(b: np.ndarray, offsets: np.ndarray):
    prefix = W.Prefix(K.BYTE_CODE[b])
    grams = prefix.all(GRAM)
    start = np.arange(len(grams))
    f = W.fragments(prefix, offsets, MIN_LENGTH, grams, start, start + GRAM, start) if len(grams) else None

    def payload(f: W.Fragments) -> pa.Array:
        """The bytes of each fragment."""
        count = f.count + MIN_LENGTH - 1
        return W.binaries(b[W.spread(f.first, count)], count)

    return f, prefix, offsets, payload


def suffix_array(text: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Order of all suffixes, each cut at the end of its own string (end[i] is the separator's place), ties by place."""
    n = len(text)
    rank = np.zeros(n, np.uint64)
    i = np.arange(n)
    for k in range(7):  # seven symbols of nine bits
        at = np.minimum(i + k, n - 1)
        rank = (rank << _U(9)) | np.where(i + k < end, text[at].astype(np.uint64) + _U(1), _U(0))
    longest, h = int((end - i).max()), 7
    order = np.argsort(rank, kind="stable")
    rank = _dense(rank, order)
    while h < longest:
        at = np.minimum(i + h, n - 1)
        pair = rank * _U(n + 1) + np.where(i + h < end, rank[at] + _U(1), _U(0))
        order = np.argsort(pair, kind="stable")
        rank = _dense(pair, order)
        h *= 2
    return order


def _dense(value: np.ndarray, order: np.ndarray) -> np.ndarray:
    up = np.append(False, value[order][1:] != value[order][:-1])
    rank = np.empty(len(value), np.uint64)
    rank[order] = np.cumsum(up).astype(np.uint64)
    return rank


def common_prefix_boundaries(bwt: np.ndarray, length: int) -> np.ndarray:
    """True at k if the suffixes k - 1 and k of the sorted order share fewer than `length` symbols.

    bwt: the symbol before each suffix, 0 for a separator. Backward extension, breadth-first by string length.
    """
    n = len(bwt)
    order = np.argsort(bwt, kind="stable")
    last = np.empty(n, np.int64)  # the LF mapping
    last[order] = np.arange(n)
    fixed = np.zeros(n + 1, bool)
    fixed[0] = fixed[n] = True
    seps = int((bwt == 0).sum())
    lo, hi = np.array([0]), np.array([n])
    for level in range(length):
        size = hi - lo
        at = W.spread(lo, size)
        owner = np.repeat(np.arange(len(lo)), size)
        symbol = bwt[at]
        keep = symbol > 0
        at, owner, symbol = at[keep], owner[keep], symbol[keep]
        if len(at):
            by = np.argsort(symbol, kind="stable")
            to, owner, symbol = last[at[by]], owner[by], symbol[by]
            head = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])))
            a = to[head]
            z = to[np.append(head[1:], len(to)) - 1] + 1
        else:
            a = z = np.zeros(0, np.int64)
        if level == 0 and seps:  # strings that begin at a separator: only the root extends by one
            a, z = np.append(a, 0), np.append(z, seps)
        new = ~fixed[z]
        fixed[z] = True
        a, z = a[new], z[new]
        first = np.argsort(a, kind="stable")
        lo, hi = a[first], z[first]
        if not len(lo):
            break
    return fixed[:n]


def window_classes(strings: np.ndarray, sizes: np.ndarray, length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(places of windows, their classes): windows of the strings are in one class if and only if they are equal."""
    full = sizes + 1
    n = int(full.sum())
    begin = np.cumsum(full) - full
    text = np.zeros(n, np.uint16)
    text[W.spread(begin, sizes)] = strings.astype(np.uint16)
    end = np.repeat(begin + sizes, full)
    order = suffix_array(text, end)
    before = order - 1
    symbol = np.where(before >= 0, text[before] + 1, 0).astype(np.uint16)
    symbol[(before < 0) | (before == end[before])] = 0
    boundary = common_prefix_boundaries(symbol, length)
    name = np.empty(n, np.int64)
    name[order] = np.cumsum(boundary)
    place = W.spread(begin, np.maximum(sizes - length + 1, 0))
    return place, name[place]


def solve(counts: np.ndarray, off: np.ndarray, key: np.ndarray, payload: pa.Array, least: np.ndarray) -> np.ndarray:
    data = np.frombuffer(payload.buffers()[2], np.uint8)
    ends = np.frombuffer(payload.buffers()[1], np.int32)[payload.offset : payload.offset + len(payload) + 1].astype(np.int64)
    sizes = np.diff(ends)
    out = np.empty(int(counts.sum()), np.int64)
    done = lo = 0
    edge = np.flatnonzero(np.append(key[1:] != key[:-1], True)) + 1  # ends of keys
    while lo < len(counts):
        full = np.searchsorted(ends[edge], ends[lo] + BLOCK_BYTES, side="right") - 1
        hi = int(max(edge[max(full, 0)], edge[np.searchsorted(edge, lo, side="right")]))
        _, name = window_classes(data[ends[lo] : ends[hi]], sizes[lo:hi])
        ids = np.repeat(least[lo:hi], counts[lo:hi])
        order = np.argsort(name, kind="stable")
        head = np.flatnonzero(np.append(True, name[order][1:] != name[order][:-1]))
        low = np.minimum.reduceat(ids[order], head)
        part = np.empty(len(ids), np.int64)
        part[order] = np.repeat(low, np.diff(np.append(head, len(ids))))
        out[done : done + len(ids)] = part
        done, lo = done + len(ids), hi
    return out


@guarded
def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_bytes and kept_sha256."""
    new = ("n_bytes", "n_removed", "n_spans", "kept_bytes", "kept_sha256")
    found = W.removed(docs.drop(*new), make, solve, MIN_LENGTH, doc_id, text)
    plain = [c for c in docs.columns if c not in new]
    base = found.select(*[F.col(f"`{c}`") for c in plain], "__lo", "__hi", F.coalesce(F.col(text), F.lit("")).alias("__t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-3])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, spans, kept = [], [], [], []
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            los, his = batch.column(batch.num_columns - 3), batch.column(batch.num_columns - 2)
            for i in range(batch.num_rows):
                raw = texts[i].as_buffer().to_pybytes()
                total.append(len(raw))
                n = k = 0
                if los[i].is_valid:
                    lo, hi = np.asarray(los[i].values), np.asarray(his[i].values)
                    n, k = int((hi - lo).sum()), len(lo)
                    raw = b"".join(raw[a:z] for a, z in zip([0, *hi], [*lo, len(raw)], strict=True))
                gone.append(n)
                spans.append(k)
                kept.append(raw)
            sha = [hashlib.sha256(x).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-3], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(sha, pa.string())], names=[*batch.schema.names[:-3], *new]
            )

    return base.mapInArrow(cut, schema + ", n_bytes long, n_removed long, n_spans long, kept_bytes binary, kept_sha256 string")


def op5_substring_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE_SQL = None
