"""Substring dedup on words by recompression.

Rounds name tokens by content: runs of up to MAX_RUN equal symbols become one symbol, then pairs whose first symbol is
of the left class and whose second is of the right class (a hash bit of the name decides) become one. A name is a hash
of what it stands for, so equal word sequences get equal names everywhere, except near their ends, where the
surroundings decide; each symbol carries the extent of words that decided it. Neighbouring high-level symbols decided
inside a window are its anchors; documents that share one are compared, and windows are verified by 128 bits: the hash of
all their words (64), and the anchor and its place (64).

Defined results: null and empty texts have no words; texts under a window's length lose nothing; equal ids never
remove from each other; rows with a null id lose nothing and remove nothing. Result columns replace input columns of
the same name. Very long runs of one word stay unmerged, and windows without an inner symbol are compared
by their own hash.
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

WINDOW = 50
ROUNDS = 3
MAX_RUN = 4
#: An anchor is so many neighbouring symbols of the last round: one symbol alone may be a frequent word.
SYMBOLS = 5
_U = np.uint64


def recompress(code: np.ndarray, bounds: np.ndarray, rounds: int = ROUNDS):
    """(name, start, left, right): the symbols after the rounds; left and right bound the words that decided each."""
    n = len(code)
    name, start = code.copy(), np.arange(n)
    row = np.searchsorted(bounds, start, side="right") - 1
    left, right = start.copy(), start + 1
    # what a document's edge decided is decided by no window: these bounds lie outside the document, and ascend
    outside_left, outside_right = bounds[row] - 1, bounds[row + 1] + 1
    for r in range(rounds):
        if len(name) < 2:
            break
        # runs: up to MAX_RUN equal neighbours of one document; the neighbours of a run decide its length
        i = np.arange(len(name))
        head = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (row[1:] != row[:-1])))
        size = np.diff(np.append(head, len(name)))
        h, e, m = np.repeat(head, size), np.repeat(head + size - 1, size), np.repeat(size, size)
        before = np.where(m <= MAX_RUN, h - 1, np.maximum(h - 1, i - MAX_RUN - 1))
        after = np.where(m <= MAX_RUN, e + 1, np.minimum(e + 1, i + MAX_RUN + 1))
        left, right = _reach(before, row, left, outside_left), _reach(after, row, right, outside_right)
        name = np.where((m > 1) & (m <= MAX_RUN), K.mix(name * _U(0xC2B2AE3D27D4EB4F) + m.astype(np.uint64) + _U(1000 + r)), name)
        keep = (m > MAX_RUN) | (i == h)
        name, start, left, right, row, outside_left, outside_right = (x[keep] for x in (name, start, left, right, row, outside_left, outside_right))
        # pairs: left class, then right class; a pair needs no neighbour, another symbol the one it might have paired with
        i = np.arange(len(name))
        of_right = (K.mix(name + _U(0x1234567 + r)) >> _U(63)).astype(bool)
        joins = np.append((row[1:] == row[:-1]) & ~of_right[:-1] & of_right[1:], False)
        second = np.append(False, joins[:-1])
        at = np.flatnonzero(joins)
        new_left = np.where(of_right, _reach(i - 1, row, left, outside_left), left)
        new_right = np.where(of_right, right, _reach(i + 1, row, right, outside_right))
        new_left[at], new_right[at] = left[at], right[at + 1]
        name = name.copy()
        name[at] = K.mix(name[at] * _U(0x165667B19E3779F9) + name[at + 1] + _U(r))
        left, right, keep = new_left, new_right, ~second
        name, start, left, right, row, outside_left, outside_right = (x[keep] for x in (name, start, left, right, row, outside_left, outside_right))
    return name, start, left, right


def _reach(to: np.ndarray, row: np.ndarray, bound: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """bound of the symbol at `to`, or outside if that is not in the document."""
    ok = (to >= 0) & (to < len(row))
    at = np.where(ok, to, 0)
    return np.where(ok & (row[at] == row), bound[at], outside)


def anchors(code: np.ndarray, bounds: np.ndarray):
    """(name, left, right, start) of each SYMBOLS neighbouring symbols of one document."""
    name, start, left, right = recompress(code, bounds)
    n = len(name) - SYMBOLS + 1
    if n < 1:
        return name[:0], left[:0], right[:0], start[:0]
    joint = K.mix(name[:n])
    for j in range(1, SYMBOLS):
        joint = K.mix(joint * _U(0xD6E8FEB86659FD93) + name[j : n + j])
    row = np.searchsorted(bounds, start, side="right")
    one = row[:n] == row[SYMBOLS - 1 :]
    return joint[one], left[:n][one], right[SYMBOLS - 1 :][one], start[:n][one]


def make(b: np.ndarray, offsets: np.ndarray):
    _, _, row, code = K.words_of(b, offsets)
    bounds = K.row_bounds(row, len(offsets) - 1)
    prefix = W.Prefix(code)
    f = W.fragments(prefix, bounds, WINDOW, *anchors(code, bounds))

    def payload(f: W.Fragments) -> pa.Array:
        """The hash of each window."""
        return W.binaries(prefix.hash(W.spread(f.first, f.count), WINDOW).view(np.uint8), f.count * 8)

    return f, prefix, bounds, payload


def solve(counts: np.ndarray, off: np.ndarray, key: np.ndarray, payload: pa.Array, least: np.ndarray) -> np.ndarray:
    data = np.frombuffer(payload.buffers()[2], np.uint8)
    ends = np.frombuffer(payload.buffers()[1], np.int32)[payload.offset : payload.offset + len(payload) + 1]
    window = data[ends[0] : ends[-1]].copy().view(np.uint64)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    place = (np.repeat(off, counts) - inner).astype(np.uint64)
    # 128 bits: the hash of all words, and the anchor with its place in the window
    anchor = np.repeat(K.mix(key), counts) ^ K.mix(place)
    order = np.lexsort((anchor, window))
    w, a = window[order], anchor[order]
    head = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (a[1:] != a[:-1])))
    low = np.minimum.reduceat(np.repeat(least, counts)[order], head)
    out = np.empty(len(window), np.int64)
    out[order] = np.repeat(low, np.diff(np.append(head, len(window))))
    return out


@guarded
def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_words, n_removed, kept_text (kept words joined by one space) and kept_sha256."""
    new = ("n_words", "n_removed", "kept_text", "kept_sha256")
    found = W.removed(docs.drop(*new), make, solve, WINDOW, doc_id, text)
    plain = [c for c in docs.columns if c not in new]
    base = found.select(*[F.col(f"`{c}`") for c in plain], "__lo", "__hi", F.coalesce(F.col(text), F.lit("")).alias("__t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-3])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            los, his = batch.column(batch.num_columns - 3), batch.column(batch.num_columns - 2)
            for i in range(batch.num_rows):
                words = texts[i].as_buffer().to_pybytes().split()
                total.append(len(words))
                if los[i].is_valid:
                    mark = np.zeros(len(words) + 1, np.int64)
                    np.add.at(mark, np.asarray(los[i].values), 1)
                    np.add.at(mark, np.asarray(his[i].values), -1)
                    stay = np.flatnonzero(np.cumsum(mark[:-1]) == 0)
                    gone.append(len(words) - len(stay))
                    words = [words[k] for k in stay]
                else:
                    gone.append(0)
                kept.append(b" ".join(words))
            sha = [hashlib.sha256(x).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-3], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha, pa.string())], names=[*batch.schema.names[:-3], *new]
            )

    return base.mapInArrow(cut, schema + ", n_words long, n_removed long, kept_text string, kept_sha256 string")


def op7_substring_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = None
