"""A compact radix trie over byte strings, held as columns.

The leaves stand in depth-first order, which is byte order; depth() says of each leaf how far it goes along the path of
the one before, so that the branching nodes of the trie are the places where that path is left. Counters hang at the
leaves: occurrences and documents by group. Tries are merged, cut by prefixes and walked without a Python object per term.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

COUNTERS = ("group", "count", "docs")
#: Rows of pieces(): a prefix, an estimate of the size in memory, what follows the prefix in each term, and the counters.
PIECE = "head binary, bytes long, rest array<binary>, sizes array<int>, `group` array<int>, count array<long>, docs array<long>"
_NAMES = ["head", "bytes", "rest", "sizes", *COUNTERS]
_ROWS = 1000


def _raw(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column."""
    _, offsets, data = terms.buffers()
    off = np.frombuffer(offsets, np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64) if len(terms) else np.zeros(1, np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)


def _part(terms: pa.Array, depth: int, head: bool) -> pa.Array:
    """The first depth bytes of each term, or what follows them."""
    off, data = _raw(terms)
    size = np.diff(off)
    first = np.arange(off[-1] - off[0]) - np.repeat(off[:-1] - off[0], size) < depth
    lengths = np.minimum(size, depth) if head else np.maximum(size - depth, 0)
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer(ends), pa.py_buffer(data[off[0] : off[-1]][first if head else ~first])])


def _lists(ends: np.ndarray, values: pa.Array | np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind) if isinstance(values, np.ndarray) else values)


@dataclass
class Trie:
    """terms: the leaves' paths, sorted and distinct. line: of each counter, which leaf it hangs at; sorted by line, then group."""

    terms: pa.Array
    line: np.ndarray
    group: np.ndarray
    count: np.ndarray
    docs: np.ndarray

    def __len__(self) -> int:
        return len(self.line)

    @staticmethod
    def build(terms: pa.Array, line: np.ndarray, group: np.ndarray, count: np.ndarray, docs: np.ndarray) -> Trie:
        """From terms in any order, repeated or not, and counters that name them by line."""
        coded = terms.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        line = rank[coded.indices.to_numpy()[line]] if len(order) else line
        groups = int(group.max(initial=0)) + 1
        key = line * groups + group
        by = np.argsort(key, kind="stable")
        key = key[by]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        added = [np.add.reduceat(v[by], first) if len(first) else np.zeros(0, np.int64) for v in (count, docs)]
        return Trie(coded.dictionary.take(pa.array(order)), key[first] // groups, key[first] % groups, *added)

    @staticmethod
    def merge(tries: list[Trie]) -> Trie:
        """One trie with the counters of all added up."""
        if len(tries) == 1:
            return tries[0]
        starts = np.cumsum([0, *(len(t.terms) for t in tries)])
        terms = pa.concat_arrays([t.terms for t in tries]) if tries else pa.array([], pa.binary())
        line = np.concatenate([np.zeros(0, np.int64), *(t.line + s for t, s in zip(tries, starts, strict=False))])
        return Trie.build(terms, line, *(np.concatenate([np.zeros(0, np.int64), *(getattr(t, c) for t in tries)]) for c in COUNTERS))

    def depth(self) -> np.ndarray:
        """Of each leaf, the length of the path that it shares with the leaf before; 0 for the first."""
        off, data = _raw(self.terms)
        size, shared = np.diff(off), np.zeros(len(self.terms), np.int64)
        alive, at = np.arange(1, len(self.terms)), 0
        while len(alive):
            alive = alive[(size[alive] > at) & (size[alive - 1] > at)]
            alive = alive[data[off[alive] + at] == data[off[alive - 1] + at]]
            at += 1
            shared[alive] = at
        return shared

    def ends(self) -> np.ndarray:
        """Where the counters of each leaf begin; one more at the end."""
        return np.searchsorted(self.line, np.arange(len(self.terms) + 1))

    def cut(self, term: bytes) -> tuple[Trie, Trie]:
        """The leaves before a term, and those from it on."""
        lo, hi = 0, len(self.terms)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.terms[mid].as_py() < term else (lo, mid)
        at = int(np.searchsorted(self.line, lo))
        return (
            Trie(self.terms[:lo], *(v[:at] for v in (self.line, self.group, self.count, self.docs))),
            Trie(self.terms[lo:], self.line[at:] - lo, *(v[at:] for v in (self.group, self.count, self.docs))),
        )

    def pieces(self, depth: int) -> Iterator[pa.RecordBatch]:
        """The trie cut at the nodes of a depth: a row for each prefix of depth bytes, terms shorter than that alone."""
        if not len(self.terms):
            return
        first = np.flatnonzero((self.depth() < depth) | (np.arange(len(self.terms)) == 0))
        heads = _part(self.terms.take(pa.array(first)), depth, True)
        rest = _part(self.terms, depth, False)
        ends = self.ends()
        sizes = np.diff(ends)
        bounds = np.append(first, len(self.terms))
        inner = ends[bounds]
        held = np.diff(_raw(self.terms)[0][bounds]) + 16 * np.diff(bounds) + 32 * np.diff(inner)
        lists = [_lists(bounds, rest), _lists(bounds, sizes, pa.int32()), _lists(inner, self.group, pa.int32()), _lists(inner, self.count, pa.int64()), _lists(inner, self.docs, pa.int64())]
        batch = pa.RecordBatch.from_arrays([heads, pa.array(held, pa.int64()), *lists], names=_NAMES)
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)

    @staticmethod
    def of_pieces(batch: pa.RecordBatch) -> Trie:
        """The rows of pieces() as one trie."""
        column = {n: batch.column(batch.schema.get_field_index(n)) for n in _NAMES}
        rest = column["rest"].flatten()
        heads = column["head"].take(pa.array(np.repeat(np.arange(batch.num_rows), column["rest"].value_lengths().to_numpy())))
        line = np.repeat(np.arange(len(rest)), column["sizes"].flatten().to_numpy())
        return Trie.build(pc.binary_join_element_wise(heads, rest, pa.scalar(b"", pa.binary())), line, *(column[c].flatten().to_numpy().astype(np.int64) for c in COUNTERS))
