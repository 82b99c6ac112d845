"""Repeats of fixed-size windows across documents: the frame that byte and word repeats share.

A document is a sequence of units (bytes or words) and a window is `size` consecutive units. A window that also starts
in a document with a smaller id marks its units for removal. Every window chooses one anchor among the symbols inside it,
by the window's content alone, so equal windows choose equal anchors; consecutive windows with one anchor form a fragment.

1. keys      short sorted keys of each group of texts meet by bucket. Bitmaps, sized by what was found up to MAX_BITS, then tell
             anchors that two documents have; those of them with more than one fragment (hard); and those with many (crowded),
             whose windows become fragments of their own, keyed by the whole window, so that no key gathers the
             surroundings of a frequent passage. A bitmap that is too small passes more; results stay the same.
2. requests  a group of texts asks once for each of its different fragments of shared anchors, so that a passage of every document
             gives a row for each group of texts and not for each document. Units are sent for hard ones only.
3. answers   the least id for each fragment; within a hard key, for each window of each fragment (by the caller's method).
4. ranges    answers meet the places of the group's fragments, and the ranges of each document meet its text.

Requests, places and answers move as packed columns. Nothing is kept between the stages but the shuffles, so a lost executor costs
what it held. Rows are told apart by id and a hash of the text, so repeated ids do no harm; rows with a null id are
never smaller than others and lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtide.llm import kernels as K
from graphtide.runtime import Shelf

#: Bits of a short key, and of the largest bitmap (128 MB, a bound of the broadcast); places of a bitmap for each key.
KEY_BITS, MAX_BITS, SLOTS = 40, 30, 16
#: Text of one group.
GROUP_BYTES = 8 << 20
#: Different fragments (a batch counts each once) from which an anchor's windows are keyed by themselves.
CROWDED = 2000
_U = np.uint64


class Prefix:
    """Hashes of any stretch of units in constant time."""

    def __init__(self, code: np.ndarray):
        n = len(code)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(code * K.powers(K._BASE, n), out=self.total[1:])
        self.inverse = K.powers(K._INVERSE, n + 1)

    def hash(self, at: np.ndarray, length) -> np.ndarray:
        return K.mix((self.total[at + length] - self.total[at]) * self.inverse[at])

    def all(self, length: int) -> np.ndarray:
        """Of every stretch of that length, by its start."""
        n = len(self.total) - 1
        if n < length:
            return np.zeros(0, np.uint64)
        return K.mix((self.total[length:] - self.total[: n - length + 1]) * self.inverse[: n - length + 1])


@dataclass
class Fragments:
    """Runs of windows with one anchor: key, offset of the anchor in the first window, row, first window (in its row), windows, identity."""

    key: np.ndarray
    off: np.ndarray
    row: np.ndarray
    lo: np.ndarray
    count: np.ndarray
    fid: np.ndarray
    first: np.ndarray  # first window as an index of all units

    def pick(self, which: np.ndarray) -> Fragments:
        return Fragments(*(getattr(self, f.name)[which] for f in fields(self)))


def fragments(prefix: Prefix, bounds: np.ndarray, size: int, symbol: np.ndarray, left: np.ndarray, right: np.ndarray, start: np.ndarray) -> Fragments | None:
    """symbol: names in order; window p may choose a symbol if p <= left and right <= p + size (both ascending)."""
    n = len(prefix.total) - 1
    windows = np.maximum(np.diff(bounds) - size + 1, 0)
    many = int(windows.sum())
    if not many:
        return None
    p = np.repeat(bounds[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(many)
    lo = np.cumsum(np.bincount(left + 1, minlength=n + 2))[p]
    hi = np.cumsum(np.bincount(right, minlength=n + 2))[p + size]
    span = hi - lo
    # the least name, then the leftmost: one number holds half of the name and the place
    least = (symbol & _U(0xFFFFFFFF00000000)) | np.arange(len(symbol), dtype=np.uint64)
    chosen = np.full(many, -1)
    width, top = 1, int(span.max())
    while width <= top:
        now = np.flatnonzero((span >= width) & (span < 2 * width))
        if len(now):
            chosen[now] = (np.minimum(least[lo[now]], least[hi[now] - width]) & _U(0xFFFFFFFF)).astype(np.int64)
        if 2 * width <= top:
            least = np.minimum(least[:-width], least[width:])
        width *= 2
    new = np.empty(many, bool)
    new[0] = True
    np.not_equal(chosen[1:], chosen[:-1], out=new[1:])
    new[1:] |= (p[1:] != p[:-1] + 1) | (chosen[1:] < 0)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, many))
    first, anchor = p[head], chosen[head]
    lone = anchor < 0
    key, off = np.empty(len(head), np.uint64), np.zeros(len(head), np.int64)
    key[lone] = prefix.hash(first[lone], size)
    key[~lone] = symbol[anchor[~lone]]
    off[~lone] = start[anchor[~lone]] - first[~lone]
    return _named(prefix, bounds, size, key, off, first, count)


def _named(prefix: Prefix, bounds: np.ndarray, size: int, key, off, first, count) -> Fragments:
    row = np.searchsorted(bounds, first, side="right") - 1
    place = K.mix(key + off.astype(np.uint64) * _U(0xE7037ED1A0B428DB) + count.astype(np.uint64))
    # hashes of both halves: an identity that does not follow from the key of a single window
    half = (count + size - 1) // 2
    whole = prefix.hash(first, half) * _U(0xA24BAED4963EE407) + prefix.hash(first + half, count + size - 1 - half)
    return Fragments(key, off, row, first - bounds[row], count, K.mix(whole ^ place), first)


def singly(f: Fragments, pick: np.ndarray, prefix: Prefix, bounds: np.ndarray, size: int) -> Fragments:
    """The picked fragments cut into single windows that are keyed by their own hash; the others stay."""
    if not pick.any():
        return f
    first = spread(f.first[pick], f.count[pick])
    one = _named(prefix, bounds, size, prefix.hash(first, size), np.zeros(len(first), np.int64), first, np.ones(len(first), np.int64))
    return Fragments(*(np.concatenate([getattr(f, x.name)[~pick], getattr(one, x.name)]) for x in fields(f)))


#: make(bytes, offsets) -> (fragments or None, prefix hashes, bounds of the rows in units, payload(fragments) -> binary array)
Maker = Callable[[np.ndarray, np.ndarray], tuple]
#: solve(counts, offsets, keys, payloads, least) -> least id for each window of each fragment, concatenated
Solver = Callable[..., np.ndarray]
SHARED, HARD, CROWD = 0, 1, 2
REQUEST, ANSWER, PLACES = 0, 1, 2
_NEVER = np.iinfo(np.int64).max


def _groups(column: pa.Array) -> Iterator[list[tuple]]:
    """The chunks of a batch, a few at a time: about GROUP_BYTES of text, or one longer document."""
    held, weight = [], 0
    for chunk in K.chunks(column):
        if held and weight + len(chunk[2]) > GROUP_BYTES:
            yield held
            held, weight = [], 0
        held.append(chunk)
        weight += len(chunk[2])
    if held:
        yield held


def planes(values: np.ndarray) -> bytes:
    """The first byte of every value, then the second of every value, and so on: the shuffle's codec folds the bytes that hardly change."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T).tobytes()


def _planed(blob: memoryview, at: int, n: int, kind) -> tuple[np.ndarray, int]:
    """n values that planes() wrote at the place, and the place after them."""
    size = n * np.dtype(kind).itemsize
    raw = np.frombuffer(blob, np.uint8, size, at).reshape(np.dtype(kind).itemsize, n)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind), at + size


def _buckets(sorted_key: np.ndarray, buckets: int) -> np.ndarray:
    """Where the bucket's keys begin in ascending mixed keys; buckets + 1 places."""
    return np.concatenate([[0], np.searchsorted(sorted_key, (np.arange(1, buckets) * ((1 << 64) // buckets)).astype(np.uint64)), [len(sorted_key)]])


def _heads(*sorted_columns: np.ndarray) -> np.ndarray:
    """First places of the runs of equal rows."""
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _bucketed(df: DataFrame, parts: int, by: str, *then: str) -> DataFrame:
    """All rows of a value in one partition, and one after the other, so that only one value's rows are held."""
    return df.repartition(parts, by).sortWithinPartitions(by, *then)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(first column's value, the other columns of its rows) of rows that come sorted by the first column."""
    now, held = None, []
    for batch in batches:
        first, rest = batch.column(0).to_pylist(), batch.columns[1:]
        for i, value in enumerate(first):
            if value != now and held:
                yield now, held
                held = []
            now = value
            held.append(tuple(memoryview(c[i].as_buffer()) if pa.types.is_binary(c.type) else c[i].as_py() for c in rest))
    if held:
        yield now, held


def _keys(docs: DataFrame, make: Maker, buckets: int) -> DataFrame:
    """(bucket, blob): the keys of a group of texts, in order, by the upper KEY_BITS bits of their mixed hash; for each 32 bits of its
    least fragment's identity and a byte with its different fragments and, in the high bit, whether two documents have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _groups(batch.column(1)):
                keys, fids, rows = [], [], []
                for lo, _, b, off in group:
                    f = make(b, off)[0]
                    if f is not None:
                        keys.append(f.key), fids.append(f.fid), rows.append(f.row + lo)
                if not keys:
                    continue
                # anchors are least hashes: mixed again they spread over the buckets
                key, fid, row = K.mix(np.concatenate(keys)), np.concatenate(fids), np.concatenate(rows)
                order = np.argsort(key, kind="stable")
                key, fid, row = key[order], fid[order], row[order]
                short = key >> _U(64 - KEY_BITS)
                head = _heads(short)
                few = np.diff(np.append(head, len(key)))
                two = np.maximum.reduceat(row, head) > np.minimum.reduceat(row, head)
                low = np.minimum.reduceat(fid, head)
                several = np.ones(len(head), np.int64)
                for i in np.flatnonzero((few > 1) & (low != np.maximum.reduceat(fid, head))):
                    several[i] = min(127, len(np.unique(fid[head[i] : head[i] + few[i]])))
                mark, tag, short = (several + 128 * two).astype(np.uint8), (low >> _U(32)).astype(np.uint32), short[head]
                ends = _buckets(short << _U(64 - KEY_BITS), buckets)
                full = np.flatnonzero(np.diff(ends))
                blobs = [b"".join((planes(short[a:z])[: (z - a) * KEY_BITS // 8], planes(tag[a:z]), mark[a:z].tobytes())) for a, z in zip(ends[full], ends[full + 1], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, blob binary")


def _shared(keys: DataFrame) -> DataFrame:
    """(kind, n, blob): the short keys that are shared, hard and crowded, by bucket."""
    width = KEY_BITS // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches):
            shorts, tags, marks = [], [], []
            for (blob,) in rows:
                n = len(blob) // (width + 5)
                raw = np.zeros((8, n), np.uint8)
                raw[:width] = np.frombuffer(blob, np.uint8, width * n).reshape(width, n)
                shorts.append(np.ascontiguousarray(raw.T).reshape(-1).view(np.uint64))
                tags.append(_planed(blob, width * n, n, np.uint32)[0])
                marks.append(np.frombuffer(blob, np.uint8, n, (width + 4) * n))
            short, tag, mark = np.concatenate(shorts), np.concatenate(tags), np.concatenate(marks)
            order = np.argsort(short, kind="stable")
            short, tag, mark = short[order], tag[order], mark[order]
            head = _heads(short)
            several = np.add.reduceat((mark & 127).astype(np.int64), head)
            shared = (np.diff(np.append(head, len(short))) > 1) | (np.maximum.reduceat(mark, head) >= 128)
            hard = shared & ((np.maximum.reduceat(mark & 127, head) > 1) | (np.maximum.reduceat(tag, head) != np.minimum.reduceat(tag, head)))
            found = [(kind, short[head][which]) for kind, which in ((SHARED, shared), (HARD, hard), (CROWD, hard & (several >= CROWDED))) if which.any()]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in found], pa.int32()), pa.array([len(x) for _, x in found], pa.int64()), pa.array([x.tobytes() for _, x in found], pa.binary())], names=["kind", "n", "blob"]
                )

    return keys.mapInArrow(run, "kind int, n long, blob binary")


def _words(shared: DataFrame, bits: dict[int, int]) -> DataFrame:
    """(kind, first, words): stretches of bitmaps of 2 ** bits[kind] places. A bucket's keys share their upper bits, so its stretch is its own but for the ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                slot = np.unique(np.frombuffer(blob.as_buffer(), np.uint64) >> _U(KEY_BITS - bits[kind]))
                w = (slot >> _U(6)).astype(np.int64)
                head = _heads(w)
                words = np.zeros(w[-1] - w[0] + 1, np.uint64)
                words[w[head] - w[0]] = np.bitwise_or.reduceat(_U(1) << (slot & _U(63)), head)
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([w[0]], pa.int64()), pa.array([words.tobytes()], pa.binary())], names=["kind", "first", "words"])

    return shared.select("kind", "blob").mapInArrow(run, "kind int, first long, words binary")


def _bitmaps(docs: DataFrame, make: Maker, shelf: Shelf, parts: int) -> list[tuple[int, np.ndarray]]:
    """For each kind (bits, bitmap), sized by the number of its keys."""
    shared = shelf.put(_shared(_bucketed(_keys(docs, make, 4 * parts), parts, "bucket")))
    count = {r["kind"]: r["n"] for r in shared.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    bits = {k: min(MAX_BITS, max(16, (SLOTS * count.get(k, 0)).bit_length())) for k in (SHARED, HARD, CROWD)}
    out = {kind: np.zeros(1 << (bits[kind] - 6), np.uint64) for kind in (SHARED, HARD, CROWD)}
    # together the stretches are as long as the bitmaps
    for r in _words(shared, bits).collect():
        words = np.frombuffer(r["words"], np.uint64)
        out[r["kind"]][r["first"] : r["first"] + len(words)] |= words
    return [(bits[kind], bitmap) for kind, bitmap in out.items()]


def _test(map_: tuple[int, np.ndarray], key: np.ndarray) -> np.ndarray:
    """Whether the bitmap has the key; it may say so of a few others."""
    bits, words = map_
    slot = K.mix(key) >> _U(64 - bits)
    return (words[slot >> _U(6)] >> (slot & _U(63))) & _U(1) == 1


def _requests(docs: DataFrame, make: Maker, size: int, maps, buckets: int) -> DataFrame:
    """(bucket, kind, bid, blob). For a group of texts, bid: one blob of PLACES, where its fragments of shared anchors stand; and in every
    bucket of keys a REQUEST for its different fragments there, with the least and largest id, and the units of hard ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, hard, crowd = maps.value
        for batch in batches:
            ids, rks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for group in _groups(batch.column(2)):
                got = []
                for lo, _, b, off in group:
                    f, prefix, bounds, payload = make(b, off)
                    if f is None:
                        continue
                    f = f.pick(_test(shared, f.key))
                    difficult = _test(hard, f.key)
                    crowded = difficult & _test(crowd, f.key)
                    plain = int((~crowded).sum())
                    f, difficult = singly(f, crowded, prefix, bounds, size), difficult[~crowded]
                    # single windows of crowded keys stand last and are compared by identity alone
                    difficult = np.append(difficult, np.zeros(len(f.key) - plain, bool))
                    at = np.flatnonzero(difficult)
                    one = at[np.sort(np.unique(f.fid[at], return_index=True)[1])]
                    units = payload(f.pick(one))
                    length = np.zeros(len(f.key), np.int64)
                    length[one] = np.diff(np.frombuffer(units.buffers()[1], np.int32)[: len(one) + 1])
                    held = np.frombuffer(units.buffers()[2], np.uint8) if len(one) else np.zeros(0, np.uint8)
                    got.append((f.key, f.fid, f.off, f.count, f.lo, f.row + lo, difficult, length, held))
                if not got or not sum(len(g[0]) for g in got):
                    continue
                key, fid, off, count, first, row, difficult, length, units = (np.concatenate(x) for x in zip(*got, strict=True))
                begin = np.cumsum(length) - length
                bid = int.from_bytes(hashlib.blake2b(rks[row].tobytes() + first.tobytes(), digest_size=8).digest(), "little", signed=True)
                # requests: different fragments in the order of their keys; the first of equal ones has the units
                key = K.mix(key)
                order = np.lexsort((fid, key))
                head = _heads(key[order], fid[order])
                name = np.empty(len(order), np.int64)
                name[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(order))))
                doc = ids[row][order]
                least, most, one = np.minimum.reduceat(doc, head), np.maximum.reduceat(doc, head), order[head]
                ends = _buckets(key[one], buckets)
                full = np.flatnonzero(np.diff(ends))
                blobs = []
                for a, z in zip(ends[full], ends[full + 1], strict=True):
                    j = one[a:z]
                    h = j[difficult[j]]
                    blobs.append(b"".join((
                        np.array([z - a, a, len(h)]).tobytes(), planes(key[j]), planes(fid[j]), planes(least[a:z]), planes(most[a:z]), difficult[j].tobytes(),
                        planes(off[h].astype(np.int32)), planes(count[h].astype(np.int32)), planes(length[h].astype(np.int32)), units[spread(begin[h], length[h])].tobytes(),
                    )))
                # places: by document and window; a document's texts stand in one chunk
                order = np.lexsort((first, row))
                head = _heads(row[order])
                who, many = row[order][head], np.diff(np.append(head, len(order)))
                first = first[order]
                step = np.diff(first, prepend=0)
                step[head] = first[head]
                places = b"".join((
                    np.array([len(order), len(head), len(one)]).tobytes(), planes(ids[who]), planes(rks[who]), planes(many.astype(np.int32)),
                    planes(name[order].astype(np.int32)), planes(step.astype(np.int32)), planes(count[order].astype(np.int32)),
                ))
                where = np.append(full, bid % buckets).astype(np.int32)
                kind = np.append(np.full(len(full), REQUEST), PLACES).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(kind), pa.array(np.full(len(where), bid)), pa.array([*blobs, places], pa.binary())], names=["bucket", "kind", "bid", "blob"])

    return docs.select("doc_id", "rk", "text").mapInArrow(run, "bucket int, kind int, bid long, blob binary")


def _answers(requests: DataFrame, solve: Solver) -> DataFrame:
    """(bid, kind, blob): ANSWERs to requests where some document loses, the least id of the fragment or, for a hard one, of each of its windows; PLACES pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches):
            out = [(bid, PLACES, bytes(blob)) for kind, bid, blob in rows if kind == PLACES]
            asked = [(bid, blob) for kind, bid, blob in rows if kind == REQUEST]
            if asked:
                out += _answer(asked, solve)
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], names=["bid", "kind", "blob"])

    return requests.mapInArrow(run, "bid long, kind int, blob binary")


def _answer(asked: list[tuple[int, memoryview]], solve: Solver) -> list[tuple[int, int, bytes]]:
    """ANSWER rows for the requests of one bucket."""
    cols, units = [], []
    for i, (_, blob) in enumerate(asked):
        n, base, n_hard = np.frombuffer(blob, np.int64, 3)
        n, n_hard, at = int(n), int(n_hard), 24
        key, at = _planed(blob, at, n, np.uint64)
        fid, at = _planed(blob, at, n, np.uint64)
        least, at = _planed(blob, at, n, np.int64)
        most, at = _planed(blob, at, n, np.int64)
        difficult = np.frombuffer(blob, bool, n, at)
        at += n
        rest = np.zeros((3, n), np.int64)
        for k in range(3):
            some, at = _planed(blob, at, n_hard, np.int32)
            rest[k, difficult] = some
        cols.append((key, fid, least, most, difficult, *rest, base + np.arange(n), np.full(n, i)))
        units.append(np.frombuffer(blob, np.uint8, int(rest[2].sum()), at))
    key, fid, least, most, difficult, off, count, length, name, source = (np.concatenate(x) for x in zip(*cols, strict=True))
    units, begin = np.concatenate(units), np.cumsum(length) - length
    order = np.lexsort((fid, key))
    head = _heads(key[order], fid[order])
    many = np.diff(np.append(head, len(order)))
    low, high, one = np.minimum.reduceat(least[order], head), np.maximum.reduceat(most[order], head), order[head]
    of = np.empty(len(order), np.int64)  # the fragment of each request
    of[order] = np.repeat(np.arange(len(head)), many)
    # hard keys that two documents have; two places of one do not count
    h = np.flatnonzero(difficult[one])
    if len(h):
        group = _heads(key[one[h]])
        several = np.minimum.reduceat(low[h], group) < np.maximum.reduceat(high[h], group)
        h = h[np.repeat(several, np.diff(np.append(group, len(h))))]
    windows = np.zeros(len(head), np.int64)
    ids, worst = np.zeros(0, np.int64), low.copy()
    worst[difficult[one]] = _NEVER
    if len(h):
        j = one[h]
        windows[h] = count[j]
        ids = solve(count[j], off[j], key[j], binaries(units[spread(begin[j], length[j])], length[j]), low[h])
        worst[h] = np.minimum.reduceat(ids, np.cumsum(count[j]) - count[j])
    start = np.cumsum(windows) - windows
    loses = np.flatnonzero(worst[of] < most)
    out = []
    for mine in np.split(loses, np.flatnonzero(np.diff(source[loses])) + 1):  # requests of one source stand together
        if len(mine):
            simple, tough = mine[~difficult[mine]], mine[difficult[mine]]
            size = windows[of[tough]]
            blob = b"".join((
                np.array([len(simple), len(tough)]).tobytes(), planes(name[simple].astype(np.int32)), planes(low[of[simple]]),
                planes(name[tough].astype(np.int32)), planes(size.astype(np.int32)), ids[spread(start[of[tough]], size)].tobytes(),
            ))
            out.append((asked[source[mine[0]]][0], ANSWER, blob))
    return out


def _ranges(answers: DataFrame, size: int) -> DataFrame:
    """(doc_id, rk, lo, hi): the removed units of each document that loses some, in order and apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches):
            said = [blob for kind, blob in rows if kind == ANSWER]
            if said:
                # equal groups of repeated rows share one bid and have equal places
                yield _removed_ranges(next(blob for kind, blob in rows if kind == PLACES), said, size)

    return answers.mapInArrow(run, "doc_id long, rk long, lo array<int>, hi array<int>")


def _removed_ranges(places: memoryview, said: list[memoryview], size: int) -> pa.RecordBatch:
    n, n_docs, n_names = (int(x) for x in np.frombuffer(places, np.int64, 3))
    at = 24
    ids, at = _planed(places, at, n_docs, np.int64)
    rks, at = _planed(places, at, n_docs, np.int64)
    many, at = _planed(places, at, n_docs, np.int32)
    name, at = _planed(places, at, n, np.int32)
    step, at = _planed(places, at, n, np.int32)
    count, at = _planed(places, at, n, np.int32)
    low, begin = np.full(n_names, _NEVER), np.full(n_names, -1)
    held, total = [], 0
    for blob in said:
        n_simple, n_hard = (int(x) for x in np.frombuffer(blob, np.int64, 2))
        k, at = _planed(blob, 16, n_simple, np.int32)
        low[k], at = _planed(blob, at, n_simple, np.int64)
        k, at = _planed(blob, at, n_hard, np.int32)
        length, at = _planed(blob, at, n_hard, np.int32)
        begin[k] = total + np.cumsum(length, dtype=np.int64) - length
        held.append(np.frombuffer(blob, np.int64, int(length.sum()), at))
        total += len(held[-1])
    window_ids = np.concatenate([*held, [_NEVER]])
    doc = np.repeat(np.arange(n_docs), many)
    # first windows from the steps between them
    run = np.cumsum(step, dtype=np.int64)
    head = np.cumsum(many) - many
    first = run - np.repeat(run[head] - step[head], many)
    live = (low[name] < ids[doc]) | (begin[name] >= 0)
    doc, name, first, count = doc[live], name[live], first[live], count[live].astype(np.int64)
    owner = np.repeat(np.arange(len(doc)), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    tough = begin[name][owner] >= 0
    least = np.where(tough, window_ids[np.where(tough, begin[name][owner] + inner, 0)], low[name][owner])
    gone = least < ids[doc][owner]
    who, lo = doc[owner[gone]], (first[owner] + inner)[gone]
    # windows in order: a range ends where the next one begins beyond its end
    new = np.ones(len(lo), bool)
    new[1:] = (who[1:] != who[:-1]) | (lo[1:] > lo[:-1] + size)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(lo))[: len(head)] - 1
    docs = _heads(who[head]) if len(head) else head
    cuts = np.append(docs, len(head)).astype(np.int32)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32)))
    mine = who[head][docs]
    return pa.RecordBatch.from_arrays([pa.array(ids[mine]), pa.array(rks[mine]), lists(lo[head]), lists(lo[last] + size)], names=["doc_id", "rk", "lo", "hi"])


def removed(docs: DataFrame, make: Maker, solve: Solver, size: int, doc_id: str, text: str) -> DataFrame:
    """docs with __lo and __hi: arrays of the removed units' ranges, in order and apart; null if there are none."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.withColumns({"__id": F.col(doc_id).cast("long"), "__rk": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    narrow = keyed.filter("__id IS NOT NULL").select(F.col("__id").alias("doc_id"), F.col("__rk").alias("rk"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shelf = Shelf(spark)
    maps = spark.sparkContext.broadcast(_bitmaps(narrow, make, shelf, parts))
    shelf.clear()
    requests = _bucketed(_requests(narrow, make, size, maps, 4 * parts), parts, "bucket")
    answers = _bucketed(_answers(requests, solve), parts, "bid")
    # repeated rows have equal ranges
    ranges = _ranges(answers, size).groupBy(F.col("doc_id").alias("__id"), F.col("rk").alias("__rk")).agg(F.first("lo").alias("__lo"), F.first("hi").alias("__hi"))
    return keyed.join(ranges.hint("shuffle_hash"), ["__id", "__rk"], "left").drop("__id", "__rk")


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary array of counts[i] bytes each, from their concatenation."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i] .. first[i] + count[i] - 1 for each i, concatenated."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
