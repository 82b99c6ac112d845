"""Text differences as Arrow-batched functions: shortest edit scripts, alignment, unified diffs and patches.

Each text pair is solved by itself, so rows stay where they are and memory follows the longest pair.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator, Sequence
from itertools import accumulate
from math import isqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(rb"\s+|\S+")


def middle_snake_edits(a: Sequence, b: Sequence) -> list[tuple[int, int, int, int]]:
    """A shortest edit script as (a_start, a_end, b_start, b_end) blocks, by divide and conquer in linear space."""
    out: list[tuple[int, int, int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, n, j, m = stack.pop()
        while i < n and j < m and a[i] == b[j]:
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
        if i == n and j == m:
            continue
        if i == n or j == m:
            out.append((i, n, j, m))
            continue
        x, y, u, v = _middle(a, b, i, n, j, m)
        if (x, y) == (i, j) and (u, v) == (n, m) or (u, v) == (i, j) or (x, y) == (n, m):
            out.append((i, n, j, m))
            continue
        stack.append((u, n, v, m))
        stack.append((i, x, j, y))
    out.sort()
    merged: list[list[int]] = []
    for e in out:
        if merged and merged[-1][1] == e[0] and merged[-1][3] == e[2]:
            merged[-1][1], merged[-1][3] = e[1], e[3]
        else:
            merged.append(list(e))
    return [tuple(e) for e in merged]


def _middle(a, b, i, n, j, m, limit=None):
    """Start and end of the snake in the middle of a shortest path from (i, j) to (n, m); with a limit, none if it is not found in so many rounds."""
    N, M = n - i, m - j
    delta = N - M
    odd = delta % 2 != 0
    ahead, back = {1: 0}, {1: 0}
    for d in range((N + M + 1) // 2 + 1 if limit is None else limit):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead.get(k - 1, -1) < ahead.get(k + 1, -1)) else ahead[k - 1] + 1
            y = x - k
            x0, y0 = x, y
            while 0 <= y < M and x < N and a[i + x] == b[j + y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            if odd and abs(delta - k) <= d - 1 and x + back.get(delta - k, -1) >= N and y <= M and y0 >= 0:
                return i + x0, j + y0, i + x, j + y
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back.get(k - 1, -1) < back.get(k + 1, -1)) else back[k - 1] + 1
            y = x - k
            x0, y0 = x, y
            while 0 <= y < M and x < N and a[n - 1 - x] == b[m - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if not odd and abs(delta - k) <= d and x + ahead.get(delta - k, -1) >= N and y <= M and y0 >= 0:
                return n - x, m - y, n - x0, m - y0
    return (i, j, n, m) if limit is None else None


#: Bits of the table that shortest_edits keeps for one stretch; longer stretches are halved first.
TABLE_BITS = 1 << 26


def shortest_edits(a: Sequence, b: Sequence, table_bits: int = TABLE_BITS) -> list[tuple[int, int, int, int]]:
    """A shortest edit script as middle_snake_edits has it, of sequences whose elements can be hashed.

    A row of the table of longest common subsequences is one integer (a bit for each element of a, unset where the length grows),
    and an element of b takes a row to the next one in a few operations on it, however much differs. Stretches whose table is
    too large are cut in two, by a snake if few elements differ, else where the lengths from both ends add up to the most.
    """
    same: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, n, j, m = stack.pop()
        while i < n and j < m and a[i] == b[j]:
            same.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            same.append((n, m))
        if i == n or j == m:
            continue
        if (n - i) * (m - j) <= table_bits or n - i == 1 or m - j == 1:
            same += _matched(a, b, i, n, j, m)
            continue
        snake = _middle(a, b, i, n, j, m, isqrt(n - i + m - j))
        x, y, u, v = snake if snake and snake not in ((i, j, n, m), (i, j, i, j), (n, m, n, m)) else _halved(a, b, i, n, j, m)
        same += zip(range(x, u), range(y, v))
        stack += [(i, x, j, y), (u, n, v, m)]
    out, p, q = [], 0, 0
    for x, y in [*sorted(same), (len(a), len(b))]:
        if x > p or y > q:
            out.append((p, x, q, y))
        p, q = x + 1, y + 1
    return out


def _rows(a: Sequence, b: Sequence) -> Iterator[int]:
    """The rows of the table, the one before the first element of b included."""
    where: dict = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    row = full = (1 << len(a)) - 1
    yield row
    for y in b:
        if hit := row & where.get(y, 0):
            row = (row + hit | row - hit) & full
        yield row


def _matched(a, b, i, n, j, m) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence of a[i:n] and b[j:m]."""
    rows, out = list(_rows(a[i:n], b[j:m])), []
    x, y = n - i, m - j
    while x and y:
        if rows[y] >> (x - 1) & 1:
            x -= 1
        else:
            y -= 1
            if rows[y] >> (x - 1) & 1:
                x -= 1
                out.append((i + x, j + y))
    return out


def _halved(a, b, i, n, j, m) -> tuple[int, int, int, int]:
    """A place on a shortest path, at half of b[j:m], as an empty snake."""
    half = (j + m) // 2

    def lengths(a: Sequence, b: Sequence) -> list[int]:
        for row in _rows(a, b):  # noqa: B007  the last one counts
            pass
        return [0, *accumulate(int(c == "0") for c in reversed(f"{row:0{len(a)}b}"))]

    front, back = lengths(a[i:n], b[j:half]), lengths(a[i:n][::-1], b[half:m][::-1])
    x = i + max(range(n - i + 1), key=lambda k: front[k] + back[n - i - k])
    return x, half, x, half


def token_edits(old: str | None, new: str | None) -> list[tuple[int, int, int, int]]:
    """Byte ranges (old_start, old_end, new_start, new_end) that differ, by word tokens."""
    x, y = (old or "").encode(), (new or "").encode()
    s, t = TOKEN.findall(x), TOKEN.findall(y)
    at = lambda tokens: [0, *accumulate(map(len, tokens))]
    p, q = at(s), at(t)
    return [(p[a], p[b], q[c], q[d]) for a, b, c, d in shortest_edits(s, t)]


def edits(pairs: DataFrame, key: list[str], old: str = "old", new: str = "new") -> DataFrame:
    """(key, edit_no, old_start, old_end, new_start, new_end), one row for each edit of each pair."""
    spec = ", ".join(f"`{n}` {t}" for n, t in pairs.select(*key).dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*[r[k] for k in key], no, *e) for r in batch.to_dict("records") for no, e in enumerate(token_edits(r[old], r[new]))]
            yield pd.DataFrame(rows, columns=[*key, "edit_no", "old_start", "old_end", "new_start", "new_end"])

    return pairs.select(*key, old, new).mapInPandas(run, f"{spec}, edit_no int, old_start long, old_end long, new_start long, new_end long")


def apply_edits(old: str, new: str, changed: list[tuple[int, int, int, int]]) -> str:
    """old with each range replaced by new's; the inverse check of token_edits."""
    x, y, out, at = old.encode(), new.encode(), [], 0
    for a, b, c, d in changed:
        out += [x[at:a], y[c:d]]
        at = b
    return b"".join([*out, x[at:]]).decode()


class _Placed:
    """A character with its neighbours: equal to another if the characters are, and the neighbours on each side where both have one."""

    __slots__ = ("here", "left", "right")

    def __init__(self, left: str, here: str, right: str):
        self.left, self.here, self.right = left, here, right

    def __eq__(self, other) -> bool:
        return self.here == other.here and (not self.left or not other.left or self.left == other.left) and (not self.right or not other.right or self.right == other.right)

    __hash__ = None


def in_context(text: str) -> list[_Placed]:
    return [_Placed(text[k - 1] if k else "", c, text[k + 1 : k + 2]) for k, c in enumerate(text)]


def char_segments(old: str, new: str, context: bool = False) -> list[tuple[str, int, int, int, int]]:
    """Equal and changed segments by characters: (op, a_start, a_end, b_start, b_end). context: characters match only beside equal neighbours."""
    out, i, j = [], 0, 0
    for a, b, c, d in middle_snake_edits(in_context(old), in_context(new)) if context else middle_snake_edits(old, new):
        if a > i:
            out.append(("equal", i, a, j, c))
        out.append(("replace" if b > a and d > c else "delete" if b > a else "insert", a, b, c, d))
        i, j = b, d
    if i < len(old):
        out.append(("equal", i, len(old), j, len(new)))
    return out


_SEGMENTS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("a0", "a1", "b0", "b1")]]))


@F.pandas_udf(_SEGMENTS)
def context_segments(old: pd.Series, new: pd.Series) -> pd.Series:
    """All segments of a character comparison in context."""
    return pd.Series([[dict(zip(("op", "a0", "a1", "b0", "b1"), o, strict=True)) for o in char_segments(a or "", b or "", context=True)] for a, b in zip(old, new, strict=True)])


@F.pandas_udf(T.StringType())
def patched(base: pd.Series, patch: pd.Series) -> pd.Series:
    """Each base with its unified diff applied."""
    return pd.Series([apply_patch(a or "", b or "") for a, b in zip(base, patch, strict=True)])


def rebuilt(pairs: DataFrame, edits_: DataFrame, key: list[str], old: str = "old", new: str = "new") -> DataFrame:
    """(key, text): old with the edits' ranges replaced by new's; equal to new if the script is right. Ranges are byte offsets."""
    lists = edits_.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("old_start", "old_end", "new_start", "new_end"))).alias("es"))
    x, y = F.coalesce(F.col(old), F.lit("")).cast("binary"), F.coalesce(F.col(new), F.lit("")).cast("binary")
    cut = lambda raw, a, z: F.substring(raw, (a + 1).cast("int"), (z - a).cast("int"))
    start = F.struct(F.lit(b"").cast("binary").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda acc, e: F.struct(F.concat(acc["out"], cut(x, acc["at"], e["old_start"]), cut(y, e["new_start"], e["new_end"])).alias("out"), e["old_end"].alias("at"))
    none = F.array().cast("array<struct<old_start:bigint,old_end:bigint,new_start:bigint,new_end:bigint>>")
    done = F.aggregate(F.coalesce("es", none), start, step, lambda acc: F.concat(acc["out"], cut(x, acc["at"], F.octet_length(x))))
    return pairs.join(lists, key, "left").select(*key, F.make_valid_utf8(done.cast("string")).alias("text"))


@F.pandas_udf(_SEGMENTS)
def opcodes(old: pd.Series, new: pd.Series) -> pd.Series:
    """The non-equal opcodes of a character comparison."""
    one = lambda a, b: [dict(zip(("op", "a0", "a1", "b0", "b1"), o, strict=True)) for o in difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).get_opcodes() if o[0] != "equal"]
    return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)])


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    def one(a: str | None, b: str | None) -> str:
        lines = difflib.unified_diff(_lines(a or ""), _lines(b or ""), "old", "new")
        return "".join(x if x.endswith("\n") else x + "\n\\ No newline at end of file\n" for x in lines)

    return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)])


def _lines(text: str) -> list[str]:
    """Lines with their ends; only \\n ends one."""
    return re.findall(r"[^\n]*\n|[^\n]+", text)


_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def apply_patch(base: str, patch: str) -> str:
    """A unified diff applied to base; ValueError if its context does not fit."""
    lines, out, at = _lines(base), [], 0
    body = _lines(patch)
    k = 0
    while k < len(body):
        m = _HUNK.match(body[k])
        if not m:
            k += 1
            continue
        start = int(m[1]) - (0 if m[2] == "0" else 1)
        out += lines[at:start]
        at, k = start, k + 1
        while k < len(body) and body[k][:1] in (" ", "+", "-", "\\"):
            mark, text = body[k][0], body[k][1:]
            bare = k + 1 < len(body) and body[k + 1].startswith("\\")
            text = text.removesuffix("\n") if bare else text
            if mark in " -":
                if at >= len(lines) or lines[at] != text:
                    raise ValueError(f"the patch does not fit at line {at + 1}")
                if mark == " ":
                    out.append(lines[at])
                at += 1
            elif mark == "+":
                out.append(text)
            k += 1
    return "".join(out + lines[at:])


def fold_patches(bases: DataFrame, patches: DataFrame) -> DataFrame:
    """(dir, patch_index, content): patches of each directory applied in order. bases: dir, content; patches: dir, patch_index, diff."""
    joined = patches.join(bases, "dir")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        text, rows = frame["content"].iloc[0], []
        for r in frame.sort_values("patch_index").itertuples():
            text = apply_patch(text, r.diff)
            rows.append((r.dir, r.patch_index, text))
        return pd.DataFrame(rows, columns=["dir", "patch_index", "content"])

    return joined.groupBy("dir").applyInPandas(run, "dir string, patch_index int, content string")


def align(left: list, right: list, similar, threshold: float = 0.6) -> list[tuple[str, int | None, int | None]]:
    """Longest common alignment where pairs of at least the threshold match: keep or modify, insert, delete."""
    n, m = len(left), len(right)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    score = [[similar(x, y) for y in right] for x in left]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            take = best[i + 1][j + 1] + 1 if score[i][j] >= threshold else -1
            best[i][j] = max(take, best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and score[i][j] >= threshold and best[i][j] == best[i + 1][j + 1] + 1:
            out.append(("keep" if left[i] == right[j] else "modify", i, j))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append(("delete", i, None))
            i += 1
        else:
            out.append(("insert", None, j))
            j += 1
    return out
