"""Generated patches: small seeded edits of C sources as unified diffs, one operation after the other."""

from __future__ import annotations

import difflib
import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: The operations in their order; one that finds no place gives way to the next of FALLBACKS.
OPERATIONS = ("delete-stmt", "insert-decl", "rename-local", "modify-num-lit", "add-comment")
FALLBACKS = ("insert-decl", "add-comment")
_DECLARES = re.compile(r"^\s+(?:int|char|long|short|float|double|unsigned)\s+(\w+)\s*(?:=[^,;]*)?;$")
_NUMBER = re.compile(r"(?<![\w.])\d+(?![\w.])")


def safe_statements(lines: list[str]) -> list[int]:
    """Indented one-line statements that can go: no declarations (of one or more names), labels, returns, jumps or parts of blocks."""
    out = []
    for k, line in enumerate(lines):
        s = line.strip()
        risky = not line[:1].isspace() or not s.endswith(";") or "{" in s or "}" in s or s.startswith(("case ", "default", "return", "break", "continue", "goto", "for", "while", "if", "else", "//", "#"))
        if not risky and not re.match(r"(?:int|char|long|short|float|double|unsigned|struct|const|static)\b", s):
            out.append(k)
    return out


def _edited(lines: list[str], op: str, rng: random.Random, nth: int) -> tuple[list[str], str] | None:
    """The lines after one operation and what was done; None if it finds no place."""
    opened = [k for k, line in enumerate(lines) if line.rstrip().endswith("{") and not line[:1].isspace()]
    if op == "delete-stmt":
        at = safe_statements(lines)
        if at:
            k = rng.choice(at)
            return lines[:k] + lines[k + 1 :], f"line-{k + 1}"
    elif op == "insert-decl" and opened:
        k = rng.choice(opened)
        return [*lines[: k + 1], f"  int gen{nth} = {rng.randrange(100)};", *lines[k + 1 :]], f"gen{nth}"
    elif op == "rename-local":
        names = sorted({m[1] for line in lines if (m := _DECLARES.match(line))})
        if names:
            old = rng.choice(names)
            return [re.sub(rf"\b{old}\b", f"{old}_r{nth}", line) for line in lines], f"{old}-{old}_r{nth}"
    elif op == "modify-num-lit":
        at = [(k, m.span()) for k, line in enumerate(lines) for m in _NUMBER.finditer(line) if not line.lstrip().startswith(("//", "#"))]
        if at:
            k, (a, z) = rng.choice(at)
            new = str(int(lines[k][a:z]) + rng.randrange(1, 10))
            return [*lines[:k], lines[k][:a] + new + lines[k][z:], *lines[k + 1 :]], f"{lines[k][a:z]}-to-{new}"
    elif op == "add-comment":
        k = rng.randrange(len(lines) + 1)
        return [*lines[:k], f"// note {nth}", *lines[k:]], f"line-{k + 1}"
    return None


def sequence(text: str, count: int, seed: int = 1337) -> list[tuple[int, str, str, str]]:
    """(patch_index, op, info, diff): count patches in order, operations taken in turn; each applies to the text after those before it."""
    rng, lines, out = random.Random(seed), text.splitlines(), []
    for nth in range(1, count + 1):
        wanted = OPERATIONS[(nth - 1) % len(OPERATIONS)]
        for op in dict.fromkeys((wanted, *FALLBACKS)):
            done = _edited(lines, op, rng, nth)
            if done is not None:
                break
        new, info = done
        body = difflib.unified_diff([x + "\n" for x in lines], [x + "\n" for x in new], "old", "new")
        out.append((nth, op, info, "".join(body)))
        lines = new
    return out


def base(text: str, remove: int, among: int = 8) -> str:
    """The text without its first safe statements, `remove` of the first `among`: a base that later patches can fill."""
    lines = text.splitlines()
    gone = set(safe_statements(lines)[:among][:remove])
    return "\n".join(line for k, line in enumerate(lines) if k not in gone) + "\n"


def patches(files: DataFrame, count: int, seed: int = 1337) -> DataFrame:
    """(dir, patch_index, op, info, diff) for every file. files: dir, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *p) for d, c in zip(batch["dir"], batch["content"], strict=True) for p in sequence(c or "", count, seed)]
            yield pd.DataFrame(rows, columns=["dir", "patch_index", "op", "info", "diff"])

    return files.select("dir", "content").mapInPandas(run, "dir string, patch_index int, op string, info string, diff string")
