"""Column names of callers beside the names that operators use inside."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from inspect import signature

from pyspark.sql import DataFrame


def free_name(df: DataFrame, name: str) -> str:
    """name, made longer until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def guarded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose own columns begin with "_", safe for tables with such columns: they have other names while it runs."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        given = signature(operator).bind(docs, *args, **kwargs)
        names: dict[str, str] = {}
        for c in docs.columns if given.arguments.get("keep") is None else ():
            if c.startswith("_"):
                names[c] = free_name(docs, f"given{len(names)}{c}")
        if not names:
            return operator(*given.args, **given.kwargs)
        for k, v in given.arguments.items():
            if isinstance(v, str) and v in names:
                given.arguments[k] = names[v]
        first = next(iter(given.arguments))
        given.arguments[first] = docs.withColumnsRenamed(names)
        # a column that the operator returns under such a name gives way to the caller's
        return operator(*given.args, **given.kwargs).drop(*names).withColumnsRenamed({v: k for k, v in names.items()})

    return run
