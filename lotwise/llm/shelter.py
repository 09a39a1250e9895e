"""Keeps a caller's columns apart from the working names of an operator, which all begin with an underscore."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The parameters of operators that name columns of their documents.
NAMING = ("text", "doc_id", "source", "key", "order")


def free_name(taken: Sequence[str], wanted: str) -> str:
    """``wanted``, longer if there is such a column."""
    lowered = {c.lower() for c in taken}
    while wanted.lower() in lowered:
        wanted += "_"
    return wanted


def sheltered(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Columns that begin with an underscore carry other names inside the operator and get theirs back.

    A column named like the operator's result is replaced by it, as any other would be. Documents without such
    columns, the usual case, go straight in.
    """
    shape = inspect.signature(operator)

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **named) -> DataFrame:
        hidden: dict[str, str] = {}
        for c in docs.columns:
            if c.startswith("_"):
                hidden[c] = free_name([*docs.columns, *hidden.values()], f"kept{len(hidden)}")
        if not hidden:
            return operator(docs, *args, **named)
        given = shape.bind(docs, *args, **named).arguments
        given |= given.pop("options", {})
        made: list[str] = []
        for name, value in list(given.items()):
            if isinstance(value, Column):  # an expression over the caller's names
                made.append(free_name([*docs.columns, *hidden.values(), *made], f"given{len(made)}"))
                docs = docs.withColumn(made[-1], value)
                given[name] = F.col(made[-1])
            elif name in NAMING:
                given[name] = hidden.get(value, value) if isinstance(value, str) else [hidden.get(c, c) for c in value]
        given.pop(next(iter(shape.parameters)))
        out = operator(docs.withColumnsRenamed(hidden), **given).drop(*made)
        there = {c.lower() for c in out.columns}
        out = out.drop(*[new for old, new in hidden.items() if old.lower() in there])
        return out.withColumnsRenamed({new: old for old, new in hidden.items() if old.lower() not in there})

    return run

