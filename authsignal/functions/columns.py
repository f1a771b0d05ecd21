"""Column helpers shared by the operators; all of them stay inside generated code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def carries(array_column: str, code: int) -> Column:
    """True when a multi-valued packet field holds ``code``; a packet matches once, however often."""
    return F.coalesce(F.array_contains(F.col(array_column), F.lit(code)), F.lit(False))


def filled(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name).cast("string") != "")


def floor_div(value: Column, divisor: int) -> Column:
    """Whole-number division of a bigint, exact beyond 2**53."""
    return F.call_function("div", value, F.lit(divisor).cast("bigint"))


def uniform(*parts: Column | str) -> Column:
    """Deterministic draw in [0, 1) from the md5 of the joined parts."""
    joined = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def occurrences(text: Column, keyword: str) -> Column:
    """How often a literal occurs in a text, without overlaps."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(keyword)))
    return (gone / F.lit(len(keyword))).cast("bigint")


def first_match(rules: Iterable[tuple[Column, Column | str]], default: Column | str | None = None) -> Column:
    """First rule whose condition holds gives the value."""
    chain = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    if default is None:
        return chain
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))
