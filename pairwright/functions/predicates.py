"""Row predicates as columns that are never null. A value is the raw cell, or the first that isn't empty; an
empty one equals nothing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Predicate:
    """kind: in, any_in, all_in, eq, ne, empty, not_empty, and, or, not, const."""

    kind: str
    columns: tuple[tuple[str, ...], ...] = ()
    values: tuple[str, ...] = ()
    parts: tuple["Predicate", ...] = ()
    const: bool = False


def compile_predicate(p: Predicate, cell: Callable[[str], Column]) -> Column:
    """cell gives the (trimmed, if asked for) cell of a column."""

    def value(names: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.when(cell(n) != "", cell(n)) for n in names])

    no = F.lit(False)
    each = [value(c) for c in p.columns]
    if p.kind == "const":
        return F.lit(p.const)
    if p.kind == "not":
        return ~compile_predicate(p.parts[0], cell)
    if p.kind in ("and", "or"):
        out = compile_predicate(p.parts[0], cell)
        for x in p.parts[1:]:
            y = compile_predicate(x, cell)
            out = (out & y) if p.kind == "and" else (out | y)
        return out
    if p.kind == "empty":
        return each[0].isNull()
    if p.kind == "not_empty":
        return each[0].isNotNull()
    tests = [F.coalesce(v.isin(*p.values), no) if p.values else no for v in each]
    if p.kind == "ne":
        return ~tests[0]
    if p.kind in ("in", "eq"):
        return tests[0]
    out = tests[0]
    for t in tests[1:]:
        out = (out | t) if p.kind == "any_in" else (out & t)
    return out
