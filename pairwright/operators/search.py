"""Search over a table's cells, and the rows behind a rule's outcome."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.patterns import Regex
from pairwright.operators.verdicts import Evaluation
from pairwright.plans.compiled import compile_filter
from pairwright.plans.rules import RuleError
from pairwright.sources.tables import Table, column_index


def _columns(table: Table, visible: list[str] | None) -> list[Column]:
    if visible is None:
        return [table.cell(i) for i in range(len(table.headers))]
    found = [column_index(table.headers, v) for v in visible]
    if None in found:
        raise RuleError(f"unknown column '{visible[found.index(None)]}'")
    return [table.cell(i) for i in found]


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def condition(table: Table, text: str, mode: str = "regex", visible: list[str] | None = None, ignore_case: bool = True) -> Column:
    """The rows that a search keeps. regex: any (visible) cell matches; prefix: any begins with the text,
    whatever its case; expression: the expression is true. An empty text keeps all rows in the first two."""
    if mode == "expression":
        return compile_filter(text, table.headers)
    if not text:
        return F.lit(True)
    if mode == "regex":
        r = Regex(text, ignore_case)
        return _any([r.found(c) for c in _columns(table, visible)])
    if mode == "prefix":
        return _any([F.startswith(F.lower(c), F.lit(text.lower())) for c in _columns(table, visible)])
    raise RuleError(f"unknown search mode '{mode}'")


def search(table: Table, text: str, mode: str = "regex", visible: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The rows that match, in the table's order; the first ``limit`` of them."""
    found = table.df.where(condition(table, text, mode, visible))
    return found if limit is None else found.orderBy("_row").limit(limit)


def totals(table: Table, text: str, mode: str = "regex", visible: list[str] | None = None, limit: int = 100) -> DataFrame:
    """One row: matched, rows_read, truncated."""
    n = F.count_if(condition(table, text, mode, visible))
    return table.df.agg(n.alias("matched"), F.count("*").alias("rows_read"), (n > limit).alias("truncated"))


def hits(evaluation: Evaluation, rule: int, outcome: str | None = None, limit: int = 100, distinct: bool = False) -> DataFrame:
    """Verdicts of a rule: of each outcome the first ``limit`` rows. With distinct, first of each (left, right,
    expected) at most a tenth of that, one at least."""
    v = evaluation.verdicts.where(F.col("rule") == rule)
    if outcome:
        v = v.where(F.col("outcome") == outcome)
    if distinct:
        inner = Window.partitionBy("outcome", "left", "right", "expected").orderBy("_row")
        v = v.withColumn("_k", F.row_number().over(inner)).where(F.col("_k") <= max(limit // 10, 1)).drop("_k")
    outer = Window.partitionBy("outcome").orderBy("_row")
    return v.withColumn("_k", F.row_number().over(outer)).where(F.col("_k") <= limit).drop("_k")


def with_headings(found: DataFrame) -> DataFrame:
    """Hits in the order of their condition, with heading: whether a row is the first of its condition."""
    order = Window.partitionBy("rule").orderBy("left", "right", F.asc_nulls_first("expected"), "_row")
    key = F.struct("left", "right", "expected")
    return found.withColumn("heading", ~F.coalesce(F.lag(key).over(order).eqNullSafe(key), F.lit(False)))


def detail(table: Table, row: int) -> DataFrame:
    """A row as (place, attribute, value)."""
    pairs = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(h).alias("attribute"), table.cell(i).alias("value")) for i, h in enumerate(table.headers)])
    return table.df.where(F.col("_row") == row).select(F.inline(pairs))


def attributes(headers: list[str], text: str) -> list[str]:
    """Headers that contain the text, whatever its case; none for an empty text."""
    return [h for h in headers if text and text.lower() in h.lower()]


class Profiles:
    """Named lists of visible columns, in a JSON file. A file that can't be read counts as empty."""

    def __init__(self, path: str):
        self.path = Path(path)
        try:
            found = json.loads(self.path.read_text())
        except (OSError, ValueError):
            found = {}
        self.named: dict[str, list[str]] = {k: [str(c) for c in v] for k, v in found.items() if isinstance(v, list)} if isinstance(found, dict) else {}

    def save(self, name: str, columns: list[str]) -> None:
        self.named[name] = list(columns)
        self.path.write_text(json.dumps(self.named, indent=2))

    def remove(self, name: str) -> None:
        self.named.pop(name, None)
        self.path.write_text(json.dumps(self.named, indent=2))


def visible(headers: list[str], hidden: set[str], locked: set[str] = frozenset()) -> list[str]:
    """The columns to show: locked ones stay whatever is hidden."""
    return [h for h in headers if h not in hidden or h in locked]
