"""Comparisons of two sorted token sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The comparisons' names.
ALIASES = {
    "eq": ("eq", "equal", "equals", "=", "=="),
    "ne": ("ne", "neq", "!=", "<>"),
    "subset": ("subset", "in", "contains_all_reverse"),
    "superset": ("superset", "contains"),
    "intersect": ("intersect", "overlap", "any"),
    "matches": ("matches", "match", "=~", "regex"),
    "not_matches": ("not_matches", "nomatch", "!~", "not_match"),
}
BY_NAME = {alias: name for name, aliases in ALIASES.items() for alias in aliases}
REGEX = ("matches", "not_matches")


def token_set(tokens: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens))


def compare(op: str, expected: Column, actual: Column) -> Column:
    """Whether the token sets stand in the relation."""
    if op == "eq":
        return expected == actual
    if op == "ne":
        return expected != actual
    if op == "subset":
        return F.size(F.array_except(expected, actual)) == 0
    if op == "superset":
        return F.size(F.array_except(actual, expected)) == 0
    if op == "intersect":
        return F.arrays_overlap(expected, actual)
    raise ValueError(f"{op} doesn't compare sets")
