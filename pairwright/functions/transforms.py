"""Transforms of a side. Each gives the new text and whether it worked; a failed step leaves the text as it
was, and the steps after it still run."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions import numbers
from pairwright.functions.patterns import Regex, trim

Step = tuple[Column, Column | None]  # the text; whether it worked (None: always)


@dataclass(frozen=True)
class Transform:
    name: str
    args: tuple = ()

    def __call__(self, text: Column) -> Step:
        return STEPS[self.name](text, *self.args)


def run(text: Column, steps: list[Transform]) -> tuple[Column, Column]:
    """The text after all steps, and whether all of them worked."""
    ok = F.lit(True)
    for step in steps:
        text, worked = step(text)
        if worked is not None:
            ok = ok & worked
    return text, ok


def _maybe(text: Column, new: Column) -> Step:
    return F.coalesce(new, text), new.isNotNull()


def _literal(text: Column, old: str, new: str) -> Step:
    if old:
        return F.replace(text, F.lit(old), F.lit(new)), None
    letters = F.filter(F.split(text, ""), lambda x: x != "")
    return F.concat(F.lit(new), F.array_join(F.transform(letters, lambda x: F.concat(x, F.lit(new))), "")), None


#: Words for true and for false.
TRUE, FALSE = ("true", "t", "yes", "y", "1", "vrai", "oui"), ("false", "f", "no", "n", "0", "faux", "non")

#: Directives of date formats, as Java reads them and as it writes them.
READ = {"Y": "y", "m": "M", "d": "d", "e": "d", "H": "H", "k": "H", "I": "h", "l": "h", "M": "m", "S": "s", "y": "yy", "b": "MMM", "h": "MMM", "B": "MMMM", "p": "a", "P": "a", "a": "E", "A": "EEEE", "j": "D", "f": "SSSSSSSSS", "z": "xx", "F": "y-M-d", "T": "H:m:s", "R": "H:m", "D": "M/d/yy"}
WRITE = READ | {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "j": "DDD", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy"}
RFC3339 = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"


class DateFormatError(ValueError):
    pass


def java_format(format_: str, directives: dict[str, str]) -> str:
    out, plain = [], ""

    def flush() -> None:
        nonlocal plain
        if plain:
            out.append("'" + plain.replace("'", "''") + "'")
        plain = ""

    i = 0
    while i < len(format_):
        c = format_[i]
        if c == "%":
            m = re.match(r"%[-_0]?([A-Za-z%])", format_[i:])
            if not m or m[1] not in directives and m[1] != "%":
                raise DateFormatError(f"unknown date directive in {format_!r}")
            if m[1] == "%":
                plain += "%"
            else:
                flush()
                out.append(directives[m[1]])
            i += m.end()
            continue
        plain += c
        i += 1
    flush()
    return "".join(out)


def _date(text: Column, formats: tuple[str, ...], output: str) -> Step:
    t = trim(text)
    tries = [F.try_to_timestamp(t, F.lit(java_format(f, READ))) for f in formats]
    zoned = F.when(F.rlike(t, F.lit(RFC3339)), F.to_utc_timestamp(F.upper(t).try_cast("timestamp"), F.current_timezone()))
    return _maybe(text, F.when(t != "", F.date_format(F.coalesce(*tries, zoned), java_format(output, WRITE))))


STEPS: dict[str, Callable[..., Step]] = {
    "lower": lambda t: (F.lower(t), None),
    "upper": lambda t: (F.upper(t), None),
    "trim": lambda t: (trim(t), None),
    "collapse": lambda t: (F.regexp_replace(trim(t), r"(?U)\s+", " "), None),
    "date": _date,
    "int": lambda t: _maybe(t, numbers.as_long(t).cast("string")),
    "float": lambda t: _maybe(t, F.when(~F.isnan(numbers.as_double(t)) & (F.abs(numbers.as_double(t)) < float("inf")), numbers.double_text(numbers.as_double(t)))),
    "bool": lambda t: _maybe(t, F.when(F.lower(trim(t)).isin(*TRUE), "true").when(F.lower(trim(t)).isin(*FALSE), "false")),
    "replace": _literal,
    "regex_replace": lambda t, r, new: (r.replace(t, new), None),
    "match": lambda t, r, g: _maybe(t, r.group(t, g)),
    "regex_keep": lambda t, r: (F.array_join(r.all(t), ""), None),
    "prefix": lambda t, s: (F.concat(F.lit(s), t), None),
    "suffix": lambda t, s: (F.concat(t, F.lit(s)), None),
}

__all__ = ["DateFormatError", "Regex", "Transform", "java_format", "run"]
