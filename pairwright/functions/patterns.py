"""Regular expressions: the rule language's dialect in Java's terms, and literal separators.

In the rule language classes such as ``[[:space:]]`` are ASCII, ``\\d \\w \\s \\b`` are Unicode, ``$`` stands
only at the very end, and neither look-around nor back-references exist.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class PatternError(ValueError):
    pass


#: The POSIX classes.
POSIX = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": r"\x00-\x7F",
    "blank": r"\t ",
    "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": " -~",
    "punct": r"!-/:-@\[-`{-~",
    "space": r"\t\n\x0B\f\r ",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}


def to_java(source: str, ignore_case: bool = False) -> str:
    """The pattern for Java's regex engine; PatternError for what the dialect hasn't."""
    out, i, n = [], 0, len(source)
    multi_line = bool(re.match(r"\(\?[a-zA-Z]*m", source))
    depth = 0
    while i < n:
        c = source[i]
        if c == "\\":
            if i + 1 >= n:
                raise PatternError("pattern ends with a backslash")
            d = source[i + 1]
            if d.isdigit() or d == "k":
                raise PatternError("back-references are not supported")
            if d in "ZG":
                raise PatternError(f"\\{d} is not supported")
            if m := re.match(r"\\x\{([0-9A-Fa-f]+)\}|\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})", source[i:]):
                out.append("\\x{" + next(g for g in m.groups() if g) + "}")
                i += m.end()
                continue
            out.append("\\" + d)
            i += 2
        elif c == "[":
            body, i = _class(source, i)
            out.append(body)
        elif c == "(":
            depth += 1
            if source.startswith(("(?=", "(?!", "(?<=", "(?<!", "(?>"), i):
                raise PatternError("look-around is not supported")
            if source.startswith("(?P<", i):
                out.append("(?<")
                i += 4
            else:
                out.append("(")
                i += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise PatternError("unopened group")
            out.append(c)
            i += 1
        elif c == "$" and not multi_line:
            out.append(r"\z")
            i += 1
        else:
            if c in "*+?}" and source[i + 1 : i + 2] == "+":
                raise PatternError("possessive repetition is not supported")
            out.append(c)
            i += 1
    if depth:
        raise PatternError("unclosed group")
    java = ("(?iuU)" if ignore_case else "(?U)") + "".join(out)
    _compiles(java)
    return java


def _class(source: str, i: int) -> tuple[str, int]:
    """A bracketed class from source[i] on, and where it ends."""
    out, n = ["["], len(source)
    i += 1
    if source.startswith("^", i):
        out.append("^")
        i += 1
    if source.startswith("]", i):
        out.append(r"\]")
        i += 1
    while i < n:
        if m := re.match(r"\[:(\^?)([a-z]+):\]", source[i:]):
            if m[2] not in POSIX:
                raise PatternError(f"unknown class {m[0]}")
            out.append(f"[^{POSIX[m[2]]}]" if m[1] else POSIX[m[2]])
            i += m.end()
        elif source[i] == "\\":
            if i + 1 >= n:
                raise PatternError("pattern ends with a backslash")
            out.append(source[i : i + 2])
            i += 2
        elif source[i] == "]":
            return "".join(out) + "]", i + 1
        elif source[i] == "[":
            body, i = _class(source, i)
            out.append(body)
        else:
            out.append(source[i])
            i += 1
    raise PatternError("unclosed class")


def _compiles(java: str) -> None:
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    if sc is not None:
        try:
            sc._jvm.java.util.regex.Pattern.compile(java)
        except Exception as e:
            raise PatternError(f"invalid pattern: {str(e).splitlines()[0]}") from None


def groups(source: str) -> int:
    """Capture groups of the pattern."""
    plain = re.sub(r"\\.|\[(?:\\.|\[:\w+:\]|[^\]])*\]", "", source)
    return len(re.findall(r"\((?!\?)|\(\?P?<(?![=!])", plain))


def replacement(text: str, source: str) -> str:
    """A replacement ($1, $name, ${name}, $$) in Java's terms; groups that don't exist are empty."""
    names = re.findall(r"\(\?P?<(\w+)>", source)
    count = groups(source)

    def one(m: re.Match) -> str:
        if m[0] == "$$":
            return r"\$"
        if m[0] == "\\":
            return r"\\"
        name = m[1] or m[2]
        if name is None:
            return r"\$"
        if name.isdigit():
            return f"${int(name)}" if int(name) <= count else ""
        return "${" + name + "}" if name in names else ""

    return re.sub(r"\$\$|\\|\$\{(\w+)\}|\$(\w+)|\$", one, text)


@dataclass(frozen=True)
class Regex:
    """A pattern of the rule language."""

    source: str
    ignore_case: bool = False

    def __post_init__(self):
        to_java(self.source, self.ignore_case)

    @property
    def java(self) -> str:
        return to_java(self.source, self.ignore_case)

    def found(self, text: Column) -> Column:
        return F.rlike(text, F.lit(self.java))

    def group(self, text: Column, g: int) -> Column:
        """The group of the first match; null without a match or such a group."""
        if g > groups(self.source):
            return F.lit(None).cast("string")
        return F.when(self.found(text), F.regexp_extract(text, self.java, g))

    def replace(self, text: Column, by: str) -> Column:
        return F.regexp_replace(text, self.java, replacement(by, self.source))

    def all(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.java), F.lit(0))

    def split(self, text: Column, limit: int = -1) -> Column:
        return F.split(text, self.java, limit)


@dataclass(frozen=True)
class Literal:
    """A separator that is plain text; empty: nothing is split."""

    text: str

    def split(self, value: Column) -> Column:
        if not self.text:
            return F.array(value)
        return F.split(value, quoted(self.text), -1)


def quoted(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text) if text.isascii() else "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


Separator = Literal | Regex

#: The characters of Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim(text: Column) -> Column:
    """Without white space at both ends, in Unicode's sense."""
    return F.btrim(text, F.lit(WHITE))


def tokens(text: Column, multi: bool, separator: Separator) -> Column:
    """The text's tokens: split, trimmed, without empty ones if multi, else the text as it is."""
    if not multi:
        return F.array(text)
    return F.filter(F.transform(separator.split(text), trim), lambda t: t != "")
