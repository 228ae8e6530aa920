"""The rule language: text to a program of rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from pathlib import Path

from pairwright.functions import comparisons
from pairwright.functions.patterns import Literal, PatternError, Regex, Separator
from pairwright.functions.predicates import Predicate
from pairwright.functions.transforms import DateFormatError, Transform, java_format
from pairwright.functions.transforms import READ, WRITE
from pairwright.plans import expression


class RuleError(ValueError):
    """What is wrong with a rule file, with its line."""


# Values -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Many:
    items: tuple


@dataclass(frozen=True)
class Calling:
    name: str
    args: tuple


@dataclass(frozen=True)
class Steps:
    steps: tuple


@dataclass(frozen=True)
class Columns:
    """A side: one column, several joined, or (fallback) the first that isn't empty."""

    names: tuple[str, ...] = ()
    fallback: bool = False

    def __str__(self) -> str:
        return f"or({', '.join(self.names)})" if self.fallback else " + ".join(self.names)


@dataclass
class Source:
    files: tuple[str, ...] = ()
    left: tuple[str, ...] = ()
    right: tuple[str, ...] = ()
    key: Columns | None = None
    multi: bool = False
    separator: Separator | None = None
    filter: Predicate | None = None
    when: str = "unmapped"
    by_rule: bool = False


@dataclass
class Defaults:
    separator: Separator = Literal(";")
    multi: bool = False
    compare: str = "eq"
    report_limit: int = 10
    mapping_separator: Separator = Literal(";")
    join_separator: str = "|"
    trim: bool = False
    allow_empty: bool = False
    left_label: str | None = None
    right_label: str | None = None


@dataclass
class Rule:
    name: str
    left: Columns = Columns()
    right: Columns = Columns()
    transform_left: list[Transform] = field(default_factory=list)
    transform_right: list[Transform] = field(default_factory=list)
    derive: list[expression.Derived] = field(default_factory=list)
    check: str | None = None
    compare: str | None = None
    multi: bool | None = None
    separator: Separator | None = None
    join_separator: str | None = None
    pattern: Regex | None = None
    trim: bool | None = None
    allow_empty: bool | None = None
    skip: Predicate | None = None
    mapping_filter: Predicate | None = None
    report_limit: int | None = None
    auto: bool = False
    sources: list[Source] = field(default_factory=list)


@dataclass
class Program:
    defaults: Defaults
    rules: list[Rule]


# Scanning ---------------------------------------------------------------------------------------------

PART = re.compile(r"\\.|[\"'\[\](){}|,#]|[^\\\"'\[\](){}|,#]+|\\", re.S)


def _scan(text: str, quote: str = ""):
    """(part, depth before it, inside a quotation) of each part of the text, and the quotation left open."""
    depth = 0
    for m in PART.finditer(text):
        p = m[0]
        yield p, depth, bool(quote)
        if quote:
            quote = "" if p == quote else quote
        elif p in "\"'":
            quote = p
        elif p in "[({":
            depth += 1
        elif p in "])}":
            depth -= 1


def _uncommented(line: str, quote: str) -> tuple[str, str]:
    out = []
    for p, _, inside in _scan(line, quote):
        if p == "#" and not inside:
            break
        if p in ("'", '"') and (not quote or p == quote):
            quote = "" if quote else p
        out.append(p)
    return "".join(out), quote


def _closed(text: str) -> bool:
    depth, quote = 0, ""
    for p, _, inside in _scan(text):
        if inside:
            quote = "" if p == quote else quote
        elif p in ("'", '"'):
            quote = p
        else:
            depth += (p in "[(") - (p in "])") if len(p) == 1 else 0
    return depth <= 0 and not quote


def _split(text: str, by: str) -> list[str]:
    parts, now = [], ""
    for p, depth, inside in _scan(text):
        if p == by and not depth and not inside:
            parts.append(now.strip())
            now = ""
        else:
            now += p
    return [*parts, now.strip()]


def parse_value(text: str):
    steps = _split(text, "|")
    if len(steps) > 1:
        if not all(steps):
            raise RuleError("invalid pipeline: empty step")
        return Steps(tuple(map(_atom, steps)))
    return _atom(text)


def _atom(text: str):
    s = text.strip()
    if s[:1] in ("'", '"') and s:
        if len(s) < 2 or s[-1] != s[0]:
            raise RuleError(f"unterminated string: {s}")
        return Text(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'"}.get(m[1], m[0]), s[1:-1], flags=re.S))
    items = lambda inner: tuple(map(parse_value, _split(inner, ","))) if inner.strip() else ()
    if s.startswith("[") and s.endswith("]"):
        return Many(items(s[1:-1]))
    if m := re.fullmatch(r"([^\W\d][\w.-]*)\s*\((.*)\)", s, re.S):
        return Calling(m[1], items(m[2]))
    return Text(s)


def source_text(v) -> str:
    """A value as expression text."""
    match v:
        case Text(s):
            return s
        case Many(items):
            return f"[{', '.join(map(source_text, items))}]"
        case Calling(name, args):
            return f"{name}({', '.join(map(source_text, args))})"
        case Steps(steps):
            return " | ".join(map(source_text, steps))


# Readers of values ------------------------------------------------------------------------------------


def text(v) -> str:
    if not isinstance(v, Text):
        raise RuleError("expects a text")
    return v.value


def texts(v) -> tuple[str, ...]:
    found = tuple(text(x) for x in v.items) if isinstance(v, Many) else (text(v),)
    if not found:
        raise RuleError("list must not be empty")
    return found


def flag(v) -> bool:
    word = text(v).strip().lower()
    if word not in ("true", "yes", "1", "on", "false", "no", "0", "off"):
        raise RuleError("expects true or false")
    return word in ("true", "yes", "1", "on")


def count(v) -> int:
    if not re.fullmatch(r"\+?\d+", text(v).strip()):
        raise RuleError("expects a whole number")
    return int(text(v))


def label(v) -> str | None:
    return text(v).strip() or None


def regex(v) -> Regex:
    try:
        if isinstance(v, Calling) and v.name.lower() == "regex" and len(v.args) == 1:
            return Regex(text(v.args[0]))
        return Regex(text(v))
    except PatternError as e:
        raise RuleError(f"invalid regex: {e}") from None


def is_regex(v) -> bool:
    return isinstance(v, Calling) and v.name.strip().lower() == "regex"


def separator(v) -> Separator:
    return regex(v) if is_regex(v) else Literal(text(v))


def operator(v) -> str:
    name = comparisons.BY_NAME.get(text(v).strip().lower())
    if not name:
        raise RuleError("unknown comparison operator")
    return name


def columns(v) -> Columns:
    if isinstance(v, Calling) and v.name.lower() in ("or", "coalesce", "first", "first_non_empty"):
        names = tuple(n for a in v.args for n in (map(text, a.items) if isinstance(a, Many) else (text(a),)))
        if not names:
            raise RuleError("or(...) needs at least one column")
        return Columns(names, True)
    if isinstance(v, (Calling, Steps)):
        return Columns((source_text(v),))
    return Columns(texts(v))


def predicate(v) -> Predicate:
    if isinstance(v, Text):
        word = v.value.strip().lower()
        if word not in ("true", "always", "yes", "false", "never", "no"):
            raise RuleError(f"unknown predicate `{word}`")
        return Predicate("const", const=word in ("true", "always", "yes"))
    if not isinstance(v, Calling):
        raise RuleError("expects a predicate")
    name, args = v.name.lower(), v.args
    kind = PREDICATES.get(name)
    if not kind:
        raise RuleError(f"unknown predicate `{name}`")
    if kind in ("and", "or"):
        parts = tuple(predicate(x) for a in args for x in (a.items if isinstance(a, Many) else (a,)))
        if not parts:
            raise RuleError(f"`{name}` needs at least one predicate")
        return Predicate(kind, parts=parts)
    wants = 1 if kind in ("not", "empty", "not_empty") else 2
    if len(args) != wants:
        raise RuleError(f"`{name}` expects {wants} argument{'s' * (wants > 1)}")
    if kind == "not":
        return Predicate("not", parts=(predicate(args[0]),))
    if kind in ("any_in", "all_in"):
        group = tuple((text(x),) for x in args[0].items) if isinstance(args[0], Many) else (_one(args[0]),)
        return Predicate(kind, group, texts(args[1]) if args[1] != Many(()) else ())
    one = (_one(args[0]),)
    if wants == 1:
        return Predicate(kind, one)
    if kind in ("eq", "ne"):
        return Predicate(kind, one, (text(args[1]),))
    values = texts(args[1]) if args[1] != Many(()) else ()
    found = Predicate("in", one, values)
    return Predicate("not", parts=(found,)) if kind == "not_in" else found


def _one(v) -> tuple[str, ...]:
    c = columns(v)
    if len(c.names) > 1 and not c.fallback:
        raise RuleError("a predicate looks at one column or or(...)")
    return c.names


#: The predicates' names.
PREDICATES = {
    "in": "in", "one_of": "in", "not_in": "not_in", "nin": "not_in", "any_in": "any_in", "all_in": "all_in",
    "eq": "eq", "equals": "eq", "ne": "ne", "neq": "ne", "not_eq": "ne", "not_equals": "ne",
    "empty": "empty", "is_empty": "empty", "not_empty": "not_empty", "notempty": "not_empty", "non_empty": "not_empty", "is_not_empty": "not_empty",
    "and": "and", "all": "and", "or": "or", "any": "or", "not": "not",
}
#: The transforms' names.
PLAIN = {"lower": "lower", "lowercase": "lower", "upper": "upper", "uppercase": "upper", "trim": "trim", "collapse": "collapse", "squash": "collapse", "int": "int", "integer": "int", "float": "float", "number": "float", "bool": "bool", "boolean": "bool"}


def transforms(v) -> list[Transform]:
    steps = v.steps if isinstance(v, Steps) else (v,)
    return [t for t in map(transform, steps) if t]


def transform(v) -> Transform | None:
    if isinstance(v, Text):
        word = v.value.strip().lower()
        if word in ("none", "identity", ""):
            return None
        if word not in PLAIN:
            raise RuleError(f"unknown transform `{word}`")
        return Transform(PLAIN[word])
    if not isinstance(v, Calling):
        raise RuleError("invalid transform value")
    name, args = v.name.lower(), v.args
    if not args:
        raise RuleError(f"{name}() needs an argument")
    if name in ("date", "datetime", "time"):
        if len(args) > 2:
            raise RuleError("date(format) or date([formats], output) expected")
        inputs, output = texts(args[0]) if len(args) == 2 else (text(args[0]),), text(args[1]) if len(args) == 2 else "%Y-%m-%d"
        try:
            for f in inputs:
                java_format(f, READ)
            java_format(output, WRITE)
        except DateFormatError as e:
            raise RuleError(str(e)) from None
        return Transform("date", (inputs, output))
    if name in ("replace", "regex_replace"):
        if len(args) != 2:
            raise RuleError(f"{name}(from, to) expects 2 arguments")
        if name == "regex_replace" or is_regex(args[0]):
            return Transform("regex_replace", (regex(args[0]), text(args[1])))
        return Transform("replace", (text(args[0]), text(args[1])))
    if name in ("match", "capture", "regex"):
        return Transform("match", (regex(args[0]), count(args[1]) if len(args) > 1 and name != "regex" else 0))
    if name in ("regex_keep", "keep"):
        return Transform("regex_keep", (regex(args[0]),))
    if name in ("prefix", "suffix"):
        return Transform(name, (text(args[0]),))
    raise RuleError(f"unknown transform `{name}`")


def derive(v) -> list[expression.Derived]:
    try:
        return expression.parse_derive(text(v))
    except (expression.ExpressionError, PatternError) as e:
        raise RuleError(f"invalid derive expression: {e}") from None


def fallback_mode(v) -> str:
    word = text(v).strip().lower()
    for mode, names in {"unmapped": ("unmapped", "missing", "not_found", ""), "ambiguous": ("ambiguous",), "always": ("always", "override")}.items():
        if word in names:
            return mode
    raise RuleError(f"`when` must be `unmapped`, `ambiguous` or `always`, got `{word}`")


def _keys(**of) -> dict:
    """Key names (aliases separated by a space) to (attribute, reader)."""
    return {name: (attribute, read) for attribute, (names, read) in of.items() for name in names.split()}


SHARED = {"separator": ("separator", separator), "multi": ("multi", flag), "compare": ("compare", operator), "report_limit": ("report_limit", count), "join_separator": ("join_separator", text), "trim": ("trim", flag), "allow_empty": ("allow_empty", flag), "optional": ("allow_empty", flag)}
DEFAULT_KEYS = SHARED | _keys(mapping_separator=("mapping_separator", separator), left_label=("left_label label_left", label), right_label=("right_label label_right", label))
RULE_KEYS = SHARED | _keys(
    left=("left", columns), right=("right", columns), transform_left=("transform_left", transforms), transform_right=("transform_right", transforms), derive=("derive", derive), check=("check", text), pattern=("pattern", regex), skip=("validation_skipped skip_when skip", predicate), mapping_filter=("mapping_filter", predicate),
)
SOURCE_KEYS = _keys(files=("files file", texts), left=("left mapping_left", texts), right=("right mapping_right", texts), key=("key data columns mapping_key", columns), multi=("multi mapping_multi", flag), separator=("separator mapping_separator", separator), filter=("filter mapping_filter", predicate), when=("when on fallback", fallback_mode))
LEGACY = {"mapping_files": "files", "mapping_left": "left", "mapping_right": "right", "mapping_multi": "multi", "mapping_separator": "separator", "mapping_key": "key"}


def _set(target, keys: dict, key: str, value, what: str) -> None:
    if key not in keys:
        raise RuleError(f"unknown {what} key `{key}`")
    attribute, read = keys[key]
    try:
        setattr(target, attribute, read(value))
    except RuleError as e:
        raise RuleError(f"`{key}`: {e}") from None


def _rule_key(rule: Rule, key: str, value) -> None:
    if key == "mapping":
        word = text(value).lower()
        if word not in ("none", "off", "", "auto", "extract"):
            raise RuleError(f"`mapping` must be `auto` or `none`, got `{word}`")
        rule.auto, rule.sources = word in ("auto", "extract"), []
    elif key in LEGACY:
        if key == "mapping_files" and len(rule.sources) != 1:
            rule.sources = []
        rule.auto = False
        rule.sources = rule.sources or [Source()]
        rule.sources[0].by_rule = True
        _set(rule.sources[0], {key: SOURCE_KEYS[LEGACY[key]]}, key, value, "rule")
    else:
        _set(rule, RULE_KEYS, key, value, "rule")


def _finished(rule: Rule) -> Rule:
    fail = lambda why: RuleError(f"rule '{rule.name}': {why}")
    if rule.check is not None:
        if not rule.check.strip():
            raise fail("`check` must not be empty")
        for what, there in (("`left` or `right`", rule.left.names or rule.right.names), ("`pattern`", rule.pattern), ("a mapping", rule.auto or rule.sources), ("transforms", rule.transform_left or rule.transform_right)):
            if there:
                raise fail(f"a `check` rule cannot also set {what}")
        return rule
    for s in rule.sources:
        if not s.left and s.key is None:
            raise fail("a mapping source needs `left` (reference columns) or `key` (data columns)")
        if not s.right:
            raise fail("a mapping source needs `right` (reference target columns)")
        if s.key is None:
            s.key = rule.left if s.by_rule and rule.left.names else Columns(s.left)
        if not s.left:
            if s.key.fallback:
                raise fail("a mapping source needs `left` (reference columns)")
            s.left = s.key.names
    if not rule.left.names:
        if not rule.sources:
            raise fail("`left` column is required")
        rule.left = rule.sources[0].key
    if not rule.right.names and rule.pattern is None:
        raise fail("both `left` and `right` columns are required (or set `pattern`)")
    return rule


def parse(source: str) -> Program:
    """A program from rule text; RuleError with the line of what is wrong."""
    program = Program(Defaults(), [])
    block: Rule | Defaults | None = None
    inner: Source | None = None
    held, quote = "", ""
    lines = source.splitlines()
    for number, raw in enumerate(lines, 1):
        line, quote = _uncommented(raw, quote)
        if not held and not line.strip():
            continue
        held = f"{held}\n{line}" if held else line
        if not _closed(held):
            continue
        statement, held = held.strip(), ""
        try:
            if statement.endswith("{"):
                header = statement[:-1].strip()
                if header == "defaults":
                    block = program.defaults
                elif header == "mapping" and isinstance(block, Rule):
                    if inner:
                        raise RuleError("nested `mapping` block")
                    inner = Source()
                elif m := re.fullmatch(r"rule\s*(.*)", header, re.S):
                    name = parse_value(m[1])
                    if not isinstance(name, Text) or not name.value:
                        raise RuleError("invalid rule name")
                    block = Rule(name.value)
                else:
                    raise RuleError(f"unexpected block '{header}'")
            elif statement == "}":
                if inner:
                    block.auto = False
                    block.sources.append(inner)
                    inner = None
                else:
                    if isinstance(block, Rule):
                        program.rules.append(_finished(block))
                    block = None
            elif statement:
                key, equals, value = statement.partition("=")
                key = key.strip()
                if not equals:
                    raise RuleError("expected `key = value`")
                if block is None:
                    raise RuleError(f"assignment `{key}` outside of a block")
                value = parse_value(value.strip())
                if inner:
                    _set(inner, SOURCE_KEYS, key, value, "mapping")
                elif isinstance(block, Rule):
                    _rule_key(block, key, value)
                else:
                    _set(block, DEFAULT_KEYS, key, value, "defaults")
        except RuleError as e:
            raise RuleError(str(e) if str(e).startswith("rule '") else f"line {number}: {e}") from None
    if held.strip():
        raise RuleError("unterminated statement at end of file")
    if isinstance(block, Rule):
        program.rules.append(_finished(block))
    if not program.rules:
        raise RuleError("no rules were defined")
    return program


def load(path: str) -> Program:
    try:
        return parse(Path(path).read_text())
    except OSError as e:
        raise RuleError(f"failed to read rules file {path}: {e}") from None
    except RuleError as e:
        raise RuleError(f"{path}: {e}") from None


def with_limit(program: Program, limit: int) -> Program:
    return replace(program, defaults=replace(program.defaults, report_limit=limit))
