"""Expression values as columns.

A value has several facets, each a column that only enters a plan if something uses it: its text, its
number, its whole number, whether it is true, whether it is null, its kind and, for a list, its items as
texts. Where a value's kind depends on the row, each facet depends on the row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions import numbers
from pairwright.functions.patterns import WHITE, Regex, quoted, trim
from pairwright.plans import expression as E

NULL_TEXT = lambda: F.lit(None).cast("string")
NO = lambda: F.lit(False)


@dataclass(eq=False)
class Value:
    make_text: Callable[[], Column]
    make_number: Callable[[], Column] | None = None
    make_whole: Callable[[], Column] | None = None
    make_true: Callable[[], Column] | None = None
    make_null: Callable[[], Column] | None = None
    make_kind: Callable[[], Column] | None = None
    make_items: Callable[[], Column] | None = None
    parts: list | None = None  # of a list written out
    regex: Regex | None = None
    const: object = None

    @cached_property
    def text(self) -> Column:
        return self.make_text()

    @cached_property
    def number(self) -> Column:
        return self.make_number() if self.make_number else F.lit(None).cast("double")

    @cached_property
    def whole(self) -> Column:
        return self.make_whole() if self.make_whole else F.lit(None).cast("bigint")

    @cached_property
    def true(self) -> Column:
        return self.make_true() if self.make_true else NO()

    @cached_property
    def null(self) -> Column:
        return self.make_null() if self.make_null else NO()

    @cached_property
    def kind(self) -> Column:
        return self.make_kind() if self.make_kind else F.lit("string")

    @cached_property
    def items(self) -> Column | None:
        return self.make_items() if self.make_items else None

    def joined(self, separator: str) -> Column:
        """The text; a list's items joined by the separator."""
        return self.text if self.items is None else F.coalesce(F.array_join(self.items, separator), self.text)


def null() -> Value:
    return Value(lambda: F.lit(""), make_null=lambda: F.lit(True), make_kind=lambda: F.lit("none"))


def text(c: Column) -> Value:
    """A text; null is the null value."""
    return Value(
        lambda: F.coalesce(c, F.lit("")),
        lambda: numbers.as_double(c),
        lambda: numbers.as_long(c),
        lambda: F.coalesce(c != "", NO()),
        lambda: c.isNull(),
        lambda: F.when(c.isNull(), "none").otherwise("string"),
    )


def cell(c: Column) -> Value:
    """A text that is never null."""
    return Value(lambda: c, lambda: numbers.as_double(c), lambda: numbers.as_long(c), lambda: c != "")


def truth(c: Column) -> Value:
    """A boolean; null is the null value."""
    return Value(
        lambda: F.when(c, "true").when(~c, "false").otherwise(""),
        lambda: c.cast("int").cast("double"),
        lambda: c.cast("bigint"),
        lambda: F.coalesce(c, NO()),
        lambda: c.isNull(),
        lambda: F.when(c.isNull(), "none").otherwise("boolean"),
    )


def number(c: Column, floating: bool = False) -> Value:
    """A double; null is the null value. Whole ones count as integers unless floating."""
    as_whole = F.lit("float") if floating else F.when((c == F.floor(c)) & (F.abs(c) < 1e15), "integer").otherwise("float")
    return Value(
        lambda: F.coalesce(numbers.double_text(c), F.lit("")),
        lambda: c,
        lambda: numbers.whole(c),
        lambda: F.coalesce(c != 0, NO()),
        lambda: c.isNull(),
        lambda: F.when(c.isNull(), "none").otherwise(as_whole),
    )


def integer(c: Column) -> Value:
    return Value(
        lambda: F.coalesce(c.cast("string"), F.lit("")),
        lambda: c.cast("double"),
        lambda: c,
        lambda: F.coalesce(c != 0, NO()),
        lambda: c.isNull(),
        lambda: F.when(c.isNull(), "none").otherwise("integer"),
    )


def items(c: Column, parts: list | None = None) -> Value:
    return Value(lambda: F.array_join(c, ","), make_true=lambda: F.size(c) > 0, make_kind=lambda: F.lit("list"), make_items=lambda: c, parts=parts)


def constant(v: object) -> Value:
    if v is None:
        out = null()
    elif isinstance(v, bool):
        out = truth(F.lit(v))
    elif isinstance(v, int):
        out = integer(F.lit(v).cast("bigint"))
    elif isinstance(v, float):
        out = number(F.lit(v), floating=True)
    elif isinstance(v, Regex):
        out = Value(lambda: F.lit(v.source), make_true=lambda: F.lit(True), make_kind=lambda: F.lit("regex"), regex=v)
    else:
        out = cell(F.lit(v))
    out.const = v
    return out


def either(cond: Column, a: Value, b: Value) -> Value:
    """a where cond holds, else b; facet by facet."""
    pick = lambda f: lambda: F.when(cond, f(a)).otherwise(f(b))
    lists = None
    if a.items is not None or b.items is not None:
        none = F.lit(None).cast("array<string>")
        lists = pick(lambda v: none if v.items is None else v.items)
    return Value(pick(lambda v: v.text), pick(lambda v: v.number), pick(lambda v: v.whole), pick(lambda v: v.true), pick(lambda v: v.null), pick(lambda v: v.kind), lists)


class Compiler:
    """Trees to values. ``resolve`` gives the value of a name, ``column`` that of a col(...) call."""

    def __init__(self, resolve: Callable[[str], Value], column: Callable[[list], Value]):
        self.resolve = resolve
        self.column = column

    def __call__(self, tree) -> Value:
        match tree:
            case E.Const(v):
                return constant(v)
            case E.Name(name):
                return self.resolve(name)
            case E.Current():
                return null()
            case E.ListOf(parts):
                values = [self(p) for p in parts]
                return items(F.array(*[v.text for v in values]) if values else F.array().cast("array<string>"), values)
            case E.Unary("not", a):
                return truth(~self(a).true)
            case E.Unary("-", a):
                return number(-self(a).number)
            case E.Op("or", a, b):
                x = self(a)
                return either(x.true, x, self(b))
            case E.Op("and", a, b):
                x = self(a)
                return either(x.true, self(b), x)
            case E.Op(op, a, b):
                return binary(op, self(a), self(b))
            case E.Index(a, b):
                return get(self(a), self(b))
            case E.Slice(a, b, c):
                return cut(self(a), b and self(b), c and self(c))
            case E.Call("col", args):
                return self.column([getattr(x, "value", -x.operand.value if isinstance(x, E.Unary) else None) for x in args])
            case E.Call("in_any", args):
                return self(in_any(args))
            case E.Call(name, args):
                return call(name, [self(x) for x in args])
        raise E.ExpressionError(f"can't compile {tree!r}")


def in_any(args: tuple):
    """in_any([a, b], ["x", ...]): whether any of the values is one of the texts."""
    if len(args) != 2 or not all(isinstance(x, E.ListOf) for x in args) or not args[0].items:
        raise E.ExpressionError("in_any needs a list of values and a list of texts")
    if not all(isinstance(x, E.Const) and isinstance(x.value, str) for x in args[1].items):
        raise E.ExpressionError("in_any accepts texts only")
    tree = None
    for one in args[0].items:
        test = E.Op("in", one, args[1])
        tree = test if tree is None else E.Op("or", tree, test)
    return tree


def _ordered(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


TEXT_TESTS = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b}
NUMBER_TESTS = {"==": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}


def binary(op: str, a: Value, b: Value) -> Value:
    if op in TEXT_TESTS:
        return truth(TEXT_TESTS[op](a.text, b.text))
    if op in NUMBER_TESTS:
        return truth(TEXT_TESTS[NUMBER_TESTS[op]](_ordered(a.number), _ordered(b.number)))
    if op == "in":
        return contains(b, a)
    if op == "++":
        return cell(F.concat(a.text, b.text))
    x, y = a.number, b.number
    by = F.when(y != 0, y)
    if op == "/":
        return number(x / by, floating=True)
    if op == "//":
        q = x / by
        return number(F.signum(q) * F.floor(F.abs(q)).cast("double"))
    return number({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "%": lambda: x % by, "**": lambda: F.pow(x, y)}[op]())


def equal(a_text: Column, a_number: Column, b: Value) -> Column:
    """Equal as numbers if both are numbers, else as texts."""
    return F.when(a_number.isNotNull() & b.number.isNotNull(), (a_number == b.number) & ~F.isnan(a_number)).otherwise(a_text == b.text)


def contains(whole: Value, part: Value) -> Value:
    if whole.parts is not None:
        test = NO()
        for p in whole.parts:
            test = test | equal(p.text, p.number, part)
        return truth(test)
    if whole.items is not None:
        return truth(F.coalesce(F.exists(whole.items, lambda x: equal(x, numbers.as_double(x), part)), NO()))
    if part.regex:
        return truth(part.regex.found(whole.text))
    return truth(F.contains(whole.text, part.text))


def _place(size: Column, i: Column) -> Column:
    """A place from either end, from 0; null if it is before the start."""
    at = F.when(i < 0, size + i).otherwise(i)
    return F.when(at >= 0, at)


def get(target: Value, index: Value) -> Value:
    if target.parts is not None and isinstance(index.const, int) and not isinstance(index.const, bool):
        i = index.const
        return target.parts[i] if -len(target.parts) <= i < len(target.parts) else null()
    i = index.whole
    if target.items is not None:
        return text(F.get(target.items, _place(F.size(target.items).cast("bigint"), i).cast("int")))
    at = _place(F.char_length(target.text).cast("bigint"), i)
    found = F.substr(target.text, (at + 1).cast("int"), F.lit(1))
    return text(F.when(_indexable(target) & (found != ""), found))


def _indexable(v: Value) -> Column:
    return v.kind == "string"


def cut(target: Value, start: Value | None, end: Value | None) -> Value:
    size = (F.size(target.items) if target.items is not None else F.char_length(target.text)).cast("bigint")

    def bound(v: Value | None, other: Column) -> Column:
        if v is None:
            return other
        at = F.when(v.whole < 0, F.greatest(size + v.whole, F.lit(0))).otherwise(F.least(v.whole, size))
        return F.coalesce(at, other)

    a, b = bound(start, F.lit(0).cast("bigint")), bound(end, size)
    count = F.greatest(b - a, F.lit(0)).cast("int")
    if target.items is not None:
        return items(F.slice(target.items, (a + 1).cast("int"), count))
    return text(F.when(_indexable(target), F.substr(target.text, (a + 1).cast("int"), count)))


def _mapped(v: Value, f: Callable[[Column], Column]) -> Value:
    return items(F.transform(v.items, f)) if v.items is not None else cell(f(v.text))


def _extreme(args: list[Value], least: bool) -> Value:
    if args and args[0].items is not None:
        if args[0].parts is None:
            xs = args[0].items

            def better(x: Column, best: Column) -> Column:
                nx, nb = numbers.as_double(x), numbers.as_double(best)
                numeric = nx.isNotNull() & nb.isNotNull()
                test = F.when(numeric, (nx < nb) if least else (nx > nb)).otherwise((x < best) if least else (x > best))
                return F.when(best.isNull() | test, x).otherwise(best)

            return text(F.aggregate(xs, NULL_TEXT(), lambda best, x: better(x, best)))
        args = args[0].parts
    if not args:
        return null()
    best = args[0]
    for v in args[1:]:
        numeric = v.number.isNotNull() & best.number.isNotNull()
        x, y = _ordered(v.number), _ordered(best.number)
        test = F.when(numeric, F.coalesce((x < y) if least else (x > y), NO())).otherwise((v.text < best.text) if least else (v.text > best.text))
        best = either(test, v, best)
    return best


def _blank(v: Value) -> Column:
    """Null or the empty text."""
    return v.null | ((v.kind == "string") & (v.text == ""))


def _replace(v: Value, what: Value, by: Value) -> Value:
    if what.regex:
        if isinstance(by.const, str):
            return cell(what.regex.replace(v.text, by.const))
        return cell(F.regexp_replace(v.text, F.lit(what.regex.java), by.text))
    return cell(literal_replace(v.text, what.text, by.text, what.const))


def literal_replace(c: Column, what: Column, by: Column, known: object = None) -> Column:
    """All places of a plain text; an empty one stands between all characters."""
    if known:
        return F.replace(c, what, by)
    between = F.concat(by, F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x == "", x).otherwise(F.concat(x, by))), ""))
    return F.when(what == "", between).otherwise(F.replace(c, what, by))


def _split(args: list[Value]) -> Value:
    s, by = args[0].text, args[1] if len(args) > 1 else None
    if by is None:
        return items(F.array(s))
    limit = args[2].const if len(args) > 2 else None
    most = -1 if limit is None else max(0, int(limit)) + 1
    if by.regex:
        return items(by.regex.split(s, most))
    if by.const == "":
        return items(F.concat(F.array(F.lit("")), F.filter(F.split(s, ""), lambda x: x != ""), F.array(F.lit(""))))
    pattern = F.lit(quoted(by.const)) if isinstance(by.const, str) else F.concat(F.lit("\\Q"), by.text, F.lit("\\E"))
    return items(F.split(s, pattern, most))


def _match(args: list[Value]) -> Value:
    if len(args) < 2 or not args[1].regex:
        return null()
    g = args[2].const if len(args) > 2 else 0
    return text(args[1].regex.group(args[0].text, max(0, int(g or 0))))


def call(name: str, args: list[Value]) -> Value:
    one = args[0] if args else null()
    two = args[1] if len(args) > 1 else null()
    three = args[2] if len(args) > 2 else null()
    if name == "if":
        return either(one.true, two, three)
    if name == "unless":
        return either(one.true, three, two)
    if name in ("and", "or"):
        if not args:
            return truth(F.lit(True)) if name == "and" else null()
        out = args[-1]
        for v in reversed(args[:-1]):
            out = either(v.true, out, v) if name == "and" else either(v.true, v, out)
        return out
    if name in TEXT_TESTS:
        return binary(name, one, two)
    if name in ("int", "integer"):
        return integer(one.whole)
    if name in ("float", "number"):
        return number(one.number, floating=True)
    if name in ("abs", "floor", "ceil", "round"):
        x = one.number
        away = F.signum(x) * F.floor(F.abs(x) + 0.5).cast("double")
        return number({"abs": lambda: F.abs(x), "floor": lambda: F.floor(x).cast("double"), "ceil": lambda: F.ceil(x).cast("double"), "round": lambda: away}[name]())
    if name in ("first", "last"):
        if one.items is not None:
            if one.parts:
                return get(one, constant(0 if name == "first" else -1))
            return text(F.when(F.size(one.items) > 0, F.try_element_at(one.items, F.lit(1 if name == "first" else -1))))
        return cell(F.left(one.text, F.lit(1)) if name == "first" else F.right(one.text, F.lit(1)))
    simple: dict[str, Callable[[], Value]] = {
        "not": lambda: truth(~one.true),
        "typeof": lambda: cell(one.kind),
        "match": lambda: _match(args),
        "split": lambda: _split(args or [null()]),
        "replace": lambda: _replace(one, two, three) if len(args) > 1 else cell(one.text),
        "trim": lambda: _mapped(one, trim),
        "ltrim": lambda: _mapped(one, lambda c: F.ltrim(c, F.lit(WHITE))),
        "rtrim": lambda: _mapped(one, lambda c: F.rtrim(c, F.lit(WHITE))),
        "lower": lambda: _mapped(one, F.lower),
        "upper": lambda: _mapped(one, F.upper),
        "join": lambda: cell(F.array_join(one.items, two.const if isinstance(two.const, str) else "")) if one.items is not None else cell(one.text),
        "contains": lambda: contains(one, two),
        "startswith": lambda: truth(F.startswith(one.text, two.text)),
        "endswith": lambda: truth(F.endswith(one.text, two.text)),
        "bool": lambda: truth(one.true),
        "get": lambda: get(one, two),
        "slice": lambda: cut(one, args[1] if len(args) > 1 else None, args[2] if len(args) > 2 else None),
        "min": lambda: _extreme(args, True),
        "max": lambda: _extreme(args, False),
        "coalesce": lambda: _coalesce(args),
        "is_null": lambda: truth(_blank(one)),
        "is_empty": lambda: truth(F.size(one.items) == 0) if one.items is not None else truth(one.text == ""),
        "concat": lambda: cell(F.concat(*[v.text for v in args]) if args else F.lit("")),
    }
    simple["boolean"] = simple["bool"]
    for alias in ("len", "length", "count"):
        simple[alias] = lambda: integer((F.size(one.items) if one.items is not None else F.char_length(one.text)).cast("bigint"))
    for alias in ("string", "str", "to_string"):
        simple[alias] = lambda: cell(one.text)
    if name not in simple:
        raise E.ExpressionError(f"unknown function `{name}`")
    return simple[name]()


def _coalesce(args: list[Value]) -> Value:
    out = null()
    for v in reversed(args):
        out = either(_blank(v), out, v)
    return out
