"""Programs compiled against a table's headers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions import comparisons, transforms
from pairwright.functions.patterns import PatternError, Regex, Separator, trim
from pairwright.functions.predicates import Predicate, compile_predicate
from pairwright.plans import expression as E
from pairwright.plans import values
from pairwright.plans.rules import Columns, Program, Rule, RuleError, Source
from pairwright.sources.tables import column_index


@dataclass(frozen=True)
class Side:
    """parts: names of text columns of the prepared frame."""

    parts: tuple[str, ...]
    fallback: bool = False

    def compose(self, steps: list, join: str, trimmed: bool) -> tuple[Column, Column]:
        """The side's text, and whether its transforms worked."""
        cells = [trim(F.col(p)) if trimmed else F.col(p) for p in self.parts]
        if self.fallback:
            first = F.coalesce(*[F.when(trim(c) != "" if trimmed else c != "", c) for c in cells])
            text, ok = transforms.run(F.coalesce(first, F.lit("")), steps)
            return F.when(first.isNull(), "").otherwise(text), first.isNull() | ok
        done = [transforms.run(c, steps) for c in cells]
        ok = F.lit(True)
        for _, o in done:
            ok = ok & o
        if not done:
            return F.lit(""), ok
        return (done[0][0] if len(done) == 1 else F.concat_ws(join, *[t for t, _ in done])), ok


@dataclass
class SourcePlan:
    source: Source
    key: Side
    separator: Separator
    filter: Predicate | None


@dataclass
class RulePlan:
    index: int
    name: str
    left_name: str
    right_name: str
    left: Side
    right: Side
    rule: Rule
    compare: str
    multi: bool
    separator: Separator
    join: str
    trim: bool
    allow_empty: bool
    limit: int
    pattern: Regex | None
    auto: bool
    sources: list[SourcePlan]
    right_composite: bool
    derived: list[tuple[str, Column]] = field(default_factory=list)
    cells: set[int] = field(default_factory=set)

    @property
    def mapped(self) -> bool:
        return self.auto or bool(self.sources)


@dataclass
class Plan:
    rules: list[RulePlan]
    left_label: str | None
    right_label: str | None
    headers: list[str]


def resolver(headers: list[str], trimmed: bool, context: str, used: set[int] | None = None):
    """Cells by column name, for predicates."""

    def cell(name: str) -> Column:
        i = column_index(headers, name)
        if i is None:
            raise RuleError(f"{context}: unknown column '{name}'")
        if used is not None:
            used.add(i)
        return trim(F.col(f"c{i}")) if trimmed else F.col(f"c{i}")

    return cell


def col_call(headers: list[str], context: str, used: set[int]):
    """col("name"), col("name", n), col(i), col(-i)."""

    def column(args: list) -> values.Value:
        i = None
        if len(args) in (1, 2) and isinstance(args[0], str):
            places = [k for k, h in enumerate(headers) if h == args[0]]
            n = args[1] if len(args) == 2 else 0
            i = places[n] if isinstance(n, int) and 0 <= n < len(places) else None
        elif len(args) == 1 and isinstance(args[0], int):
            i = args[0] + len(headers) * (args[0] < 0)
        if i is None or not 0 <= i < len(headers):
            raise RuleError(f"{context}: col({', '.join(map(repr, args))}) finds no column")
        used.add(i)
        return values.cell(F.col(f"c{i}"))

    return column


def compile_filter(source: str, headers: list[str]) -> Column:
    """An expression as a row filter: true keeps the row."""
    used: set[int] = set()

    def resolve(name: str) -> values.Value:
        return values.cell(resolver(headers, False, "filter", used)(name))

    try:
        return values.Compiler(resolve, col_call(headers, "filter", used))(E.parse(source)).true
    except (E.ExpressionError, PatternError) as e:
        raise RuleError(f"invalid filter: {e}") from None


class _RuleCompiler:
    def __init__(self, index: int, rule: Rule, program: Program, headers: list[str]):
        self.index, self.rule, self.headers = index, rule, headers
        self.context = f"rule '{rule.name}'"
        self.names: dict[str, str] = {}
        self.steps: list[tuple[str, Column]] = []
        self.used: set[int] = set()
        d = program.defaults
        own = lambda v, default: default if v is None else v
        self.separator = own(rule.separator, d.separator)
        self.defaults = d
        self.own = own

    def resolve(self, name: str) -> values.Value:
        if name in self.names:
            return values.cell(F.col(self.names[name]))
        return values.cell(resolver(self.headers, False, self.context, self.used)(name))

    def value(self, tree) -> values.Value:
        try:
            return values.Compiler(self.resolve, col_call(self.headers, self.context, self.used))(tree)
        except (E.ExpressionError, PatternError) as e:
            raise RuleError(f"{self.context}: {e}") from None

    def keep(self, c: Column) -> str:
        name = f"d{self.index}_{len(self.steps)}"
        self.steps.append((name, c))
        return name

    def derive(self, d: E.Derived) -> None:
        joiner = getattr(self.separator, "text", None)
        joiner = self.separator.source if joiner is None else joiner
        v = self.value(d.tree)
        if not d.is_tuple:
            self.names[d.names[0]] = self.keep(v.joined(joiner))
            return
        if v.items is None:
            found = [v.text] + [F.lit("")] * (len(d.names) - 1)
        else:
            found = [F.coalesce(F.get(v.items, F.lit(i)), F.lit("")) for i in range(len(d.names))]
        made = [self.keep(c) for c in found]
        self.names |= dict(zip(d.names, made))

    def side(self, spec: Columns, what: str) -> Side:
        parts = []
        for name in spec.names:
            i = column_index(self.headers, name)
            if name.strip() in self.names:
                parts.append(self.names[name.strip()])
            elif i is not None:
                self.used.add(i)
                parts.append(f"c{i}")
            else:
                try:
                    tree = E.parse(name)
                except (E.ExpressionError, PatternError):
                    raise RuleError(f"{self.context}: unknown {what} column '{name}'") from None
                if isinstance(tree, E.Name):
                    raise RuleError(f"{self.context}: unknown {what} column '{name}'")
                parts.append(self.keep(self.value(tree).joined(",")))
        return Side(tuple(parts), spec.fallback)

    def plan(self) -> RulePlan:
        r, d = self.rule, self.defaults
        for one in r.derive:
            self.derive(one)
        if r.check is not None:
            try:
                tree = E.parse(r.check)
            except (E.ExpressionError, PatternError) as e:
                raise RuleError(f"{self.context}: invalid `check` expression: {e}") from None
            left, right = Side((self.keep(self.value(tree).joined(",")),)), Side((self.keep(F.lit("true")),))
        else:
            left, right = self.side(r.left, "left"), self.side(r.right, "right")
        compare = "eq" if r.check is not None else r.compare or ("matches" if r.pattern else d.compare)
        if compare in comparisons.REGEX and not r.pattern:
            raise RuleError(f"{self.context}: compare = {compare} requires a `pattern`")
        if r.pattern and not r.right.names and compare not in comparisons.REGEX:
            raise RuleError(f"{self.context}: `pattern` with a non-regex comparison needs a `right` column")
        if r.mapping_filter is not None and not (r.auto or r.sources):
            raise RuleError(f"{self.context}: `mapping_filter` requires `mapping = auto` or `mapping_files`")
        sources = [SourcePlan(s, self.side(s.key, "mapping key"), s.separator or d.mapping_separator, s.filter or r.mapping_filter) for s in r.sources]
        trimmed = self.own(r.trim, d.trim)
        cell = resolver(self.headers, trimmed, self.context, self.used)
        for p in (r.skip, r.mapping_filter if r.auto else None):
            if p is not None:
                compile_predicate(p, cell)
        return RulePlan(
            self.index, r.name, r.check if r.check is not None else str(r.left), "true" if r.check is not None else str(r.right) if r.right.names else "(pattern)", left, right, r, compare,
            self.own(r.multi, d.multi), self.separator, self.own(r.join_separator, d.join_separator), trimmed, self.own(r.allow_empty, d.allow_empty), self.own(r.report_limit, d.report_limit),
            r.pattern, r.auto, sources, len(r.right.names) > 1 and not r.right.fallback, self.steps, self.used,
        )


def compile_program(program: Program, headers: list[str]) -> Plan:
    rules = [_RuleCompiler(i, r, program, headers).plan() for i, r in enumerate(program.rules)]
    return Plan(rules, program.defaults.left_label, program.defaults.right_label, headers)
