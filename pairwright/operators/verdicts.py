"""Verdicts: one row for each row of the table and each rule. Everything that is reported comes from them.

All rules are evaluated in one pass over the table: their sides are columns of one projection, their mappings
left joins on it, their verdicts one array that is exploded once.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions import comparisons
from pairwright.functions.patterns import tokens
from pairwright.functions.predicates import compile_predicate
from pairwright.operators import mapping
from pairwright.plans.compiled import Plan, RulePlan, compile_program, resolver
from pairwright.plans.rules import Program
from pairwright.sources.tables import WEIGHT, Table

PASSED, FAILED, SKIPPED, VALIDATION_SKIPPED = "passed", "failed", "skipped", "validation_skipped"
UNMAPPED = "\0"


class Evaluation:
    """A program on a table. Frames are planned when they are asked for."""

    def __init__(self, table: Table, plan: Plan, program: Program, references: mapping.References, row_filter: Column | None, cells: bool):
        self.table, self.plan, self.program, self.references, self.row_filter, self.cells = table, plan, program, references, row_filter, cells

    @cached_property
    def prepared(self) -> DataFrame:
        return prepare(self.table, self.plan, self.row_filter)

    @cached_property
    def relations(self) -> dict[tuple[int, int], mapping.Relation]:
        return mapping.relations(self.prepared, self.plan, self.references)

    @cached_property
    def wide(self) -> DataFrame:
        """A row for each row of the table, with what its keys stand with."""
        df = self.prepared
        for p in self.plan.rules:
            if p.pattern:
                continue
            if p.auto:
                df = mapping.look_up(df, f"l{p.index}", p.multi, p.separator, self.relations[p.index, 0], f"e{p.index}_0")
            for k, _ in enumerate(p.sources):
                df = mapping.look_up(df, f"k{p.index}_{k}", p.multi, p.separator, self.relations[p.index, k], f"e{p.index}_{k}")
        return df

    @cached_property
    def verdicts(self) -> DataFrame:
        """_row, _id, rule, left, right, expected, outcome, transform_error, unmapped, ambiguous (array of token,
        expected) and, if asked for, cells: a row for each row of the table and each rule."""
        each = F.explode(F.array(*[_verdict(p) for p in self.plan.rules])).alias("v")
        kept = [F.array(*[F.col(f"c{i}") for i in range(len(self.table.headers))]).alias("cells")] if self.cells else []
        return self.wide.select("_row", "_id", *kept, each).select("_row", "_id", *(["cells"] if self.cells else []), "v.*")


#: Rows for each different row of cells from which on a table is worth compacting.
REPEATS = 4


def compacted(table: Table, plan: Plan, row_filter: Column | None = None) -> Table:
    """The table with one row, and how many it stands for, for all rows that are alike in the cells that rules
    read; as it is if there are not enough of them. The number of different ones is estimated in one pass."""
    used = [f"c{i}" for i in sorted(set().union(*[p.cells for p in plan.rules]))]
    df = table.df if row_filter is None else table.df.where(row_filter)
    if used:
        found = df.agg(F.count("*").alias("rows"), F.approx_count_distinct(F.xxhash64(*used)).alias("different")).first()
        if found["different"] * REPEATS > found["rows"]:
            return Table(df, table.headers)
    alike = df.groupBy(*used).agg(F.count("*").alias(WEIGHT))
    return Table(alike.select(*used, WEIGHT, F.lit(0).cast("long").alias("_row"), F.lit("").alias("_id")), table.headers)


def prepare(table: Table, plan: Plan, row_filter: Column | None = None) -> DataFrame:
    """The table's rows that the filter keeps, with each rule's derived values, sides and skip flag."""
    df = table.df if row_filter is None else table.df.where(row_filter)
    for p in plan.rules:
        for name, c in p.derived:
            df = df.withColumn(name, c)
    made: dict[str, Column] = {}
    for p in plan.rules:
        r = p.rule
        i = p.index
        made[f"l{i}"], made[f"lok{i}"] = p.left.compose(r.transform_left, p.join, p.trim)
        made[f"r{i}"], made[f"rok{i}"] = p.right.compose(r.transform_right, p.join, p.trim)
        made[f"skip{i}"] = F.lit(False) if r.skip is None else compile_predicate(r.skip, resolver(plan.headers, p.trim, p.name))
        for k, s in enumerate(p.sources):
            made[f"k{i}_{k}"], made[f"kok{i}_{k}"] = s.key.compose(r.transform_left, p.join, p.trim)
    return df.withColumns(made)


def evaluate(table: Table, program: Program, references: mapping.References | None = None, row_filter: Column | None = None, cells: bool = False) -> Evaluation:
    """A program on a table, compiled against its headers."""
    plan = compile_program(program, table.headers)
    return Evaluation(table, plan, program, references or mapping.References(table.df.sparkSession), row_filter, cells)


def _verdict(p: RulePlan) -> Column:
    return F.struct(*[c.alias(n) for n, c in told(p).items()])


def told(p: RulePlan) -> dict[str, Column]:
    """What a rule says of a row, by name."""
    i = p.index
    left, right, skip = F.col(f"l{i}"), F.col(f"r{i}"), F.col(f"skip{i}")
    left_ok, right_ok = F.col(f"lok{i}"), F.col(f"rok{i}")
    none = F.lit(None).cast("string")
    actual = comparisons.token_set(tokens(right, p.multi, p.separator))
    unmapped, ambiguous = F.lit(0), F.array().cast("array<struct<token:string,expected:string>>")
    first = F.col(f"k{i}_0") if p.sources and not p.pattern else left
    shown = left
    if p.pattern:
        hit = p.pattern.found(left)
        matched = left_ok & (~hit if p.compare == "not_matches" else hit)
        expected = F.lit(p.pattern.source)
    elif not p.multi and not any(mapping.is_multi_target(p, s) for s in p.sources):
        # One token on either side: sets of one are in any relation but "differ" if they are equal.
        expected, want = none, left
        if p.mapped:
            hit = F.col(f"e{i}_0")
            if p.sources:
                hit, shown, left_ok = _chosen(p)
            want = F.coalesce(hit["canonical"], F.concat(F.lit(UNMAPPED), shown))
            expected = F.coalesce(hit["canonical"], F.concat(F.lit("<unmapped:"), shown, F.lit(">")))
            unmapped = hit.isNull().cast("int")
            ambiguous = F.when(hit["ambiguous"], F.array(F.struct(shown.alias("token"), hit["canonical"].alias("expected")))).otherwise(ambiguous)
        matched = left_ok & right_ok & ((want != right) if p.compare == "ne" else (want == right))
    elif not p.mapped:
        matched = left_ok & right_ok & comparisons.compare(p.compare, comparisons.token_set(tokens(left, p.multi, p.separator)), actual)
        expected = none
    else:
        entries, several = _entries(p, 0), None
        if p.sources:
            entries, shown, key_ok, several = _decided(p)
            left_ok = key_ok
        missing = F.filter(entries, lambda e: e["hit"].isNull())
        unmapped = F.size(missing)
        lost = F.transform(missing, lambda e: F.concat(F.lit(UNMAPPED), e["token"]))
        one = F.transform(entries, lambda e: F.coalesce(e["hit"]["canonical"], F.concat(F.lit(UNMAPPED), e["token"])))
        targets = lambda e: F.transform(e["hit"]["targets"], lambda t: t["target"])
        every = F.flatten(F.transform(F.filter(entries, lambda e: e["hit"].isNotNull()), targets))
        single = comparisons.token_set(one)
        plain = left_ok & right_ok & comparisons.compare(p.compare, single, actual)
        expected_set = single
        matched = plain
        if several is not None:
            allowed = left_ok & right_ok & (unmapped == 0)
            hits = F.filter(every, lambda t: comparisons.compare("eq" if p.compare == "ne" else p.compare, F.array(t), actual))
            any_hit = F.size(hits) > 0
            multi = allowed & (~any_hit if p.compare == "ne" else any_hit)
            pooled = comparisons.token_set(F.concat(every, lost))
            shown_multi = pooled if p.compare == "ne" else F.when(multi, F.slice(hits, 1, 1)).otherwise(pooled)
            matched = F.when(several, multi).otherwise(plain)
            expected_set = F.when(several, shown_multi).otherwise(single)
        told = F.transform(expected_set, lambda t: F.when(t.startswith(UNMAPPED), F.concat(F.lit("<unmapped:"), F.substr(t, F.lit(2)), F.lit(">"))).otherwise(t))
        expected = F.array_join(told, ", ")
        ambiguous = F.transform(F.filter(entries, lambda e: F.coalesce(e["hit"]["ambiguous"], F.lit(False))), lambda e: F.struct(e["token"].alias("token"), e["hit"]["canonical"].alias("expected")))
    ok = left_ok & right_ok
    optional = F.lit(False)
    if p.allow_empty:
        optional = (first == "") if p.pattern else (first == "") & (right == "")
    outcome = F.when(skip, VALIDATION_SKIPPED).when(optional, SKIPPED).when(matched, PASSED).otherwise(FAILED)
    tested = ~skip & ~optional
    return {
        "rule": F.lit(i),
        "left": F.when(skip, left).when(optional, first).otherwise(shown),
        "right": right,
        "expected": F.when(tested, expected),
        "outcome": outcome,
        "transform_error": tested & ~ok,
        "unmapped": F.when(tested, unmapped).otherwise(0).cast("long"),
        "ambiguous": F.when(tested, ambiguous).otherwise(F.array().cast("array<struct<token:string,expected:string>>")),
    }


def _entries(p: RulePlan, k: int) -> Column:
    """The tokens of source k's key with their hits."""
    found = F.col(f"e{p.index}_{k}")
    if p.multi:
        return found
    key = F.col(f"k{p.index}_{k}") if p.sources else F.col(f"l{p.index}")
    return F.array(F.struct(key.alias("token"), found.alias("hit")))


def _chosen(p: RulePlan) -> tuple[Column, Column, Column]:
    """For keys of one token: hit and key of the source that decides, and whether the keys looked at on the way
    were transformed."""
    i, last = p.index, len(p.sources) - 1
    looked = [F.col(f"kok{i}_0")]
    for k in range(1, last + 1):
        looked.append(looked[-1] & F.col(f"kok{i}_{k}"))
    hit, key, ok = F.col(f"e{i}_{last}"), F.col(f"k{i}_{last}"), looked[last]
    for k in range(last - 1, -1, -1):
        mine = F.col(f"e{i}_{k}")
        on = {"unmapped": mine.isNull(), "ambiguous": F.coalesce(mine["ambiguous"], F.lit(True)), "always": F.lit(True)}[p.sources[k].source.when]
        hit, key, ok = F.when(on, hit).otherwise(mine), F.when(on, key).otherwise(F.col(f"k{i}_{k}")), F.when(on, ok).otherwise(looked[k])
    return hit, key, ok


def _decided(p: RulePlan) -> tuple[Column, Column, Column, Column | None]:
    """Of the sources in order, the one that decides: its entries and key, whether the keys looked at on the
    way were transformed, and whether it takes any of several targets."""
    i, last = p.index, len(p.sources) - 1
    entries, key, several = _entries(p, last), F.col(f"k{i}_{last}"), F.lit(mapping.is_multi_target(p, p.sources[last]))
    ok = F.lit(True)
    for k, _ in enumerate(p.sources):
        ok = ok & F.col(f"kok{i}_{k}")
    for k in range(last - 1, -1, -1):
        e = _entries(p, k)
        missed = F.forall(e, lambda x: x["hit"].isNull())
        unsure = F.exists(e, lambda x: F.coalesce(x["hit"]["ambiguous"], F.lit(False)))
        on = {"unmapped": missed, "ambiguous": missed | unsure, "always": F.lit(True)}[p.sources[k].source.when]
        looked = F.lit(True)
        for j in range(k + 1):
            looked = looked & F.col(f"kok{i}_{j}")
        entries, key = F.when(on, entries).otherwise(e), F.when(on, key).otherwise(F.col(f"k{i}_{k}"))
        several = F.when(on, several).otherwise(F.lit(mapping.is_multi_target(p, p.sources[k])))
        ok = F.when(on, ok).otherwise(looked)
    if not any(mapping.is_multi_target(p, s) for s in p.sources):
        return entries, key, ok, None
    return entries, key, ok, several
