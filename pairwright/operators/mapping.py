"""Mappings: how often each left token stands with each right token, learned from the table or loaded from
reference tables, and the look-up of a row's tokens in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.functions.patterns import tokens
from pairwright.functions.predicates import compile_predicate
from pairwright.plans.compiled import Plan, RulePlan, Side, SourcePlan, resolver
from pairwright.plans.rules import RuleError
from pairwright.sources.tables import WEIGHT, column_index, read_csv



def counts_of(pairs: DataFrame) -> DataFrame:
    """token, target, n of pairs (token, target), or of as many as each stands for (_n)."""
    n = F.sum(WEIGHT) if WEIGHT in pairs.columns else F.count("*")
    return pairs.groupBy("token", "target").agg(n.alias("n"))


class Relation:
    """What tokens stand with. counts: token, target, n."""

    def __init__(self, counts: DataFrame, multi_target: bool = False):
        self.counts, self.multi_target = counts, multi_target

    def best(self) -> DataFrame:
        """token, targets (how many), rows (of all), canonical: the most frequent target, of several the first by
        text; and ambiguous: whether there are several though one is wanted. One row a token, whatever its targets."""
        first = F.min_by("target", F.struct(-F.col("n"), "target")).alias("canonical")
        rows = self.counts.groupBy("token").agg(first, F.count("*").alias("targets"), F.sum("n").alias("rows"))
        return rows.withColumn("ambiguous", (F.col("targets") > 1) & F.lit(not self.multi_target))

    def hits(self) -> DataFrame:
        """token, hit: what a look-up needs of it. All its targets go along only where any of them will do."""
        hit = [F.col("canonical"), F.col("ambiguous")]
        if not self.multi_target:
            return self.best().select("token", F.struct(*hit, F.array().cast("array<struct<target:string>>").alias("targets")).alias("hit"))
        ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "target")))
        rows = self.counts.groupBy("token").agg(ranked.alias("r"))
        named = F.transform("r", lambda x: F.struct(x["target"].alias("target")))
        return rows.select("token", F.struct(F.col("r")[0]["target"].alias("canonical"), F.lit(False).alias("ambiguous"), named.alias("targets")).alias("hit"))

    def targets(self, tokens_: DataFrame, limit: int | None = None) -> DataFrame:
        """token, targets (array of target, n; the most frequent first, then by text) of these tokens (one column,
        token): all of them, or the first ``limit``, of which no task gets more for each of its inputs."""
        rows = self.counts.join(tokens_, "token", "left_semi")
        if limit is not None:
            order = Window.partitionBy("token").orderBy(F.desc("n"), "target")
            rows = rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= limit)
        ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "target")))
        named = lambda x: F.struct(x["target"].alias("target"), (-x["m"]).alias("n"))
        return rows.groupBy("token").agg(ranked.alias("r")).select("token", F.transform("r", named).alias("targets"))


def pair_tokens(left: Column, right: Column) -> Column:
    """Pairs of tokens at equal places, up to the shorter list."""
    n = F.least(F.size(left), F.size(right))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(left, i).alias("token"), F.element_at(right, i).alias("target")))


def auto_counts(prepared: DataFrame, p: RulePlan, headers: list[str]) -> DataFrame:
    """Learned pairs: of rows that validation doesn't skip and that the mapping filter keeps."""
    rows = prepared.where(~F.col(f"skip{p.index}"))
    if p.rule.mapping_filter is not None:
        rows = rows.where(compile_predicate(p.rule.mapping_filter, resolver(headers, p.trim, p.name)))
    left, right = F.col(f"l{p.index}"), F.col(f"r{p.index}")
    n = [WEIGHT] if WEIGHT in rows.columns else []
    if not p.multi:
        return counts_of(rows.select(left.alias("token"), right.alias("target"), *n))
    rows = rows.select(tokens(left, True, p.separator).alias("a"), tokens(right, True, p.separator).alias("b"), *n).where((F.size("a") > 0) & (F.size("b") > 0))
    return counts_of(rows.select(F.explode(pair_tokens(F.col("a"), F.col("b"))).alias("x"), *n).select("x.token", "x.target", *n))


class References:
    """Reference tables by name or path (from a folder, if one is given), each read once."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, sep: str = ",", folder: str = ""):
        self.spark, self.sep, self.given, self.folder = spark, sep, dict(tables or {}), folder
        self.read: dict[str, tuple[DataFrame, list[str]]] = {}

    def __getitem__(self, name: str) -> tuple[DataFrame, list[str]]:
        if name not in self.read:
            if name in self.given:
                df = self.given[name]
                cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(df.columns)]
                self.read[name] = df.select(*cells), df.columns
            else:
                self.read[name] = read_csv(self.spark, f"{self.folder}/{name}" if self.folder and "/" != name[:1] and "://" not in name else name, self.sep)
        return self.read[name]


def is_multi_target(p: RulePlan, s: SourcePlan) -> bool:
    return len(s.source.right) > 1 and not p.right_composite


def file_counts(references: References, p: RulePlan, s: SourcePlan) -> DataFrame:
    """Loaded pairs, of all files of the source."""
    parts = []
    for name in s.source.files:
        df, headers = references[name]

        def place(column: str) -> str:
            i = column_index(headers, column)
            if i is None:
                raise RuleError(f"mapping file {name}: unknown column '{column}'")
            return f"c{i}"

        if s.filter is not None:
            df = df.where(compile_predicate(s.filter, resolver(headers, p.trim, f"mapping file {name}")))
        left, _ = Side(tuple(map(place, s.source.left))).compose(p.rule.transform_left, p.join, p.trim)
        split = lambda c: tokens(c, s.source.multi, s.separator)
        right = tuple(map(place, s.source.right))
        if is_multi_target(p, s):
            each = [Side((c,)).compose(p.rule.transform_right, p.join, p.trim)[0] for c in right]
            kept = F.filter(F.array(*each), lambda t: F.regexp_replace(t, r"(?U)\s+", "") != "")
            df = df.select(F.explode(split(left)).alias("token"), F.flatten(F.transform(kept, split)).alias("b"))
            parts.append(df.select("token", F.explode("b").alias("target")))
        elif not s.source.multi:
            whole, _ = Side(right).compose(p.rule.transform_right, p.join, p.trim)
            parts.append(df.select(left.alias("token"), whole.alias("target")))
        else:
            whole, _ = Side(right).compose(p.rule.transform_right, p.join, p.trim)
            df = df.select(split(left).alias("a"), split(whole).alias("b")).where((F.size("a") > 0) & (F.size("b") > 0))
            parts.append(df.select(F.explode(pair_tokens(F.col("a"), F.col("b"))).alias("x")).select("x.token", "x.target"))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return counts_of(out)


def look_up(df: DataFrame, key: str, multi: bool, separator, found: Relation, name: str) -> DataFrame:
    """df with a column of that name: if the key is one token, its hit (or null); if it is split, for each of its
    tokens, in order, the token and its hit.

    A single token is looked up by a left join, which Spark broadcasts or shuffles by the relation's size.
    Several are looked up once for each different key, and joined to the rows by the key.
    """
    hits = found.hits()
    if not multi:
        right = hits.select(F.col("token").alias("_t"), F.col("hit").alias(name))
        return df.join(right, F.col(key) == F.col("_t"), "left").drop("_t")
    keys = df.select(F.col(key).alias("_k")).distinct()
    each = keys.select("_k", F.explode(F.array_distinct(tokens(F.col("_k"), True, separator))).alias("token"))
    maps = each.join(hits, "token").groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("token", "hit"))).alias("_m"))
    joined = df.join(maps, F.col(key) == F.col("_k"), "left")
    of = lambda t: F.struct(t.alias("token"), F.try_element_at("_m", t).alias("hit"))
    return joined.withColumn(name, F.transform(tokens(F.col(key), True, separator), of)).drop("_m", "_k")


def relations(prepared: DataFrame, plan: Plan, references: References) -> dict[tuple[int, int], Relation]:
    """(rule, source) to its relation. Sources that load the same share one."""
    out: dict[tuple[int, int], Relation] = {}
    known: dict[str, Relation] = {}
    for p in plan.rules:
        if p.pattern:
            continue
        if p.auto:
            out[p.index, 0] = Relation(auto_counts(prepared, p, plan.headers))
        for k, s in enumerate(p.sources):
            signature = repr((s.source.files, s.source.left, s.source.right, p.rule.transform_left, p.rule.transform_right, s.source.multi, s.separator, p.join, p.trim, s.filter, is_multi_target(p, s)))
            if signature not in known:
                known[signature] = Relation(file_counts(references, p, s), is_multi_target(p, s))
            out[p.index, k] = known[signature]
    return out
