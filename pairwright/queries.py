"""The driver's queries: each operator on the generated tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions import transforms
from pairwright.functions.transforms import Transform
from pairwright.operators import mapping, reports, search, verdicts
from pairwright.plans import rules
from pairwright.plans.compiled import compile_filter
from pairwright.sources import tables
from pairwright.sources.tables import Table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rule(name: str, **keys: str) -> str:
    return f'rule "{name}" {{\n' + "".join(f"  {k} = {v}\n" for k, v in keys.items()) + "}\n"


#: For each table, what numbers its rows.
ROW = {"part": "p_partkey", "orders": "o_orderkey", "customer": "c_custkey", "supplier": "s_suppkey", "nation": "n_nationkey", "events": "event_id", "pages": "page_id", "documents": "doc_id", "lineitem": "l_orderkey"}


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None, id_column: str | None = None) -> Table:
    df = read(spark, sf_dir, name)
    if columns:
        df = df.select(*columns)
    key = ROW[name]
    return tables.from_frame(df, id_column, F.col(key) if key in df.columns else None)


def judged(spark: SparkSession, sf_dir: str, name: str, text: str, columns: list[str], refs: dict[str, DataFrame] | None = None, row_filter: Column | None = None) -> verdicts.Evaluation:
    t = table(spark, sf_dir, name, columns)
    return verdicts.evaluate(t, rules.parse(text), mapping.References(spark, refs), row_filter)


def counted(e: verdicts.Evaluation) -> DataFrame:
    return reports.count(e)


def small_table(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))


COUNTS = "checked, passed, failed, skipped, validation_skipped, transform_errors, unmapped"


def counts_sql(source: str, outcome: str, rule_: int | str = 0, errors: str = "false", unmapped: str = "0", group: bool = False) -> str:
    """SQL of the counters for a source whose rows have their outcome."""
    return f"""
SELECT CAST({rule_} AS INT) AS rule, count(*) AS checked, count(*) FILTER (WHERE o = 'passed') AS passed, count(*) FILTER (WHERE o = 'failed') AS failed,
  count(*) FILTER (WHERE o = 'skipped') AS skipped, count(*) FILTER (WHERE o = 'validation_skipped') AS validation_skipped,
  count(*) FILTER (WHERE e) AS transform_errors, CAST(sum(u) AS BIGINT) AS unmapped
FROM (SELECT {outcome} AS o, {errors} AS e, {unmapped} AS u FROM {source})
"""


PASS = "CASE WHEN {} THEN 'passed' ELSE 'failed' END"

# Learned mappings ---------------------------------------------------------------------------------------

BRAND = rule("brand", left="p_brand", right="p_type", transform_left="lower", mapping="auto")
BRAND_COLUMNS = ["p_partkey", "p_brand", "p_type", "p_size"]
BRAND_COUNTS = "SELECT lower(p_brand) AS token, p_type AS target, count(*) AS n FROM part GROUP BY 1, 2"
BRAND_BEST = f"SELECT token, target, n, row_number() OVER (PARTITION BY token ORDER BY n DESC, target) AS k, count(*) OVER (PARTITION BY token) AS m, sum(n) OVER (PARTITION BY token) AS s FROM ({BRAND_COUNTS})"


@query("auto_mapping_counts", BRAND_COUNTS)
def _(spark, d):
    e = judged(spark, d, "part", BRAND, BRAND_COLUMNS)
    return e.relations[0, 0].counts.select("token", "target", "n")


@query("auto_mapping_canonical", f"SELECT token, target AS canonical, m > 1 AS ambiguous, CAST(m AS INT) AS targets FROM ({BRAND_BEST}) WHERE k = 1")
def _(spark, d):
    r = judged(spark, d, "part", BRAND, BRAND_COLUMNS).relations[0, 0]
    return r.best().select("token", "canonical", "ambiguous", F.col("targets").cast("int").alias("targets"))


@query("auto_mapping_ambiguous", f"SELECT token AS input, CAST(m AS INT) AS targets FROM ({BRAND_BEST}) WHERE k = 1 AND m > 1 ORDER BY m DESC, s DESC, token LIMIT 10")
def _(spark, d):
    r = judged(spark, d, "part", BRAND, BRAND_COLUMNS).relations[0, 0]
    return reports.ambiguities(r, 10).select("input", F.col("n_targets").cast("int").alias("targets"))


@query("auto_rule_counters", counts_sql(f"part JOIN (SELECT token, target FROM ({BRAND_BEST}) WHERE k = 1) ON token = lower(p_brand)", PASS.format("p_type = target")))
def _(spark, d):
    return counted(judged(spark, d, "part", BRAND, BRAND_COLUMNS))


FILTERED = "SELECT token, target FROM (SELECT lower(p_brand) AS token, p_type AS target, row_number() OVER (PARTITION BY lower(p_brand) ORDER BY count(*) DESC, p_type) AS k FROM part WHERE p_size IN (1, 2) GROUP BY 1, 2) WHERE k = 1"


@query("auto_rule_filtered", counts_sql(f"part LEFT JOIN ({FILTERED}) ON token = lower(p_brand)", PASS.format("p_type IS NOT DISTINCT FROM target"), unmapped="CASE WHEN target IS NULL THEN 1 ELSE 0 END"))
def _(spark, d):
    text = rule("brand", left="p_brand", right="p_type", transform_left="lower", mapping="auto", mapping_filter="in(p_size, [1, 2])")
    return counted(judged(spark, d, "part", text, BRAND_COLUMNS))


# Loaded mappings ----------------------------------------------------------------------------------------


@query("file_mapping_nation", counts_sql("customer LEFT JOIN nation ON n_nationkey = c_nationkey", PASS.format("'NATION_' || c_nationkey = n_name"), unmapped="CASE WHEN n_name IS NULL THEN 1 ELSE 0 END"))
def _(spark, d):
    text = rule("nation", left="c_nationkey", derive="'\"NATION_\" ++ c_nationkey as named'", right="named", mapping_files="[nation]", mapping_left="n_nationkey", mapping_right="n_name")
    return counted(judged(spark, d, "customer", text, ["c_custkey", "c_nationkey"], {"nation": read(spark, d, "nation")}))


FLAGS = [("A", "F", "x"), ("N", "O", "y"), ("R", "F", "z")]


@query("file_mapping_composite", counts_sql("lineitem", PASS.format("CASE concat(l_returnflag, '|', l_linestatus) WHEN 'A|F' THEN 'x' WHEN 'N|O' THEN 'y' WHEN 'R|F' THEN 'z' END = CASE WHEN l_linenumber > 3 THEN 'x' ELSE 'z' END"), unmapped="CASE WHEN concat(l_returnflag, '|', l_linestatus) IN ('A|F', 'N|O', 'R|F') THEN 0 ELSE 1 END"))
def _(spark, d):
    text = rule("flags", derive="'if(l_linenumber > 3, \"x\", \"z\") as want'", left="[l_returnflag, l_linestatus]", right="want", mapping_files="[flags]", mapping_left="[flag, status]", mapping_right="code")
    return counted(judged(spark, d, "lineitem", text, ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"], {"flags": small_table(spark, "flag status code", FLAGS)}))


@query("file_mapping_union", "SELECT * FROM (VALUES ('A', 'F', CAST(2 AS BIGINT)), ('R', 'F', 1), ('R', 'O', 1), ('N', 'O', 1)) AS t(token, target, n)")
def _(spark, d):
    refs = {"one": small_table(spark, "flag status", [("A", "F"), ("R", "F")]), "two": small_table(spark, "status flag", [("F", "A"), ("O", "R"), ("O", "N")])}
    text = rule("flags", left="l_returnflag", right="l_linestatus", mapping_files="[one, two]", mapping_left="flag", mapping_right="status")
    e = judged(spark, d, "lineitem", text, ["l_orderkey", "l_returnflag", "l_linestatus"], refs)
    return e.relations[0, 0].counts.select("token", "target", "n")


@query("shared_reference", counts_sql("orders", PASS.format("CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' END IS NOT DISTINCT FROM 'open'"), unmapped="CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END"))
def _(spark, d):
    text = rule("status", left="o_orderstatus", derive="'\"open\" as want'", right="want", mapping_files="[status]", mapping_left="s", mapping_right="t", mapping_filter='not(empty(s))')
    return counted(judged(spark, d, "orders", text, ["o_orderkey", "o_orderstatus"], {"status": small_table(spark, "s t", [("O", "open"), ("F", "done"), ("", "none")])}))


def _fallback(when: str) -> str:
    return f"""rule "f" {{
  derive = 'if(o_orderkey % 2 == 0, "a", "b") as want'
  right = want
  mapping {{
    files = [one]
    left = s
    key = o_orderstatus
    right = t
    when = {when}
  }}
  mapping {{
    files = [two]
    left = s
    key = o_orderpriority
    right = t
  }}
}}
"""


PRIORITY = "CASE o_orderpriority WHEN '1-URGENT' THEN 'a' WHEN '2-HIGH' THEN 'b' WHEN '5-LOW' THEN 'b' END"
FIRST = "CASE o_orderstatus WHEN 'O' THEN 'a' WHEN 'F' THEN 'a' END"


def _fallback_sql(target: str) -> str:
    return counts_sql(f"(SELECT *, {target} AS target FROM orders)", PASS.format("target IS NOT DISTINCT FROM CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END"), unmapped="CASE WHEN target IS NULL THEN 1 ELSE 0 END")


for _when, _target in {"unmapped": f"CASE WHEN o_orderstatus IN ('O', 'F') THEN {FIRST} ELSE {PRIORITY} END", "ambiguous": f"CASE WHEN o_orderstatus = 'O' THEN 'a' ELSE {PRIORITY} END", "always": PRIORITY}.items():

    @query(f"fallback_{_when}", _fallback_sql(_target))
    def _(spark, d, when=_when):
        refs = {"one": small_table(spark, "s t", [("O", "a"), ("F", "a"), ("F", "b")]), "two": small_table(spark, "s t", [("1-URGENT", "a"), ("2-HIGH", "b"), ("5-LOW", "b")])}
        # The first source decides by its `when` whether the next is asked.
        return counted(judged(spark, d, "orders", _fallback(when), ["o_orderkey", "o_orderstatus", "o_orderpriority"], refs))


SEGMENTS = [("FURNITURE", "0", "1"), ("HOUSEHOLD", "2", "3"), ("BUILDING", "4", "5")]
SEGMENT_IN = "CASE c_mktsegment WHEN 'FURNITURE' THEN c_nationkey IN (0, 1) WHEN 'HOUSEHOLD' THEN c_nationkey IN (2, 3) WHEN 'BUILDING' THEN c_nationkey IN (4, 5) END"

for _name, _op, _test in (("any", "eq", f"coalesce({SEGMENT_IN}, false)"), ("ne", "ne", f"coalesce(NOT {SEGMENT_IN}, false)")):

    @query(f"multi_target_{_name}", counts_sql("customer", PASS.format(_test), unmapped="CASE WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD', 'BUILDING') THEN 0 ELSE 1 END"))
    def _(spark, d, op=_op):
        text = rule("segment", left="c_mktsegment", right="c_nationkey", compare=op, mapping_files="[seg]", mapping_left="s", mapping_right="[x, y]")
        return counted(judged(spark, d, "customer", text, ["c_custkey", "c_mktsegment", "c_nationkey"], {"seg": small_table(spark, "s x y", SEGMENTS)}))


# Comparisons --------------------------------------------------------------------------------------------

WORDS = "list_sort(list_distinct(string_split({}, ' ')))"
A, B = WORDS.format("p_name"), WORDS.format("CASE WHEN p_size > 25 THEN p_name || ' ring' WHEN p_size > 12 THEN split_part(p_name, ' ', 1) ELSE 'small bolt' END")
TESTS = {"eq": f"{A} = {B}", "ne": f"{A} <> {B}", "subset": f"list_has_all({B}, {A})", "superset": f"list_has_all({A}, {B})", "intersect": f"list_has_any({A}, {B})"}

for _op, _test in TESTS.items():

    @query(f"compare_{_op}", counts_sql("part", PASS.format(_test)))
    def _(spark, d, op=_op):
        other = "'if(p_size > 25, p_name ++ \" ring\", if(p_size > 12, first(split(p_name, \" \")), \"small bolt\")) as other'"
        text = rule("words", derive=other, left="p_name", right="other", multi="true", separator='" "', compare=op)
        return counted(judged(spark, d, "part", text, ["p_partkey", "p_name", "p_size"]))


for _op, _test in (("matches", "regexp_matches(c_name, '[13579]$')"), ("not_matches", "NOT regexp_matches(c_name, '[13579]$')")):

    @query(f"pattern_{_op}", counts_sql("customer", PASS.format(_test)))
    def _(spark, d, op=_op):
        text = rule("name", left="c_name", pattern='"[13579]$"', compare=op)
        return counted(judged(spark, d, "customer", text, ["c_custkey", "c_name"]))


@query("pattern_url", counts_sql("pages", PASS.format("regexp_matches(url, '^https://[a-z.]+/(en|fr)/[0-9]+$')")))
def _(spark, d):
    return counted(judged(spark, d, "pages", rule("url", left="url", pattern='"^https://[[:lower:].]+/(?:en|fr)/[[:digit:]]+$"'), ["page_id", "url"]))


# Tokens of mappings -------------------------------------------------------------------------------------


@query("token_pairs", "SELECT token, target, count(*) AS n FROM (SELECT split_part(p_name, ' ', 1) AS token, split_part(p_name, ' ', 2) AS target FROM part UNION ALL SELECT split_part(p_name, ' ', 2), split_part(p_name, ' ', 1) FROM part) GROUP BY 1, 2")
def _(spark, d):
    text = rule("pairs", derive="'split(p_name, \" \") as (a, b), b ++ \" \" ++ a as other'", left="p_name", right="other", multi="true", separator='" "', mapping="auto")
    return judged(spark, d, "part", text, ["p_partkey", "p_name"]).relations[0, 0].counts


TOKENS = [("A;R", "F", "x;y"), ("N", "O", ""), ("A", "F", "F")]


@query("token_products", "SELECT * FROM (VALUES ('A', 'F', CAST(3 AS BIGINT)), ('A', 'x', 1), ('A', 'y', 1), ('R', 'F', 1), ('R', 'x', 1), ('R', 'y', 1), ('N', 'O', 1)) AS t(token, target, n)")
def _(spark, d):
    text = rule("products", left="l_returnflag", right="l_linestatus", mapping_files="[ref]", mapping_left="k", mapping_right="[v, w]", mapping_multi="true", mapping_separator='";"')
    e = judged(spark, d, "lineitem", text, ["l_orderkey", "l_returnflag", "l_linestatus"], {"ref": small_table(spark, "k v w", TOKENS)})
    return e.relations[0, 0].counts


@query("composite_right", counts_sql("lineitem", PASS.format("l_returnflag || l_linestatus || l_linenumber IN ('AF1', 'NO2', 'RF1')")))
def _(spark, d):
    refs = {"ref": small_table(spark, "flag status number", [("A", "F", "1"), ("N", "O", "2"), ("R", "F", "1")])}
    text = rule("both", left="l_returnflag", right="[l_linestatus, l_linenumber]", mapping_files="[ref]", mapping_left="flag", mapping_right="[status, number]")
    return counted(judged(spark, d, "lineitem", text, ["l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber"], refs))


@query(
    "report_totals",
    f"SELECT CAST(4 AS INT) AS rules_total, CAST(1 AS INT) AS rules_passed, CAST(3 AS INT) AS rules_failed, count(*) AS rows_checked, (SELECT count(*) FROM ({BRAND_BEST}) WHERE k = 1) AS inputs, (SELECT count(*) FROM ({BRAND_BEST}) WHERE k = 1 AND m > 1) AS ambiguous FROM part",
)
def _(spark, d):
    r = reports.report(judged(spark, d, "part", SUMMARY, [*BRAND_COLUMNS, "p_name"]))
    m = r["rules"][0]["mapping"]
    row = (r["rules_total"], r["rules_passed"], r["rules_failed"], r["rows_checked"], m["distinct_inputs"], m["ambiguous_inputs"])
    return spark.createDataFrame([row], "rules_total int, rules_passed int, rules_failed int, rows_checked long, inputs long, ambiguous long")


# Predicates ---------------------------------------------------------------------------------------------

P, S = "o_orderpriority", "o_orderstatus"
PREDICATES = {
    "in": (f'in({P}, ["1-URGENT", "2-HIGH"])', f"{P} IN ('1-URGENT', '2-HIGH')"),
    "not_in": (f'not_in({P}, ["1-URGENT", "2-HIGH"])', f"{P} NOT IN ('1-URGENT', '2-HIGH')"),
    "any_in": (f'any_in([{P}, {S}], ["5-LOW", "F"])', f"{P} IN ('5-LOW', 'F') OR {S} IN ('5-LOW', 'F')"),
    "all_in": (f'all_in([{P}, {S}], ["5-LOW", "F"])', f"{P} IN ('5-LOW', 'F') AND {S} IN ('5-LOW', 'F')"),
    "eq": (f'eq({S}, "P")', f"{S} = 'P'"),
    "ne": (f'ne({S}, "P")', f"{S} <> 'P'"),
    "empty": (f"empty({S})", "false"),
    "constants": (f'or(never, and(always, eq({S}, "O")))', f"{S} = 'O'"),
    "not_empty": (f"not_empty(or({S}, {P}))", "true"),
    "bool": (f'or(and(eq({S}, "F"), not(in({P}, ["5-LOW"]))), [eq({S}, "P"), never])', f"({S} = 'F' AND {P} <> '5-LOW') OR {S} = 'P'"),
}

for _name, (_text, _test) in PREDICATES.items():

    @query(f"pred_{_name}", counts_sql("orders", f"CASE WHEN {_test} THEN 'validation_skipped' ELSE 'passed' END"))
    def _(spark, d, text=_text):
        return counted(judged(spark, d, "orders", rule("p", left=S, right=S, validation_skipped=text), ["o_orderkey", S, P]))


@query("validation_skipped", "SELECT CASE WHEN l_returnflag = 'N' THEN 'validation_skipped' WHEN l_linestatus = 'F' THEN 'passed' ELSE 'failed' END AS outcome, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    text = rule("skip", left="l_linestatus", pattern='"^F$"', skip='eq(l_returnflag, "N")')
    return judged(spark, d, "lineitem", text, ["l_orderkey", "l_linestatus", "l_returnflag"]).verdicts.groupBy("outcome").agg(F.count("*").alias("n"))


@query("allow_empty", "SELECT CASE WHEN quality IS NULL THEN 'skipped' WHEN quality = toxic THEN 'passed' ELSE 'failed' END AS outcome, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def _(spark, d):
    df = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left")
    t = tables.from_frame(df.select("doc_id", "quality", "toxic"), "doc_id", F.col("doc_id"))
    text = rule("labels", left="quality", right="toxic", optional="true")
    return verdicts.evaluate(t, rules.parse(text)).verdicts.groupBy("outcome").agg(F.count("*").alias("n"))


# Transforms ---------------------------------------------------------------------------------------------

SHIP = "strftime(o_orderdate, '%d/%m/%Y')"
TRANSFORMS = {
    "lower": ("part", "p_type", "p_type", 'lower', "lower(p_type)"),
    "upper": ("part", "p_name", "p_name", "upper", "upper(p_name)"),
    "trim": ("part", "concat('  ', p_name, chr(9))", "concat('  ', p_name, chr(9))", "trim", "p_name"),
    "collapse": ("part", "replace(p_name, ' ', '  ')", "replace(p_name, ' ', '  ')", "collapse", "p_name"),
    "date": ("orders", "date_format(o_orderdate, 'dd/MM/yyyy')", SHIP, 'date(["%Y-%m-%d", "%d/%m/%Y"], "%Y%m%d")', "strftime(o_orderdate, '%Y%m%d')"),
    "int": ("part", "concat(' +0', p_size)", "' +0' || p_size", "int", "CAST(p_size AS VARCHAR)"),
    "float": ("part", "concat(p_size, '.50')", "p_size || '.50'", "float", "p_size || '.5'"),
    "bool": ("part", "if(p_size > 25, 'YES', 'non')", "CASE WHEN p_size > 25 THEN 'YES' ELSE 'non' END", "bool", "CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END"),
    "replace": ("part", "p_brand", "p_brand", 'replace("Brand#", "B")', "replace(p_brand, 'Brand#', 'B')"),
    "regex_replace": ("part", "p_name", "p_name", 'replace(regex("(\\\\w+) (\\\\w+)"), "$2/$1")', "regexp_replace(p_name, '(\\w+) (\\w+)', '\\2/\\1', 'g')"),
    "match": ("events", "props", "props", 'match(regex("([0-9]+)"), 1)', "regexp_extract(props, '([0-9]+)', 1)"),
    "match_failed": ("part", "p_brand", "p_brand", 'match(regex("1\\\\d$"))', "CASE WHEN regexp_matches(p_brand, '1\\d$') THEN regexp_extract(p_brand, '1\\d$') ELSE p_brand END"),
    "regex_keep": ("events", "props", "props", 'regex_keep("[a-z0-9]")', "regexp_replace(props, '[^a-z0-9]', '', 'g')"),
    "affixes": ("part", "p_type", "p_type", 'prefix("<") | suffix(">") | none', "'<' || p_type || '>'"),
}

for _name, (_table, _spark, _duck, _steps, _want) in TRANSFORMS.items():

    @query(f"transform_{_name}", f"SELECT {_duck} AS before, {_want} AS after, count(*) AS n FROM {_table} GROUP BY 1, 2")
    def _(spark, d, name=_table, c=_spark, steps=_steps):
        run = rules.transforms(rules.parse_value(steps))
        df = read(spark, d, name).select(F.expr(c).alias("before"))
        return df.select("before", transforms.run(F.col("before"), run)[0].alias("after")).groupBy("before", "after").agg(F.count("*").alias("n"))


@query("transform_errors", counts_sql("part", PASS.format("regexp_matches(p_brand, '#1')"), errors="NOT regexp_matches(p_brand, '#1')"))
def _(spark, d):
    text = rule("e", left="p_brand", derive="'\"1\" as one'", right="one", transform_left='match(regex("#(1)"), 1)')
    return counted(judged(spark, d, "part", text, ["p_partkey", "p_brand"]))


# Expressions --------------------------------------------------------------------------------------------

DERIVED = {
    "split_tuple": ("part", ["p_partkey", "p_name"], "split(p_name, \" \") as (a, b), b ++ \"-\" ++ a as out", "split_part(p_name, ' ', 2) || '-' || split_part(p_name, ' ', 1)"),
    "slices": ("part", ["p_partkey", "p_name"], "p_name[1:4] ++ p_name[-2] ++ p_name[:2] ++ first(p_name) ++ last(p_name) as out", "p_name[2:4] || p_name[-2] || p_name[1:2] || p_name[1] || p_name[-1]"),
    "if": ("part", ["p_partkey", "p_size"], "if(p_size >= 40, \"big\", unless(p_size < 10, \"mid\", \"small\")) as out", "CASE WHEN p_size >= 40 THEN 'big' WHEN p_size < 10 THEN 'small' ELSE 'mid' END"),
    "in_any": ("orders", ["o_orderkey", P, S], f"in_any([{P}, {S}], [\"5-LOW\", \"F\"]) as out", f"CASE WHEN {P} IN ('5-LOW', 'F') OR {S} IN ('5-LOW', 'F') THEN 'true' ELSE 'false' END"),
    "arithmetic": ("part", ["p_partkey", "p_size"], "p_size * 2 - 7 // 2 + p_size % 5 as out", "CAST(p_size * 2 - 3 + p_size % 5 AS VARCHAR)"),
    "division": ("part", ["p_partkey", "p_size"], "p_size / 4 as x, coalesce(p_size / 0, \"none\") ++ \" \" ++ x as out", "'none ' || rtrim(rtrim(printf('%.2f', p_size / 4), '0'), '.')"),
    "rounding": ("part", ["p_partkey", "p_size"], "join([round(p_size / 4), floor(p_size / 4), ceil(p_size / 4), abs(3 - p_size), 2 ** 3], \",\") as out", "concat_ws(',', CAST(floor(p_size / 4 + 0.5) AS INT), CAST(floor(p_size / 4) AS INT), CAST(ceil(p_size / 4) AS INT), abs(3 - p_size), 8)"),
    "text": ("part", ["p_partkey", "p_type", "p_brand"], "upper(p_brand) | replace(_, \"BRAND#\", p_type[0]) | concat(_, len(p_type), p_type | lower) as out", "replace(upper(p_brand), 'BRAND#', p_type[1]) || length(p_type) || lower(p_type)"),
    "extremes": ("part", ["p_partkey", "p_size", "p_brand"], "min(p_size, 20, \"7\") ++ \" \" ++ max([p_size, 9]) ++ \" \" ++ max(p_brand, \"Brand#3\") as out", "least(p_size, 7) || ' ' || greatest(p_size, 9) || ' ' || greatest(p_brand, 'Brand#3')"),
    "regex": ("events", ["event_id", "props", "event_type"], "match(props, /k.*?(\\d+)/, 1) ++ (if(contains(event_type, /^(view|click)$/), \" seen\", \"\")) as out", "regexp_extract(props, '(\\d+)', 1) || CASE WHEN event_type IN ('view', 'click') THEN ' seen' ELSE '' END"),
    "logic": ("part", ["p_partkey", "p_size"], "join([p_size > 30 or \"small\", p_size > 30 and \"big\", -p_size], \",\") as out", "CASE WHEN p_size > 30 THEN 'true,big,-' ELSE 'small,false,-' END || p_size"),
    "calls": ("part", ["p_partkey", "p_name", "p_type", "p_brand"], "join([p_name.upper(), eq(p_brand, \"Brand#3\"), lt(p_brand, \"Brand#2\"), trim(concat(\" \", p_type, \" \")), ltrim(\"  a\"), rtrim(concat(p_type, \"  \"))], \",\") as out", "concat_ws(',', upper(p_name), CAST(p_brand = 'Brand#3' AS VARCHAR), CAST(p_brand < 'Brand#2' AS VARCHAR), p_type, 'a', p_type)"),
    "casts": ("part", ["p_partkey", "p_name", "p_size"], "join([float(p_size) + 0.5, string(p_size) ++ \"!\", bool(p_name), get(p_name, 1), slice(p_name, 0, 2), is_null(\"\"), is_empty(\"\"), is_null(p_name), is_empty(p_name)], \",\") as out", "concat_ws(',', p_size || '.5', p_size || '!', 'true', p_name[2], p_name[1:2], 'true', 'true', 'false', 'false')"),
    "types": ("part", ["p_partkey", "p_size"], "join([typeof(p_size), typeof(int(p_size)), typeof(p_size / 2), typeof(null), typeof(true), typeof([1])], \",\") as out", "'string,integer,float,none,boolean,list'"),
}

for _name, (_table, _columns, _text, _want) in DERIVED.items():

    @query(f"derive_{_name}", f"SELECT {_want} AS value, count(*) AS n FROM {_table} GROUP BY 1")
    def _(spark, d, name=_table, columns=_columns, text=_text):
        e = judged(spark, d, name, rule("d", derive=f"'{text}'", left="out", right="out"), columns)
        return e.verdicts.groupBy(F.col("left").alias("value")).agg(F.count("*").alias("n"))


@query("derive_tests", "SELECT concat_ws(',', CAST(p_name LIKE 's%' AS VARCHAR), CAST(p_name LIKE '%t' AS VARCHAR), CAST(p_name LIKE '%bol%' AS VARCHAR), CAST(p_name = 'red bolt' AS VARCHAR), CAST(p_size = 11 AS VARCHAR), CAST(CAST(p_size AS VARCHAR) < '3' AS VARCHAR), CAST(NOT p_size > 20 AS VARCHAR)) AS value, count(*) AS n FROM part GROUP BY 1")
def _(spark, d):
    text = 'join([startswith(p_name, "s"), endswith(p_name, "t"), contains(p_name, "bol"), p_name in ["red bolt"], p_size == 11, p_size lt "3", not(p_size > 20)], ",") as out'
    e = judged(spark, d, "part", rule("d", derive=f"'{text}'", left="out", right="out"), ["p_partkey", "p_name", "p_size"])
    return e.verdicts.groupBy(F.col("left").alias("value")).agg(F.count("*").alias("n"))


@query("check_expression", counts_sql("lineitem", PASS.format("l_quantity * 2 >= l_linenumber * 9")))
def _(spark, d):
    return counted(judged(spark, d, "lineitem", rule("c", check="'l_quantity * 2 >= l_linenumber * 9'"), ["l_orderkey", "l_quantity", "l_linenumber"]))


@query("inline_sides", counts_sql("part", PASS.format("p_size % 7 = (p_partkey % 7)")))
def _(spark, d):
    return counted(judged(spark, d, "part", rule("i", left="p_size % 7", right="p_partkey % 7"), ["p_partkey", "p_size"]))


@query("col_reference", "SELECT n_name || ':' || n_regionkey AS value, count(*) AS n FROM nation GROUP BY 1")
def _(spark, d):
    e = judged(spark, d, "nation", rule("c", derive="'col(1) ++ \":\" ++ col(\"n_regionkey\") as out'", left="out", right='"#0"'), ["n_nationkey", "n_name", "n_regionkey"])
    return e.verdicts.groupBy(F.col("left").alias("value")).agg(F.count("*").alias("n"))


@query("composite_key", "SELECT l_returnflag || '/' || lower(l_linestatus) AS value, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    text = rule("k", left="[l_returnflag, L_LINESTATUS]", right="l_linestatus", transform_left="trim", join_separator='"/"')
    e = judged(spark, d, "lineitem", text, ["l_orderkey", "l_returnflag", "l_linestatus"])
    return e.verdicts.groupBy(F.concat(F.substring_index("left", "/", 1), F.lit("/"), F.lower(F.substring_index("left", "/", -1))).alias("value")).agg(F.count("*").alias("n"))


@query("or_fallback", "SELECT coalesce(CAST(quality AS VARCHAR), lang) AS value, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def _(spark, d):
    df = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    e = verdicts.evaluate(tables.from_frame(df, "doc_id", F.col("doc_id")), rules.parse(rule("o", left="or(quality, lang)", right="lang")))
    return e.verdicts.groupBy(F.col("left").alias("value")).agg(F.count("*").alias("n"))


# Results ------------------------------------------------------------------------------------------------

STATUS = rule("status", left="l_returnflag", right="l_linestatus", derive="'l_quantity as q'", compare="ne")
LINES = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity"]


@query("groups_topk", "SELECT * FROM (SELECT 'passed' AS outcome, l_returnflag AS \"left\", l_linestatus AS \"right\", count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, l_returnflag, l_linestatus)::INT AS place FROM lineitem GROUP BY 2, 3) WHERE place <= 4")
def _(spark, d):
    e = judged(spark, d, "lineitem", STATUS, LINES)
    return reports.top_groups(e.verdicts, [4]).select("outcome", "left", "right", "count", "place")


#: FNV-1a of 64 bits over the digits of a key.
FNV_SQL = "list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(string_split(id, ''), lambda c: CAST(ascii(c) AS HUGEINT))), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"


@query(
    "group_ids_minhash",
    f"""
WITH v AS (SELECT o_orderstatus AS l, o_orderpriority AS r, CAST(o_orderkey AS VARCHAR) AS id FROM orders),
g AS (SELECT *, row_number() OVER (ORDER BY n DESC, l, r) AS place FROM (SELECT l, r, count(*) AS n FROM v GROUP BY 1, 2)),
h AS (SELECT l, r, n, place, id, row_number() OVER (PARTITION BY l, r ORDER BY {FNV_SQL}, id) AS k FROM v JOIN g USING (l, r) WHERE place <= 5)
SELECT 'failed' AS outcome, l AS "left", r AS "right", n AS count, CAST(place AS INT) AS place, string_agg(id, ',' ORDER BY k) AS ids
FROM h WHERE k <= 5 GROUP BY ALL""",
)
def _(spark, d):
    t = table(spark, d, "orders", ["o_orderkey", S, P], "o_orderkey")
    v = verdicts.evaluate(t, rules.parse(rule("o", left=S, right=P))).verdicts
    return reports.group_ids(v, reports.top_groups(v, [5]), [5]).select("outcome", "left", "right", "count", "place", F.array_join("ids", ",").alias("ids"))


@query("ambiguity_examples", f"SELECT token, first_row FROM (SELECT lower(p_brand) AS token, min(p_partkey) AS first_row FROM part GROUP BY 1) JOIN (SELECT token FROM ({BRAND_BEST}) WHERE k = 1 AND m > 1) USING (token)")
def _(spark, d):
    v = judged(spark, d, "part", BRAND, BRAND_COLUMNS).verdicts
    return reports.ambiguity_examples(v, [100]).select("token", F.col("example.row").alias("first_row"))


HIT_RULE = rule("h", left=S, right=P)
HIT_OUTCOME = "CASE WHEN o_orderstatus = o_orderpriority THEN 'passed' ELSE 'failed' END"


@query("hits_capped", f"SELECT o_orderkey AS row, o_orderstatus AS \"left\" FROM (SELECT *, row_number() OVER (PARTITION BY {HIT_OUTCOME} ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 50")
def _(spark, d):
    return search.hits(judged(spark, d, "orders", HIT_RULE, ["o_orderkey", S, P]), 0, limit=50).select(F.col("_row").alias("row"), "left")


@query("hits_distinct", "SELECT o_orderkey AS row, o_orderstatus AS \"left\" FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS j FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 3) WHERE j <= 30")
def _(spark, d):
    return search.hits(judged(spark, d, "orders", HIT_RULE, ["o_orderkey", S, P]), 0, limit=30, distinct=True).select(F.col("_row").alias("row"), "left")


@query("hit_headings", "SELECT o_orderkey AS row, coalesce(lag(o_orderstatus || o_orderpriority) OVER (ORDER BY o_orderstatus, o_orderpriority, o_orderkey) <> o_orderstatus || o_orderpriority, true) AS heading FROM orders")
def _(spark, d):
    v = judged(spark, d, "orders", HIT_RULE, ["o_orderkey", S, P])
    return search.with_headings(search.hits(v, 0, limit=1 << 30)).select(F.col("_row").alias("row"), "heading")


@query("search_regex", "SELECT page_id AS row FROM pages WHERE regexp_matches(url, 'ref=[xy]', 'i') OR regexp_matches(html, 'ref=[xy]', 'i') OR regexp_matches(CAST(page_id AS VARCHAR), 'ref=[xy]')")
def _(spark, d):
    return search.search(table(spark, d, "pages"), "REF=[xy]").select(F.col("_row").alias("row"))


@query("search_regex_visible", "SELECT page_id AS row FROM pages WHERE regexp_matches(url, '/fr/', 'i')")
def _(spark, d):
    return search.search(table(spark, d, "pages"), "/FR/", visible=["url"]).select(F.col("_row").alias("row"))


@query("search_expression", "SELECT p_partkey AS row FROM part WHERE p_size > 30 AND (p_name LIKE '%bolt' OR p_brand = 'Brand#7')")
def _(spark, d):
    return search.search(table(spark, d, "part"), 'p_size > 30 and (endswith(p_name, "bolt") or p_brand eq "Brand#7")', "expression").select(F.col("_row").alias("row"))


@query("search_prefix", "SELECT p_partkey AS row FROM part WHERE lower(p_name) LIKE 'sm%' OR lower(p_type) LIKE 'sm%'")
def _(spark, d):
    return search.search(table(spark, d, "part"), "Sm", "prefix", ["p_name", "p_type"]).select(F.col("_row").alias("row"))


@query("search_totals", "SELECT count(*) FILTER (WHERE p_name LIKE '%ring%') AS matched, count(*) AS rows_read, count(*) FILTER (WHERE p_name LIKE '%ring%') > 100 AS truncated FROM part")
def _(spark, d):
    return search.totals(table(spark, d, "part"), "ring", visible=["p_name"])


@query("row_detail", "SELECT * FROM (VALUES (0, 'n_nationkey', '3'), (1, 'n_name', 'NATION_3'), (2, 'n_regionkey', (SELECT CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_nationkey = 3))) AS t(place, attribute, value)")
def _(spark, d):
    return search.detail(table(spark, d, "nation"), 3)


@query("filtered_rules", counts_sql("(SELECT * FROM orders WHERE o_totalprice > 200000)", PASS.format("o_orderstatus = 'F'")))
def _(spark, d):
    columns = ["o_orderkey", S, "o_totalprice"]
    kept = compile_filter("o_totalprice > 200000", columns)
    return counted(judged(spark, d, "orders", rule("f", left=S, pattern='"^F$"'), columns, row_filter=kept))


@query("row_ids", "SELECT CASE WHEN p_size > 25 THEN p_name ELSE 'row:' || p_partkey END AS id, count(*) AS n FROM part GROUP BY 1")
def _(spark, d):
    df = read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.concat(F.lit(" "), "p_name")).alias("own"))
    return tables.from_frame(df, "own", F.col("p_partkey")).df.groupBy(F.col("_id").alias("id")).agg(F.count("*").alias("n"))


@query("row_numbers", "SELECT count(*) AS rows, min(1) AS first, count(*) AS last, count(*) AS different FROM lineitem")
def _(spark, d):
    t = tables.from_frame(read(spark, d, "lineitem").select("l_orderkey"))
    return t.df.agg(F.count("*").alias("rows"), F.min("_row").cast("int").alias("first"), F.max("_row").alias("last"), F.countDistinct("_row").alias("different"))


SUMMARY = "\n".join([BRAND, rule("size", left="p_size", pattern='"^[1-4]"'), rule("words", left="p_name", right="p_name", multi="true", separator='" "'), rule("type", check="'len(p_type) > 5'")])


@query(
    "rule_report_summary",
    " UNION ALL ".join(
        [
            counts_sql(f"part JOIN (SELECT token, target FROM ({BRAND_BEST}) WHERE k = 1) ON token = lower(p_brand)", PASS.format("p_type = target"), 0),
            counts_sql("part", PASS.format("regexp_matches(CAST(p_size AS VARCHAR), '^[1-4]')"), 1),
            counts_sql("part", PASS.format("true"), 2),
            counts_sql("part", PASS.format("length(p_type) > 5"), 3),
        ]
    ),
)
def _(spark, d):
    return counted(judged(spark, d, "part", SUMMARY, [*BRAND_COLUMNS, "p_name"]))


#: Four rules over the largest table: equal dates, a learned mapping, token sets, a mapping of two files.
LINE_RULES = "\n".join(
    [
        rule("dates", derive="'l_shipdate[0:10] as day'", left="day", right="l_shipdate", transform_left='date(["%Y-%m-%d", "%d/%m/%Y"], "%Y-%m-%d")', transform_right='date(["%Y-%m-%d %H:%M:%S"], "%Y-%m-%d")'),
        rule("learned", left="l_returnflag", right="l_linestatus", transform_left="trim | lower", mapping="auto"),
        rule("sets", derive="'l_returnflag ++ \";\" ++ l_linestatus as a, l_linestatus ++ \"; \" ++ l_returnflag as b'", left="a", right="b", multi="true"),
        rule("files", left="l_returnflag", right="l_linestatus", mapping_files="[one, two]", mapping_left="flag", mapping_right="status"),
    ]
)


@query(
    "line_rules",
    " UNION ALL ".join(
        [
            counts_sql("lineitem", PASS.format("true"), 0),
            counts_sql("lineitem JOIN (SELECT f, s FROM (SELECT l_returnflag AS f, l_linestatus AS s, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_linestatus) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1) ON f = l_returnflag", PASS.format("l_linestatus = s"), 1),
            counts_sql("lineitem", PASS.format("true"), 2),
            counts_sql("lineitem", PASS.format("l_linestatus = CASE l_returnflag WHEN 'A' THEN 'F' WHEN 'R' THEN 'F' WHEN 'N' THEN 'O' END"), 3),
        ]
    ),
)
def line_rules(spark: SparkSession, d: str) -> DataFrame:
    refs = {"one": small_table(spark, "flag status", [("A", "F"), ("R", "F")]), "two": small_table(spark, "flag status", [("N", "O")])}
    t = tables.from_frame(read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_shipdate"), row=F.monotonically_increasing_id())
    return counted(verdicts.evaluate(t, rules.parse(LINE_RULES), mapping.References(spark, refs)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
