"""Reports: counters, groups with example ids, ambiguities and mappings, and their text, JSON and HTML."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.hashing import hash_order
from pairwright.operators.mapping import Relation
from pairwright.operators.verdicts import FAILED, PASSED, SKIPPED, VALIDATION_SKIPPED, Evaluation, compacted, evaluate, told
from pairwright.sources.tables import WEIGHT

GROUPED = (PASSED, FAILED, VALIDATION_SKIPPED)


def counters(verdicts: DataFrame) -> DataFrame:
    """A row for each rule: checked, passed, failed, skipped, validation_skipped, transform_errors, unmapped."""
    n = lambda outcome: F.count_if(F.col("outcome") == outcome)
    return verdicts.groupBy("rule").agg(
        F.count("*").alias("checked"),
        n(PASSED).alias("passed"),
        n(FAILED).alias("failed"),
        n(SKIPPED).alias("skipped"),
        n(VALIDATION_SKIPPED).alias("validation_skipped"),
        F.count_if("transform_error").alias("transform_errors"),
        F.sum("unmapped").alias("unmapped"),
    )


def count(evaluation: Evaluation) -> DataFrame:
    """The counters of an evaluation, in one pass of columns over its table: rows that are alike in the cells
    that rules read are looked at once, if there are many of them, and no verdict becomes a row."""
    alike = evaluate(compacted(evaluation.table, evaluation.plan, evaluation.row_filter), evaluation.program, evaluation.references)
    n = F.col(WEIGHT) if WEIGHT in alike.wide.columns else F.lit(1)
    parts, sums = [], []
    for p in alike.plan.rules:
        v, i = told(p), p.index
        parts += [v["outcome"].alias(f"o{i}"), v["transform_error"].alias(f"t{i}"), v["unmapped"].alias(f"u{i}")]
        of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n")).otherwise(0)), F.lit(0)).cast("long")
        each = [(F.lit(True), "checked"), *[(F.col(f"o{i}") == x, x) for x in (PASSED, FAILED, SKIPPED, VALIDATION_SKIPPED)], (F.col(f"t{i}"), "transform_errors")]
        unmapped = F.coalesce(F.sum(F.col(f"u{i}") * F.col("n")), F.lit(0)).cast("long")
        sums.append(F.struct(F.lit(i).alias("rule"), *[of(c).alias(name) for c, name in each], unmapped.alias("unmapped")))
    one = alike.wide.select(n.cast("long").alias("n"), *parts).agg(F.array(*sums).alias("r"))
    return one.select(F.explode("r").alias("r")).select("r.*").where("checked > 0")


def _within(place: Column, limits: list[int]) -> Column:
    """Whether a place is within its rule's limit; the largest limit, a literal, stops the windows."""
    return (place <= max(limits, default=0)) & (place <= F.array(*[F.lit(n) for n in limits])[F.col("rule")])


KEY = ["rule", "outcome", "left", "right", "expected"]


def _same(a: str, b: str) -> Column:
    on = F.lit(True)
    for k in KEY:
        on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def top_groups(verdicts: DataFrame, limits: list[int]) -> DataFrame:
    """The most frequent (left, right, expected) of each rule and outcome; place from 1."""
    n = verdicts.where(F.col("outcome").isin(*GROUPED)).groupBy(*KEY).agg(F.count("*").alias("count"))
    order = Window.partitionBy("rule", "outcome").orderBy(F.desc("count"), "left", "right", F.asc_nulls_first("expected"))
    return n.withColumn("place", F.row_number().over(order)).where(_within(F.col("place"), limits))


def group_ids(verdicts: DataFrame, groups: DataFrame, limits: list[int]) -> DataFrame:
    """The groups (which the limits bound) with ids: the different ids of each with the smallest hashes, in the order of these.

    Only the groups' rows go on; their ids are ranked in windows that stop at the largest limit, so that a large
    group never gathers its ids.
    """
    kept = F.broadcast(groups.select(*KEY)).alias("g")  # limit groups for each rule and outcome at most
    rows = verdicts.alias("v").join(kept, _same("v", "g"), "left_semi").select(*KEY, "_id").distinct().withColumn("_h", hash_order(F.col("_id")))
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("_h", "_id"))
    ranked = rows.withColumn("_n", place).where(_within(F.col("_n"), limits))
    ids = ranked.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_id"))), lambda x: x["_id"]).alias("ids"))
    joined = groups.alias("a").join(ids.alias("b"), _same("a", "b"), "left")
    return joined.select("a.*", F.coalesce("b.ids", F.array().cast("array<string>")).alias("ids"))


def ambiguity_examples(verdicts: DataFrame, limits: list[int]) -> DataFrame:
    """For each rule the ambiguous tokens with the smallest hashes, each with the first row that has it."""
    rows = verdicts.select("rule", F.explode("ambiguous").alias("a"), "_row", "_id", "right").select("rule", "a.token", "a.expected", "_row", "_id", "right")
    first = rows.groupBy("rule", "token").agg(F.min_by(F.struct(F.col("_id").alias("id"), F.col("_row").alias("row"), F.col("token").alias("left"), "right", "expected"), "_row").alias("example"))
    order = Window.partitionBy("rule").orderBy("_h", "token")
    ranked = first.withColumn("_h", hash_order(F.col("token"))).withColumn("_n", F.row_number().over(order))
    return ranked.where(_within(F.col("_n"), limits)).select("rule", "token", "example")


def mapping_entries(relation: Relation) -> DataFrame:
    """input, canonical, ambiguous, targets of each left token."""
    best = relation.best().select("token", "canonical", "ambiguous")
    return best.join(relation.targets(best.select("token")), "token").select(F.col("token").alias("input"), "canonical", "ambiguous", "targets")


def ambiguities(relation: Relation, limit: int) -> DataFrame:
    """The ambiguous inputs with most targets, then most rows, then by text: input, place, how many targets, and the first of them."""
    order = [F.desc("targets"), F.desc("rows"), F.asc("token")]
    top = relation.best().where("ambiguous").select("token", F.col("targets").alias("n_targets"), "rows", F.struct((-F.col("targets")).alias("t"), (-F.col("rows")).alias("r"), "token").alias("place"))
    top = top.withColumnRenamed("n_targets", "targets").orderBy(*order).limit(limit).withColumnRenamed("targets", "n_targets")
    return top.join(relation.targets(top.select("token"), limit), "token").select(F.col("token").alias("input"), "place", "n_targets", "targets")


def report(evaluation: Evaluation, most_entries: int | None = None) -> dict:
    """The whole report as plain data; its size is bounded by the rules' limits, but for the mappings, which
    are listed in full, or up to most_entries of them (mapping_entries gives them as a table)."""
    plan, v = evaluation.plan, evaluation.verdicts
    v = v.persist()
    limits = [p.limit for p in plan.rules]
    numbers = {r.rule: r for r in counters(v).collect()}
    groups: dict[tuple, list] = {}
    if any(limits):
        for r in group_ids(v, top_groups(v, limits), limits).orderBy("rule", "outcome", "place").collect():
            g = {"left": r.left, "right": r.right}
            if r.expected is not None:
                g["expected"] = r.expected
            groups.setdefault((r.rule, r.outcome), []).append(g | {"count": r["count"], "ids": r.ids})
    examples = {(r.rule, r.token): r.example for r in ambiguity_examples(v, limits).collect()} if any(limits) else {}
    rules = []
    for p in plan.rules:
        n = numbers.get(p.index)
        of = lambda name: int(n[name]) if n is not None else 0  # noqa: E731, B023
        one = {"name": p.name, "left": p.left_name, "right": p.right_name, "status": PASSED, "rows_checked": of("checked"), "rows_passed": of("passed"), "rows_failed": of("failed"), "rows_skipped": of("skipped"), "rows_validation_skipped": of("validation_skipped"), "transform_errors": of("transform_errors"), "unmapped_values": of("unmapped")}
        for outcome, name in ((PASSED, "pass_results"), (FAILED, "fail_results"), (VALIDATION_SKIPPED, "validation_skipped_results")):
            one[name] = groups.get((p.index, outcome), [])
        unclear = 0
        if (p.index, 0) in evaluation.relations:
            rel = evaluation.relations[p.index, 0]
            rel = Relation(rel.counts.persist(), rel.multi_target)
            total = rel.best().agg(F.count("*").alias("inputs"), F.count_if("ambiguous").alias("unclear")).first()
            unclear = total["unclear"]
            listed_entries = mapping_entries(rel).orderBy("input")
            listed_entries = listed_entries if most_entries is None else listed_entries.limit(most_entries)
            entries = [{"input": e.input, "canonical": e.canonical, "ambiguous": e.ambiguous, "targets": [{"value": t.target, "count": t.n} for t in e.targets]} for e in listed_entries.collect()]
            listed = []
            for e in ambiguities(rel, p.limit).orderBy("place").collect() if p.limit and unclear else ():
                x = examples.get((p.index, e.input))
                shown = [{k: w for k, w in x.asDict().items() if w is not None}] if x is not None else []
                listed.append({"input": e.input, "targets": [{"value": t.target, "count": t.n} for t in e.targets], "examples": shown})
            one["mapping"] = {"source": "auto" if p.auto else "file", "distinct_inputs": total["inputs"], "ambiguous_inputs": unclear, "entries": entries, "ambiguities": listed}
            rel.counts.unpersist()
        if one["rows_failed"] or unclear:
            one["status"] = FAILED
        rules.append(one)
    v.unpersist()
    failed = sum(r["status"] == FAILED for r in rules)
    labels = {k: x for k, x in (("left_label", plan.left_label), ("right_label", plan.right_label)) if x}
    return labels | {"rules_total": len(rules), "rules_passed": len(rules) - failed, "rules_failed": failed, "rows_checked": max((r["rows_checked"] for r in rules), default=0), "rules": rules}


def render_json(rep: dict) -> str:
    return json.dumps(rep, indent=2, ensure_ascii=False)


def _sides(rep: dict) -> tuple[str, str]:
    return rep.get("left_label", "left"), rep.get("right_label", "right")


def render_text(rep: dict) -> str:
    left, right = _sides(rep)
    wide = max(len(left), len(right), len("expected"))
    out = [f"rules: {rep['rules_total']}, passed: {rep['rules_passed']}, failed: {rep['rules_failed']}, rows: {rep['rows_checked']}"]
    for r in rep["rules"]:
        out += ["", f"[{'PASS' if r['status'] == PASSED else 'FAIL'}] {r['name']}", f"  {left.ljust(wide)} {r['left']}", f"  {right.ljust(wide)} {r['right']}"]
        out.append(f"  checked {r['rows_checked']}, passed {r['rows_passed']}, failed {r['rows_failed']}, skipped {r['rows_skipped']}, validation skipped {r['rows_validation_skipped']}, transform errors {r['transform_errors']}, unmapped {r['unmapped_values']}")
        for title, name in (("passing", "pass_results"), ("failing", "fail_results"), ("validation skipped", "validation_skipped_results")):
            if r[name]:
                out.append(f"  {title}:")
            for g in r[name]:
                out += [f"    {g['count']} x", f"      {left.ljust(wide)} {g['left']!r}", f"      {right.ljust(wide)} {g['right']!r}"]
                if "expected" in g:
                    out.append(f"      {'expected'.ljust(wide)} {g['expected']!r}")
                out.append(f"      {'ids'.ljust(wide)} {', '.join(g['ids'])}")
        if m := r.get("mapping"):
            out.append(f"  mapping ({m['source']}): {m['distinct_inputs']} inputs, {m['ambiguous_inputs']} ambiguous")
            for a in m["ambiguities"]:
                out.append(f"    ambiguous {a['input']!r}: " + ", ".join(f"{t['value']!r} ({t['count']})" for t in a["targets"]))
                out += [f"      for example {x['id']}" for x in a["examples"]]
            out += [f"    {e['input']!r} -> {e['canonical']!r}" for e in m["entries"]]
    return "\n".join(out) + "\n"


STYLE = "body{font:14px sans-serif;margin:2em;max-width:70em}table{border-collapse:collapse;margin:.5em 0}td,th{border:1px solid #999;padding:.2em .6em;text-align:left;vertical-align:top}.failed{color:#b00020}.passed{color:#00703c}@media(prefers-color-scheme:dark){body{background:#111;color:#ddd}.failed{color:#ff8a80}.passed{color:#80e0a0}a{color:#9cf}}"


def render_html(rep: dict, title: str = "Validation report") -> str:
    e = lambda x: html.escape(str(x), quote=True)
    left, right = map(e, _sides(rep))
    row = lambda cells, tag="td": "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"
    out = ["<!doctype html>", f'<html lang="en"><head><meta charset="utf-8"><title>{e(title)}</title><style>{STYLE}</style></head><body>', f"<h1>{e(title)}</h1>"]
    out.append(f'<p class="summary">{rep["rules_total"]} rules, <span class="passed">{rep["rules_passed"]} passed</span>, <span class="failed">{rep["rules_failed"]} failed</span>, {rep["rows_checked"]} rows</p>')
    out.append('<p class="legend">A rule fails if a row fails or its mapping is ambiguous.</p>')
    order = sorted(range(len(rep["rules"])), key=lambda i: (rep["rules"][i]["right"].lower(), rep["rules"][i]["left"].lower(), i))
    out.append('<nav class="outline"><ul>' + "".join(f'<li class="{rep["rules"][i]["status"]}"><a href="#rule-{i}">{e(rep["rules"][i]["left"])} → {e(rep["rules"][i]["right"])}</a>: {e(rep["rules"][i]["name"])}</li>' for i in order) + "</ul></nav>")
    for i, r in enumerate(rep["rules"]):
        out.append(f'<section id="rule-{i}" class="rule"><h2 class="{r["status"]}">{e(r["name"])}</h2><p>{left}: <code>{e(r["left"])}</code>, {right}: <code>{e(r["right"])}</code></p>')
        names = ("rows_checked", "rows_passed", "rows_failed", "rows_skipped", "rows_validation_skipped", "transform_errors", "unmapped_values")
        out.append("<table>" + row([n.replace("_", " ") for n in names], "th") + row([r[n] for n in names]) + "</table>")
        for name, head in (("pass_results", "Passing"), ("fail_results", "Failing"), ("validation_skipped_results", "Validation skipped")):
            if r[name]:
                out.append(f"<h3>{head}</h3><table>" + row([left, right, "expected", "count", "ids"], "th"))
                out += [row([e(g["left"]), e(g["right"]), e(g.get("expected", "")), g["count"], e(", ".join(g["ids"]))]) for g in r[name]]
                out.append("</table>")
        if m := r.get("mapping"):
            out.append(f"<details><summary>Mapping ({m['source']}): {m['distinct_inputs']} inputs, {m['ambiguous_inputs']} ambiguous</summary><table>" + row(["input", "canonical", "targets"], "th"))
            out += [row([e(x["input"]), e(x["canonical"]), e(", ".join(f"{t['value']} ({t['count']})" for t in x["targets"]))]) for x in m["entries"]]
            out.append("</table></details>")
        out.append("</section>")
    return "\n".join([*out, "</body></html>"]) + "\n"
