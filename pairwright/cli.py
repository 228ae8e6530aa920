"""Command line: check a file against rules, search it, or generate records."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pairwright.functions.patterns import PatternError
from pairwright.operators import mapping, reports, search, verdicts
from pairwright.plans import rules
from pairwright.plans.rules import RuleError
from pairwright.progress import Progress
from pairwright.session import session
from pairwright.sources import generator, tables
from pairwright.sources.tables import TableError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pairwright", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    v = sub.add_parser("validate", help="check a table against rules")
    v.add_argument("input", nargs="?", default="-", help="a delimited file; - for standard input")
    v.add_argument("-r", "--rules", required=True)
    v.add_argument("-d", "--delimiter", default=",")
    v.add_argument("--id-column")
    v.add_argument("-n", "--examples", type=int, default=10)
    v.add_argument("-j", "--threads", type=int, default=0, help="local cores; 0 for all")
    v.add_argument("--format", choices=("text", "json", "html"), default="text")
    v.add_argument("--title", default="Validation report")
    v.add_argument("-o", "--output")
    v.add_argument("--no-fail", action="store_true", help="exit with 0 even if rules fail")
    v.add_argument("--no-progress", action="store_true")
    s = sub.add_parser("search", help="find rows")
    s.add_argument("path")
    s.add_argument("-s", "--search", default="")
    s.add_argument("--mode", choices=("regex", "expression", "prefix"), default="regex")
    s.add_argument("--columns", nargs="*")
    s.add_argument("-d", "--delimiter", default=",")
    s.add_argument("-n", "--limit", type=int, default=100)
    g = sub.add_parser("generate", help="write weather records with flaws")
    g.add_argument("rows", type=int)
    g.add_argument("-o", "--output", required=True)
    g.add_argument("--seed", type=int, default=42)
    g.add_argument("--bad-rate", type=float, default=0.1)
    g.add_argument("--start-date", default="2024-01-01")
    g.add_argument("--days", type=int, default=365)
    g.add_argument("--reference")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.command == "generate":
            generator.write(a.output, a.rows, a.reference, seed=a.seed, bad_rate=a.bad_rate, start=a.start_date, days=a.days)
            return 0
        sep = tables.delimiter(a.delimiter)
        spark = session(str(getattr(a, "threads", 0) or "*"))
        spark.conf.set("spark.sql.ansi.enabled", "true")
        if a.command == "search":
            table = tables.from_csv(spark, a.path, sep)
            n = search.totals(table, a.search, a.mode, a.columns, a.limit).first()
            for r in search.search(table, a.search, a.mode, a.columns, a.limit).select(*[f"c{i}" for i in range(len(table.headers))]).collect():
                print(sep.join(r))
            print(f"{n.matched} of {n.rows_read} rows match" + (f", the first {a.limit} are shown" if n.truncated else ""), file=sys.stderr)
            return 0
        program = rules.with_limit(rules.load(a.rules), a.examples)
        table = tables.from_stdin(spark, sep, a.id_column) if a.input == "-" else tables.from_csv(spark, a.input, sep, a.id_column)
        references = mapping.References(spark, sep=sep, folder=str(Path.cwd()))
        with Progress(spark, not a.no_progress and sys.stderr.isatty()):
            report = reports.report(verdicts.evaluate(table, program, references))
    except (RuleError, TableError, PatternError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    text = {"text": reports.render_text, "json": reports.render_json, "html": lambda r: reports.render_html(r, a.title)}[a.format](report)
    if a.output:
        Path(a.output).write_text(text)
    else:
        print(text, end="" if text.endswith("\n") else "\n")
    return 1 if report["rules_failed"] and not a.no_fail else 0


if __name__ == "__main__":
    sys.exit(main())
