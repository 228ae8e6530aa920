"""Rules over streams: those without a learned mapping are functions of one row (and of reference tables), so
that their verdicts are a streaming DataFrame like any other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.operators.mapping import References
from pairwright.operators.verdicts import evaluate
from pairwright.plans.rules import Program, RuleError
from pairwright.sources.tables import with_ids


def verdict_stream(stream: DataFrame, program: Program, row: Column, references: References | None = None, id_column: str | None = None) -> DataFrame:
    """Verdicts of a streaming DataFrame. row: a number for each row, which a stream must bring itself."""
    for r in program.rules:
        if r.auto or (r.sources and (r.multi or program.defaults.multi)):
            raise RuleError(f"rule '{r.name}': a stream can't learn a mapping or look up several tokens of a row")
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(stream.columns)]
    table = with_ids(stream.select(*cells, row.cast("long").alias("_row")), stream.columns, id_column)
    return evaluate(table, program, references).verdicts


def counter_stream(verdicts: DataFrame) -> DataFrame:
    """Running counts by rule and outcome; for complete or update mode."""
    return verdicts.groupBy("rule", "outcome").agg(F.count("*").alias("rows"), F.count_if("transform_error").alias("transform_errors"), F.sum("unmapped").alias("unmapped"))
