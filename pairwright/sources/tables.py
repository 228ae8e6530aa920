"""Tables of text cells.

Every cell is text and never null: what is missing is empty. Cells are named c0, c1, ... by place, since
headers may repeat. ``_row`` is the 1-based place of a row in its table, given before any filter.
"""

from __future__ import annotations

import atexit
import csv
import shutil
import sys
import tempfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.patterns import trim


#: How many rows a row stands for, in tables where alike ones are put together.
WEIGHT = "_n"


class TableError(ValueError):
    pass


@dataclass
class Table:
    df: DataFrame  # c0..., _row, _id
    headers: list[str]

    def cell(self, i: int) -> Column:
        return F.col(f"c{i}")


def column_index(headers: list[str], name: str) -> int | None:
    """The place of a column: ``#i``, else the first header that is equal, else equal but for ASCII case."""
    name = name.strip()
    if name.startswith("#") and name[1:].isdigit():
        i = int(name[1:])
        return i if i < len(headers) else None
    if name in headers:
        return headers.index(name)
    fold = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    low = [fold(h) for h in headers]
    return low.index(fold(name)) if fold(name) in low else None


def delimiter(text: str) -> str:
    if text in ("\\t", "tab", "TAB"):
        return "\t"
    if text == "\\0":
        return "\0"
    if len(text.encode()) != 1:
        raise TableError(f"delimiter must be one byte, got {text!r}")
    return text


def read_header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """The cells of the first record; none of an empty file."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return []
    if first[0][0].count('"') % 2:  # a cell goes on in the next line
        record = spark.read.options(sep=sep, quote='"', escape='"', multiLine=True, header=False).csv(path).limit(1).collect()
        cells = [c or "" for c in record[0]]
    else:
        cells = next(csv.reader([first[0][0]], delimiter=sep), [])
    if cells:
        cells[0] = cells[0].removeprefix("\ufeff")
    return cells


def has_line_ends(spark: SparkSession, path: str) -> bool:
    """Whether a cell may hold a line end: some line has an odd number of quotes. One pass over all splits of the
    file, up to the first such line."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, sep: str = ",", multi_line: bool | None = None) -> tuple[DataFrame, list[str]]:
    """c0... of a delimited file, and its header. Spark splits a file unless cells hold line ends, which is looked for
    first; multi_line says so beforehand. An empty file is a table without columns and rows."""
    headers = read_header(spark, path, sep)
    if not headers:
        return spark.range(0).select(), []
    if multi_line is None:
        multi_line = has_line_ends(spark, path)
    schema = ", ".join(f"c{i} string" for i in range(len(headers)))
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("sep", sep).option("quote", '"').option("escape", '"')
    df = reader.option("multiLine", multi_line).option("mode", "PERMISSIVE").csv(path)
    return df.select(*[F.coalesce(F.col(f"c{i}"), F.lit("")).alias(f"c{i}") for i in range(len(headers))]), headers


def from_csv(spark: SparkSession, path: str, sep: str = ",", id_column: str | None = None, multi_line: bool | None = None) -> Table:
    df, headers = read_csv(spark, path, sep, multi_line)
    return with_ids(numbered(df), headers, id_column)


def from_stdin(spark: SparkSession, sep: str = ",", id_column: str | None = None) -> Table:
    """Standard input, spooled to a file, since a learned mapping reads it twice; the file goes when the process
    ends. For local sessions."""
    with tempfile.NamedTemporaryFile("wb", suffix=".csv", delete=False) as out:
        shutil.copyfileobj(sys.stdin.buffer, out)
    atexit.register(Path(out.name).unlink, missing_ok=True)
    return from_csv(spark, out.name, sep, id_column)


def from_frame(df: DataFrame, id_column: str | None = None, row: Column | None = None) -> Table:
    """A table of a DataFrame's columns as text. row: what numbers the rows, if they have a unique number."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(df.columns)]
    if row is not None:
        return with_ids(df.select(*cells, row.cast("long").alias("_row")), df.columns, id_column)
    return with_ids(numbered(df.select(*cells)), df.columns, id_column)


def numbered(df: DataFrame) -> DataFrame:
    """df with _row from 1, in the order of its partitions (of one file: the file's order). One pass counts the
    partitions' rows; what comes before each, a row a partition, is joined to the second."""
    m = df.withColumn("_at", F.monotonically_increasing_id())
    counts = sorted((r.p, r["count"]) for r in m.groupBy(F.shiftright("_at", 33).alias("p")).count().collect())  # a row for each file split
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "_p long, _start long"))
    placed = m.join(starts, F.shiftright("_at", 33) == F.col("_p"))
    return placed.withColumn("_row", (F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("_at", "_p", "_start")


def with_ids(df: DataFrame, headers: list[str], id_column: str | None) -> Table:
    """_id: the trimmed id cell, or row:N where that is empty or there is none."""
    fallback = F.concat(F.lit("row:"), F.col("_row"))
    if id_column is None:
        return Table(df.withColumn("_id", fallback), list(headers))
    i = column_index(list(headers), id_column)
    if i is None:
        raise TableError(f"id column '{id_column}' not found")
    own = trim(F.col(f"c{i}"))
    return Table(df.withColumn("_id", F.when(own != "", own).otherwise(fallback)), list(headers))


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').mode("overwrite").csv(path)
