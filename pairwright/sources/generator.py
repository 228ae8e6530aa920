"""Weather records with planted flaws, for trying rules out. Deterministic for a seed.

The random numbers are those of SplitMix64, whose k-th number is a function of the seed and k. So any part of
the table can be made by itself: the first ``rows`` numbers say which rows are flawed, four more for each row
its city, day, noise and humidity.
"""

from __future__ import annotations

import csv
import datetime
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

#: Cities, their countries and their mean temperatures (°C).
CITIES = [
    ("Paris", "France", 12.0),
    ("Berlin", "Germany", 10.0),
    ("London", "United Kingdom", 11.5),
    ("Madrid", "Spain", 15.0),
    ("Rome", "Italy", 16.0),
    ("Amsterdam", "Netherlands", 10.5),
    ("Vienna", "Austria", 11.0),
    ("Lisbon", "Portugal", 17.0),
    ("Warsaw", "Poland", 9.0),
    ("Stockholm", "Sweden", 7.0),
]
#: The columns.
HEADERS = ["id", "city", "country", "recorded_on", "temp_c", "temp_f", "humidity_pct"]
#: The constants of SplitMix64.
GOLDEN, FIRST_FACTOR, SECOND_FACTOR = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
CHUNK = 100_000


def numbers(seed: int, places: np.ndarray) -> np.ndarray:
    """The random numbers at these places, from 1."""
    start = np.uint64((seed ^ GOLDEN) & ((1 << 64) - 1))
    with np.errstate(over="ignore"):
        z = start + places.astype(np.uint64) * np.uint64(GOLDEN)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST_FACTOR)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND_FACTOR)
    return z ^ (z >> np.uint64(31))


def units(drawn: np.ndarray) -> np.ndarray:
    return (drawn >> np.uint64(11)).astype(np.float64) / 2.0**53


def flawed(rows: int, seed: int, rate: float, first: int, count: int) -> np.ndarray:
    """Which of some rows are flawed by chance."""
    return units(numbers(seed, np.arange(first, first + count) + 1)) < rate


def flaws_before(rows: int, seed: int, rate: float) -> tuple[list[int], bool | None]:
    """How many flawed rows there are before each chunk; and, if all rows came out alike, what the middle one is
    made to be, so that both kinds of rows are there."""
    sums = [0]
    for first in range(0, rows, CHUNK):
        sums.append(sums[-1] + int(flawed(rows, seed, rate, first, min(CHUNK, rows - first)).sum()))
    forced = None if rows < 2 or 0 < sums[-1] < rows else not sums[-1]
    return sums, forced


def chunk(k: int, rows: int, before: int, forced: bool | None, seed: int, rate: float, start: datetime.date, days: int) -> list[list[str]]:
    """The records of the k-th chunk, of whose flaws there are ``before`` in the chunks before it."""
    first = k * CHUNK
    row = np.arange(first, min(rows, first + CHUNK))
    bad = flawed(rows, seed, rate, first, len(row))
    if forced is not None:
        bad[row == rows // 2] = forced
        before -= not forced and first > rows // 2
    kind = np.where(bad, (before + np.cumsum(bad) - 1) % 3, -1)
    drawn = [numbers(seed, rows + 4 * row + n) for n in (1, 2, 3, 4)]
    city, day = drawn[0] % np.uint64(len(CITIES)), (drawn[1] % np.uint64(days)).astype(np.int64)
    season = 12.0 * np.sin(day / 365.0 * math.tau)
    means = np.array([mean for *_, mean in CITIES])
    celsius = [f"{t:.1f}" for t in (means[city] + season + (units(drawn[2]) - 0.5) * 6.0).tolist()]
    exact = np.array(celsius, dtype=np.float64) * 9.0 / 5.0 + 32.0
    fahrenheit = (np.copysign(np.floor(np.abs(exact) + 0.5), exact)).astype(np.int64) + 3 * (kind == 1)
    humidity = 30 + (drawn[3] % np.uint64(61)).astype(np.int64)
    place = city.astype(np.int64)
    country = np.where(kind == 0, (place + 1) % len(CITIES), place)
    dates = [(start + datetime.timedelta(days=d)).strftime("%d/%m/%Y" if f == 2 else "%Y-%m-%d") for d, f in zip(day.tolist(), kind.tolist())]
    return [
        [f"W{i + 1:06d}" for i in row.tolist()],
        [CITIES[c][0] for c in place.tolist()],
        [CITIES[c][1] for c in country.tolist()],
        dates,
        celsius,
        [str(f) for f in fahrenheit.tolist()],
        [str(h) for h in humidity.tolist()],
    ]


def _settings(rows: int, seed: int, bad_rate: float, start: str, days: int) -> tuple:
    if rows < 0:
        raise ValueError("rows must not be negative")
    rate = min(1.0, max(0.0, bad_rate))
    sums, forced = flaws_before(rows, seed, rate)
    return sums, forced, rate, datetime.date.fromisoformat(start), max(1, days)


def generate(rows: int, seed: int = 42, bad_rate: float = 0.1, start: str = "2024-01-01", days: int = 365) -> Iterator[list[str]]:
    """Records as lists of texts. Flaws take turns: another country, Fahrenheit three too many, a date in another
    format. With two rows or more both kinds of rows are there."""
    sums, forced, rate, first, days = _settings(rows, seed, bad_rate, start, days)
    for k, before in enumerate(sums[:-1]):
        yield from map(list, zip(*chunk(k, rows, before, forced, seed, rate, first, days)))


def frame(spark: SparkSession, rows: int, seed: int = 42, bad_rate: float = 0.1, start: str = "2024-01-01", days: int = 365) -> DataFrame:
    """The records as a DataFrame, chunk by chunk on the executors."""
    sums, forced, rate, first, days = _settings(rows, seed, bad_rate, start, days)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in chunk(k, rows, sums[k], forced, seed, rate, first, days)], names=HEADERS)

    chunks = spark.range(len(sums) - 1).select(F.col("id"))
    return chunks.repartitionByRange(max(1, len(sums) - 1), "id").mapInArrow(run, ", ".join(f"{h} string" for h in HEADERS))


def reference(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([c[:2] for c in CITIES], "city string, country string")


def write(path: str, rows: int, reference_path: str | None = None, **how) -> None:
    """The records as a CSV file, and the table of cities if a path is given."""
    with open(path, "w", newline="") as out:
        w = csv.writer(out, lineterminator="\n")
        w.writerow(HEADERS)
        w.writerows(generate(rows, **how))
    if reference_path:
        with open(reference_path, "w", newline="") as out:
            w = csv.writer(out, lineterminator="\n")
            w.writerow(["city", "country"])
            w.writerows(c[:2] for c in CITIES)
