"""Mixing sources to target weights by the cube method.

Every row of a source is wanted ``target / source size`` times. The whole part of that is taken
outright; the rest is an inclusion probability, which balanced sampling turns to 0 or 1. The flight
phase takes rows by threes: the two totals to keep (tokens, documents) leave one free direction, the
probabilities move along it, as a martingale, until one of the three lands, and so on. The threes of a
block move together, as arrays; its largest rows and its last few move one at a time against all the
others, so that the two rows that are left in the end are small. Both totals stay as they were up to
rounding errors.

Blocks of a source (by a hash of the row, some 16,000 rows each) fly alone; what they leave, two rows
each at most, flies again in blocks of what is left, until one block of at most two rows remains for a
source. Those land: of all joint distributions that keep both probabilities, the one with the smallest
expected error in tokens is drawn from. Draws come from a hash of the row, never from a generator's
state, so that reruns and other partitionings agree.

Rows are told apart by 128 bits of hashes; in ``take`` these are of all columns, so that rows that repeat are alike in all
of them.

Defined results: a null text has no words; rows without words take part with size 0 and are never
taken; a text of any length counts whole; a null source is a source of its own, last in order; repeated rows
are rows of their own; rows of equal hashes go by size and id; columns of any name stay as they are; an empty
table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.llm.common import columns, fresh, quoted, row_hash, small, stored, table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK = 16_384
NEAR = 1e-9
WORDS = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with size: the number of words of the text."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long"))


def targets(per_source: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> the same with target.

    The targets are min(most * size, weight * level), with the level at which they add up to
    share * all sizes: sources sorted by the level at which they are full, the level follows from
    running sums. One row per source; the windows run over those rows only.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = per_source.withColumn("weight", cycle[F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))])
    w = w.withColumn("full", most * F.col("source_size") / F.col("weight"))
    by_full = Window.orderBy("full", F.col("source").asc_nulls_last())
    before = by_full.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    w = w.withColumn("whole", share * F.sum("source_size").over(every))
    w = w.withColumn("level", (F.col("whole") - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    w = w.withColumn("open", F.min(F.when(F.col("level") < F.col("full"), F.struct("full", "level"))).over(every))
    target = F.when(F.col("open").isNull() | (F.col("full") < F.col("open.full")), most * F.col("source_size")).otherwise(
        F.least(most * F.col("source_size"), F.col("weight") * F.col("open.level"))
    )
    return w.select("source", "source_size", target.cast("double").alias("target"))


def draws(seeds: np.ndarray, round_: int) -> np.ndarray:
    """A number in [0, 1) for each seed and round."""
    with np.errstate(over="ignore"):
        x = seeds.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(round_ + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def settle(p: np.ndarray) -> np.ndarray:
    p[p < NEAR] = 0.0
    p[p > 1 - NEAR] = 1.0
    return p


FEW = 512
LARGEST = 64


def flight(p: np.ndarray, size: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """p, moved until at most two of them are neither 0 nor 1; sum(p) and sum(p * size) stay.

    The largest rows land first, each against all the others, which hardly move for it; else they
    would be what is left. Then the rest moves by threes, and the last few again one by one.
    """
    p = settle(p.astype(np.float64).copy())
    size = size.astype(np.float64)
    left = np.flatnonzero((p > 0) & (p < 1))
    if len(left) > FEW:
        p = _one_by_one(p, size, seeds, LARGEST)
        p = _by_threes(p, size, seeds)
    return _one_by_one(p, size, seeds, None)


def _one_by_one(p: np.ndarray, size: np.ndarray, seeds: np.ndarray, most: int | None) -> np.ndarray:
    """Lands rows from the largest on, ``most`` of them, or until two are left."""
    left = np.flatnonzero((p > 0) & (p < 1))
    left = left[np.lexsort((draws(seeds[left], 3), -size[left]))]
    landed = round_ = 0
    while len(left) >= 3 and (most is None or landed < most):
        first, rest = left[0], left[1:]
        s = size[rest]
        n, total, squares = float(len(s)), s.sum(), (s * s).sum()
        det = n * squares - total * total
        if det <= 1e-9 * max(1.0, squares * n):
            if size[first] != s[0]:  # the others are alike and can't offset it: they move among themselves
                first, rest = left[1], left[2:]
                n = float(len(rest))
            way = np.full(len(rest), -1.0 / n)
        else:
            shift = (squares - total * size[first]) / det
            slope = (n * size[first] - total) / det
            way = -(shift + slope * s)
        take, way = np.append(first, rest), np.append(1.0, way)
        at = p[take]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(way > 0, (1 - at) / way, np.where(way < 0, at / -way, np.inf)).min()
            down = np.where(way > 0, at / way, np.where(way < 0, (1 - at) / -way, np.inf)).min()
        step = up if draws(seeds[first : first + 1], round_)[0] * (up + down) < down else -down
        p[take] = settle(np.clip(at + step * way, 0.0, 1.0))
        landed += not 0 < p[left[0]] < 1
        left = left[(p[left] > 0) & (p[left] < 1)]
        round_ += 1
    return p


def _by_threes(p: np.ndarray, size: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Moves rows by threes, all threes at once, until at most FEW are left."""
    left = np.flatnonzero((p > 0) & (p < 1))
    round_ = 0
    while len(left) > FEW:
        take = left[: len(left) // 3 * 3].reshape(3, -1).T
        x, y, z = size[take[:, 0]], size[take[:, 1]], size[take[:, 2]]
        way = np.stack([z - y, x - z, y - x], axis=1)
        way[(way == 0).all(axis=1)] = (1.0, -1.0, 0.0)
        way /= np.abs(way).max(axis=1, keepdims=True)
        at = p[take]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(way > 0, (1 - at) / way, np.where(way < 0, at / -way, np.inf)).min(axis=1)
            down = np.where(way > 0, at / way, np.where(way < 0, (1 - at) / -way, np.inf)).min(axis=1)
        step = np.where(draws(seeds[take[:, 0]], round_) * (up + down) < down, up, -down)
        p[take] = settle(np.clip(at + step[:, None] * way, 0.0, 1.0))
        left = np.flatnonzero((p > 0) & (p < 1))
        left = left[np.argsort(draws(seeds[left], round_ + 1_000_000), kind="stable")]
        round_ += 1
    return p


def landing(p: np.ndarray, size: np.ndarray, seeds: np.ndarray, due: float) -> np.ndarray:
    """0 or 1 for at most two probabilities, each with its own expectation; due: the tokens still to take."""
    n = len(p)
    if n == 0:
        return p
    u = draws(seeds[:1], 77)[0]
    if n == 1:
        return np.array([1.0 if u < p[0] else 0.0])
    low, high = max(0.0, p[0] + p[1] - 1), min(p[0], p[1])

    def odds(both: float) -> list[tuple[float, tuple[float, float]]]:
        return [(both, (1.0, 1.0)), (p[0] - both, (1.0, 0.0)), (p[1] - both, (0.0, 1.0)), (1 - p[0] - p[1] + both, (0.0, 0.0))]

    def cost(both: float) -> float:
        return sum(w * abs(a * size[0] + b * size[1] - due) for w, (a, b) in odds(both))

    chosen = odds(min((low, high), key=cost))
    for w, pair in chosen:
        if u < w:
            return np.array(pair)
        u -= w
    return np.array(max(chosen)[1])


def _fly(last: bool):
    """For the rows of one (source, block), in whatever order they come."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["seed", "size", "doc_id"], kind="stable", na_position="last").reset_index(drop=True)
        seeds = rows["seed"].to_numpy().astype(np.int64).view(np.uint64)
        size = rows["size"].to_numpy()
        p = flight(rows["p"].to_numpy(), size, seeds)
        if last:
            open_ = np.flatnonzero((p > 0) & (p < 1))
            due = float((p[open_] * size[open_]).sum())
            p[open_] = landing(p[open_], size[open_], seeds[open_], due)
        rows["p"] = p
        return rows

    return run


def _blocks(df: DataFrame, block: int) -> DataFrame:
    """df with block: a number below the count of blocks that its source needs."""
    counts = stored(df.groupBy("source").agg(F.ceil(F.count("*") / block).alias("blocks")))
    c = small(counts.withColumnRenamed("source", "of"))
    return df.join(c, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", F.pmod("seed", F.col("blocks"))).drop("of", "blocks")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, every: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, source, seed and check (hashes of the row; of all its columns, if
    every is set), size, source_size, target and copies, how often the mix takes the document."""
    named = [F.col(quoted(c)).alias(n) for c, n in ((id_col, "doc_id"), (source_col, "source"), (text_col, "text"))]
    sized = sizes(docs.select(*named, *[h.alias(n) for h, n in zip(_seeds(docs, id_col, text_col, source_col, every), ("seed", "check"))]))
    sized = stored(sized.drop("text"))
    params = small(stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))).withColumnRenamed("source", "of")
    rows = sized.join(params, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    times = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(times + NEAR).cast("int")).withColumn("p", F.greatest(times - F.col("whole"), F.lit(0.0)))
    open_ = (F.col("p") > NEAR) & (F.col("p") < 1 - NEAR)
    done = [rows.where(~open_)]
    left = rows.where(open_)
    while True:
        left = _blocks(left, block)
        more = not left.where("block > 0").isEmpty()
        flown = stored(left.groupBy("source", "block").applyInPandas(_fly(last=not more), left.schema).drop("block"))
        if not more:
            done.append(flown)
            break
        done.append(flown.where(~open_))
        left = flown.where(open_)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.withColumn("copies", F.col("whole") + F.round("p").cast("int")).drop("whole", "p")


def _seeds(docs: DataFrame, id_col: str, text_col: str, source_col: str, every: bool) -> tuple[Column, Column]:
    if every:
        return row_hash(docs), row_hash(docs, 1)
    of = [F.col(quoted(c)) for c in (id_col, source_col, text_col)]
    return F.xxhash64(*of), F.xxhash64(F.lit(1), *of)


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs, each row as often as the mix takes it."""
    seed, check, of, and_, times, copy = fresh(docs.columns, "seed", "check", "of", "and", "times", "copy")
    mixed = mix(docs, id_col, text_col, source_col, every=True, **how).groupBy("seed", "check").agg(F.sum("copies").alias(times), F.count("*").alias("rows"))
    mixed = stored(mixed.where(F.col(times) > 0).select(F.col("seed").alias(of), F.col("check").alias(and_), times, "rows"))
    same = (F.col(seed) == F.col(of)) & (F.col(check) == F.col(and_))
    keyed = docs.withColumns(dict(zip((seed, check), _seeds(docs, id_col, text_col, source_col, True))))
    out = keyed.join(small(mixed.where("rows = 1").drop("rows")), same)
    again = mixed.where("rows > 1").drop("rows")
    if not again.isEmpty():  # rows that repeat, in all columns, share what they are taken together
        out = out.unionByName(keyed.join(small(stored(again)), same).dropDuplicates([seed, check]))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(columns(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
