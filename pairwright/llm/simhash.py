"""SimHash near-dedup: fingerprints, pigeonhole blocks, verified links, connected components.

A fingerprint has 64 bits. Two that differ in at most three of six blocks agree in three whole
blocks, so each fingerprint is filed under every choice of three blocks (20 keys of 32 bits or so)
and only fingerprints that share a key are compared. A key that holds more than ``crowd`` different
fingerprints is filed again, by three of six parts of its remaining bits; what then shares a key has
at most 2**17 different members whatever the input, so that no task gets an unbounded group. Within a
key only the links of a spanning forest are kept, at most one less than its members.

Equal fingerprints are one class from the start; copies are never expanded to pairs.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links as
any other; a text of any length is read whole; rows that repeat stay as rows, with one class; a null id takes
no part in the smallest id; columns of other names have no effect; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.common import HOT_ROWS, join_groups, quoted, released, small, stored, table, text_batches, texts, utf8
from pairwright.llm.components import components

BITS = 64
SEED = 42


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, lower case, joined by a space; of all words if fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.append(gaps, len(line))
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[i:j], SEED) for i, j in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], dtype=np.uint64)


def fingerprint(hashes: np.ndarray, chunk: int = 65_536) -> np.uint64:
    """Each bit is set if over half of the hashes have it."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), chunk):
        part = hashes[i : i + chunk].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id, fp (the 64 bits as a signed long) for each row of docs."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(shingle_hashes(t, shingle)) for t in texts(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return text_batches(docs).select(F.col(quoted(id_col)).alias("id"), utf8(text_col).alias("t")).mapInArrow(released(run), f"id {kind}, fp long")


def block_masks(bits: list[int], blocks: int = 6, kept: int = 3) -> list[int]:
    """The bits of every choice of ``kept`` out of ``blocks`` even blocks of the given bits."""
    parts = [sum(1 << x for x in bits[i::blocks]) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, kept)]


MASKS = block_masks(list(range(BITS)))
FINER = [block_masks([i for i in range(BITS) if not m >> i & 1]) for m in MASKS]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest of the different fps that differ in at most ``most`` bits."""
    left = fps[1:]
    front = [fps[0]]
    while len(left) or front:
        if not front:
            front, left = [left[0]], left[1:]
            continue
        one = front.pop()
        if not len(left):
            break
        near = np.bitwise_count(left ^ one) <= most
        if near.any():
            found = left[near]
            yield np.full(len(found), one, dtype=np.uint64), found
            left = left[~near]
            front.extend(found)


def _links(most: int):
    """Over rows (key..., fp) sorted by key: the links within each run of equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            now = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(b.num_columns)]
            held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            n = len(held[0])
            if not n:
                continue
            new = np.zeros(n, dtype=bool)
            for k in held[:-1]:
                new[1:] |= k[1:] != k[:-1]
            starts = np.concatenate(([0], np.flatnonzero(new)))
            done = starts[-1]
            yield from linked(held[-1][:done], starts[:-1], done)
            held = [x[done:] for x in held]
        if held and len(held[0]):
            yield from linked(held[-1], np.zeros(1, dtype=np.int64), len(held[0]))

    def linked(fps: np.ndarray, starts: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
        f = fps.view(np.uint64)
        sizes = np.diff(np.append(starts, end))
        twos = starts[sizes == 2]
        close = np.bitwise_count(f[twos] ^ f[twos + 1]) <= most
        a, b = [f[twos][close]], [f[twos + 1][close]]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            for x, y in forest(np.unique(f[s : s + n]), most):
                a.append(x)
                b.append(y)
        x, y = np.concatenate(a), np.concatenate(b)
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    return run


def links(fps: DataFrame, most: int = 3, crowd: int = 2_000) -> DataFrame:
    """a, b: links between different fingerprints (column fp, each once) that join all that are within
    ``most`` (3 at most) bits of each other, directly or over others."""
    if not 0 <= most <= 3:
        raise ValueError("six blocks find fingerprints that differ in at most 3 bits")
    filed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in MASKS])).alias("t", "k"))
    crowded = stored(filed.groupBy("t", "k").count().where(F.col("count") > crowd).select("t", "k"))
    plain = filed.select("t", "k", "fp")
    found = []
    if not crowded.isEmpty():
        side = small(crowded)
        busy = plain.join(side, ["t", "k"], "left_semi")
        plain = plain.join(side, ["t", "k"], "left_anti")
        finer = F.array(*[F.array(*[F.lit(_signed(m | s)) for s in FINER[t]]) for t, m in enumerate(MASKS)])
        busy = busy.select("t", "fp", F.posexplode(F.transform(finer[F.col("t")], lambda m: F.col("fp").bitwiseAND(m))).alias("s", "k"))
        found.append(busy.repartition("t", "s", "k").sortWithinPartitions("t", "s", "k").select("t", "s", "k", "fp"))
    found.append(plain.repartition("t", "k").sortWithinPartitions("t", "k"))
    out = found[0].mapInArrow(_links(most), "a long, b long")
    for x in found[1:]:
        out = out.union(x.mapInArrow(_links(most), "a long, b long"))
    return out.distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """id, fp, component for each row: the smallest id of all rows that links lead to."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle))
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("rows")))
    roots = components(links(classes.select("fp"), most)).withColumnRenamed("node", "fp")
    joined = classes.join(roots, "fp")
    least = joined.groupBy("root").agg(F.min("first").alias("component"))
    named = joined.select("fp", "root").join(least, "root").select("fp", "component")
    of = classes.join(named, "fp", "left").select("fp", F.coalesce("component", "first").alias("component"))
    hot = stored(classes.where(F.col("rows") > HOT_ROWS).select("fp"))
    return join_groups(prints, of, "fp", hot).select("id", "fp", "component")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(table(spark, sf_dir, "documents"), shingle=3, most=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
