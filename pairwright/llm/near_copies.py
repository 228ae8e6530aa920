"""Near copies by word-shingle similarity, for filtering: SimHash links, and blocks that reach further.

Fingerprints of the texts' 5-word shingles are linked by pigeonhole blocks, as in ``simhash``, and what these
links join is verified by the exact similarity of the shingle sets. But texts whose sets overlap by 0.8
(Jaccard) differ in 7 to 18 of 64 SimHash bits, mostly, and blocks that find pairs within 3 bits see a tenth
of them. So texts are filed in blocks of a second kind, too: each is a mix of the shingles that are smallest under ``ROWS``
hash functions, which similar texts choose alike, and ``BANDS`` such blocks let a pair of 0.8 pass with a
chance of one in 1,500 to miss all. Pairs that share a block are verified twice: by the least difference that
the parities of their shingle sets leave open, which is cheap and turns away no pair that is similar, and by
the exact similarity of the sets.

Equal texts are one class from the start. Every pair of texts that share a block is verified, or in one group
already. Blocks of ``REACH + 1`` texts or less are whole in one task. In larger ones what the SimHash links, and those
to the ``REACH`` texts before in order of size, have joined is one group, and every text then meets those of all other groups: the block is cut into parts of
``PART`` texts or so, a group that is larger than a part into parts of its own, and each two parts that can
hold texts of different groups are a task's work, counted by bit maps of their common shingles. So a large
group of near copies costs no square of its size, and neither partitions nor their number change what is
linked.

Texts are known by 128 bits of hashes, rows by 128 bits of id and text. Of each group of texts that links
join, the row with the smallest id stays. Defined results: a null text counts as empty; texts without words
are one group; texts of fewer words than a shingle are their own only shingle; texts of any length are read
whole; null ids come last; of rows that repeat id and text one stays, that with the smallest hash of all
columns; other columns, of any name, are left alone; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm import simhash
from pairwright.llm.common import HOT_ROWS, columns, fresh, join_groups, quoted, released, row_hash, small, stored, text_batches, texts, utf8
from pairwright.llm.components import components
from pairwright.llm.simhash import shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 4
REACH = 12
PART = 128

_rng = np.random.default_rng(11)
FACTORS = _rng.integers(1, 1 << 63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64)


def bands(hashes: np.ndarray, chunk: int = 4_096) -> np.ndarray:
    """A block key for each band: a mix of the shingles that are smallest under each of its functions."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), chunk):
        part = hashes[i : i + chunk]
        part = part ^ (part >> np.uint64(32))
        least = np.minimum(least, (part[:, None] * FACTORS[None] + SHIFTS[None]).min(axis=0))
    keys = np.zeros(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def parity(hashes: np.ndarray) -> np.uint64:
    """Bit k: whether an odd number of the hashes end in k. Sets differ by at least as many members as bits."""
    return np.bitwise_xor.reduce(np.uint64(1) << (hashes & np.uint64(63)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The share of common ones among all different ones; 1 for two empty sets. Both sorted, without repeats."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, fps, sizes, keys = [], [], [], []
            for t in texts(b.column(5)):
                once = np.unique(shingle_hashes(t, shingle))
                prints.append(simhash.fingerprint(once))
                fps.append(parity(once))
                sizes.append(len(once))
                keys.append(bands(once))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            blocks = pa.FixedSizeListArray.from_arrays(pa.array(flat.view(np.int64)), BANDS).cast(pa.list_(pa.int64()))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], signed(prints), signed(fps), pa.array(sizes, pa.int32()), blocks], names=["k1", "k2", "id", "class", "check", "print", "fp", "n", "blocks"])

    return released(run)


def _pairs(least: float):
    """Over rows sorted by (band, block, n, class): pairs within REACH of each other in one block that may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            now = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]
            skip = len(held[0]) if held else 0
            now = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            band, block, n, cls, fp = now
            bits = fp.view(np.uint64)
            left, right = [], []
            for lag in range(1, min(REACH, len(cls) - 1) + 1):
                same = (band[lag:] == band[:-lag]) & (block[lag:] == block[:-lag])
                same[: max(0, skip - lag)] = False  # met before
                same &= n[:-lag] >= least * n[lag:]
                at = np.flatnonzero(same)
                differ = (n[at] + n[at + lag]) * (1 - least) / (1 + least) + 1e-6
                at = at[np.bitwise_count(bits[at] ^ bits[at + lag]) <= differ]
                left.append(cls[at])
                right.append(cls[at + lag])
            if left:
                a, c = np.concatenate(left), np.concatenate(right)
                both = np.unique(np.stack([np.minimum(a, c), np.maximum(a, c)]), axis=1)
                if both.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])
            held = [x[-REACH:] for x in now]

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique((h ^ (h >> np.uint64(32))).astype(np.uint32)).tobytes() for h in (shingle_hashes(t, shingle) for t in texts(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["class", "set"])

    return released(run)


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) >= least for x, y in zip(texts(b.column(2)), texts(b.column(3)))]
            keep = b.filter(pa.array(ok, pa.bool_()))
            yield keep.select(["a", "b"])

    return released(run)


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """How many members each set of a has in common with each of b, or of a if b is None."""
    every = a + (b or [])
    owner = np.repeat(np.arange(len(every)), [len(x) for x in every])
    _, column, times = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    use = times[column] > 1
    owner, column = owner[use], shared[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(a), len(b if b is not None else a)), np.int64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 64):
        i, j = np.searchsorted(column, (low, low + 64))
        has = np.zeros(len(every), np.uint64)
        np.bitwise_or.at(has, owner[i:j], np.uint64(1) << (column[i:j] - low).astype(np.uint64))
        out += np.bitwise_count(has[: len(a), None] & (has[len(a) :] if b is not None else has)[None])
    if b is None:
        np.fill_diagonal(out, [len(x) for x in a])
    return out


def forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs that join all that the pairs join, without circles."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    found = []
    for a, b in pairs.tolist():
        x, y = top(a), top(b)
        if x != y:
            above[x] = y
            found.append((a, b))
    return found


def _tile(least: float):
    """Over the rows of two parts (or of one): links between the groups of texts that are similar."""

    def run(rows: pa.Table) -> pa.Table:
        side = rows.column("side").to_numpy()
        root = rows.column("root").to_numpy()
        sets = [np.frombuffer(x, np.uint32) for x in texts(rows.column("set"))]
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        two = len(x) and len(y)
        common = overlaps([sets[i] for i in x], [sets[i] for i in y]) if two else overlaps(sets, None)
        x, y = (x, y) if two else (np.arange(len(sets)), np.arange(len(sets)))
        n = np.array([len(s) for s in sets])
        every = n[x][:, None] + n[y][None] - common
        near = (common / np.maximum(every, 1) >= least) | (every == 0)
        i, j = np.nonzero(near & (root[x][:, None] != root[y][None]))
        a, b = root[x[i]], root[y[j]]
        links = forest(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0))
        return pa.table({"a": pa.array([u for u, _ in links], pa.int64()), "b": pa.array([v for _, v in links], pa.int64())})

    return run


def between_groups(members: DataFrame, sets: DataFrame, least: float, part: int = PART) -> DataFrame:
    """a, b: links between the groups of members (band, block, class, root) for each two texts of one block
    and different groups that are similar."""
    block = ["band", "block"]
    sizes = stored(members.groupBy(*block, "root").agg(F.count("*").alias("size")))
    several = sizes.groupBy(*block).agg(F.count("*").alias("roots")).where("roots > 1").select(*block)
    own = F.when(F.col("size") > part, F.col("root"))  # null: with other small groups
    heaps = sizes.join(several, block, "left_semi").withColumn("own", own).groupBy(*block, "own").agg(F.ceil(F.sum("size") / part).alias("parts"))
    heaps = stored(heaps.withColumn("heap", F.xxhash64(F.col("own").isNull(), F.coalesce("own", F.lit(0)))))
    parts = heaps.select(*block, "own", "heap", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    x, y = (parts.select(*block, F.col("own").alias(f"own_{s}"), F.struct("heap", "part").alias(s)) for s in "xy")
    tiles = stored(x.join(y, block).where("x <= y and (own_x is null or own_y is null or own_x <> own_y)").select(*block, "x", "y"))
    here = lambda s, k: F.struct(F.col(f"{s}.heap").alias("heap"), F.col(f"{s}.part").alias("part"), F.lit(k).alias("side"))
    both = F.when(F.col("x") == F.col("y"), F.array(here("x", 0))).otherwise(F.array(here("x", 0), here("y", 1)))
    sides = tiles.select(*block, "x", "y", F.explode(both).alias("at")).select(*block, "x", "y", "at.heap", "at.part", "at.side")
    placed = members.join(small(sizes.where(F.col("size") > part)).select(*block, "root", F.col("root").alias("own")), [*block, "root"], "left")
    placed = placed.withColumn("heap", F.xxhash64(F.col("own").isNull(), F.coalesce("own", F.lit(0)))).drop("own")
    placed = placed.join(small(heaps.select(*block, "heap", "parts")), [*block, "heap"]).withColumn("part", F.pmod(F.xxhash64("class"), "parts"))
    dealt = placed.join(small(stored(sides)), [*block, "heap", "part"]).select(*block, "x", "y", "side", "class", "root").join(sets, "class")
    return dealt.groupBy(*block, "x", "y").applyInArrow(_tile(least), "a long, b long")


def _told_apart(prints: DataFrame) -> DataFrame:
    """prints, with other class numbers for different texts that share one."""
    twice = stored(prints.groupBy("class").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("class"))
    if twice.isEmpty():
        return prints
    own = prints.join(small(twice.withColumn("shared", F.lit(True))), "class", "left")
    return stored(own.withColumn("class", F.when(F.col("shared"), F.xxhash64("class", "check")).otherwise(F.col("class"))).drop("shared"))


def fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """a, b: classes whose fingerprints (column print) are equal or linked."""
    alike = stored(classes.groupBy("print").agg(F.min("class").alias("rep"), F.count("*").alias("members")))
    hot = stored(alike.where(F.col("members") > HOT_ROWS).select("print"))
    same = join_groups(classes.select("print", "class"), alike.select("print", "rep"), "print", hot).where("class <> rep").select(F.col("rep").alias("a"), F.col("class").alias("b"))
    links = simhash.links(alike.select(F.col("print").alias("fp")))
    for side in "ab":
        links = links.join(alike.select(F.col("print").alias(side), F.col("rep").alias(f"rep_{side}")), side)
    return same.union(links.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay: one of each group of near copies."""
    text, id_ = utf8(text_col), F.col(quoted(id_col))
    cls, check = F.xxhash64(text, F.length(text)), F.xxhash64(F.lit(1), text)
    keys = F.xxhash64(id_, cls), F.xxhash64(F.lit(1), id_, check)
    kind = dict(docs.dtypes)[id_col]
    rows = text_batches(docs).select(keys[0].alias("k1"), keys[1].alias("k2"), id_.alias("id"), cls.alias("class"), check.alias("check"), text.alias("t"))
    prints = stored(rows.mapInArrow(_prints(shingle), f"k1 long, k2 long, id {kind}, class long, check long, print long, fp long, n int, blocks array<long>"))
    prints = _told_apart(prints)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("first")
    classes = stored(prints.groupBy("class").agg(first, *[F.min(c).alias(c) for c in ("print", "fp", "n", "blocks")], F.count("*").alias("rows")))
    filed = classes.select(F.posexplode("blocks").alias("band", "block"), F.col("n").cast("long").alias("n"), "class", "fp")
    crowded = small(stored(filed.groupBy("band", "block").count().where(F.col("count") > REACH + 1).select("band", "block")))
    order = ["band", "block", "n", "class"]
    whole = filed.join(crowded, order[:2], "left_anti").repartition("band", "block").sortWithinPartitions(*order)
    crowd = stored(filed.join(crowded, order[:2], "left_semi"))
    cut = crowd.repartitionByRange(*order).sortWithinPartitions(*order)
    near = [x.select("band", "block", "n", "class", "fp").mapInArrow(_pairs(least), "a long, b long") for x in (whole, cut)]
    pairs = stored(near[0].union(near[1]).union(fingerprint_pairs(classes)).distinct())
    asked = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).union(crowd.select("class")).distinct()
    one = small(stored(classes.join(asked, "class").select("class", "first.k1", "first.k2")))
    sets = stored(rows.drop("class").join(one, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("class", "t").mapInArrow(_sets(shingle), "class long, set binary"))
    with_a = pairs.join(sets.select(F.col("class").alias("a"), F.col("set").alias("x")), "a")
    with_b = with_a.join(sets.select(F.col("class").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    roots = components(with_b.mapInArrow(_verified(least), "a long, b long")).withColumnRenamed("node", "class")
    members = stored(crowd.select("band", "block", "class").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")))
    more = stored(between_groups(members, sets, least))
    grouped = classes.select("class", "first").join(roots, "class", "left").select("class", "first", F.coalesce("root", "class").alias("root"))
    if not more.isEmpty():
        further = small(stored(components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))))
        grouped = grouped.join(further, "root", "left").select("class", "first", F.coalesce("top", "root").alias("root"))
    stays = grouped.groupBy("root").agg(F.min("first").alias("stays"))
    of = grouped.join(stays, "root").select("class", F.col("stays.k1").alias("s1"), F.col("stays.k2").alias("s2"))
    hot = stored(classes.where(F.col("rows") > HOT_ROWS).select("class"))
    kept = join_groups(prints.select("k1", "k2", "class"), of, "class", hot).withColumn("stay", (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")))
    a, b, c, d = fresh(docs.columns, "k1", "k2", "o1", "o2")
    key = lambda df: df.select(F.col("k1").alias(c), F.col("k2").alias(d))
    on = (F.col(a) == F.col(c)) & (F.col(b) == F.col(d))
    gone = small(stored(key(kept.where(~F.col("stay"))).distinct()))
    left = docs.withColumns({a: keys[0], b: keys[1]}).join(gone, on, "left_anti")
    again = stored(key(kept.where("stay").groupBy("k1", "k2").count().where("count > 1")))
    if again.isEmpty():
        return left.select(columns(docs.columns))
    again = small(again)
    row = F.min_by(F.struct(*columns(docs.columns)), row_hash(docs)).alias("row")
    several = left.join(again, on, "left_semi").groupBy(a, b).agg(row).select("row.*")
    return left.join(again, on, "left_anti").select(columns(docs.columns)).unionByName(several)
