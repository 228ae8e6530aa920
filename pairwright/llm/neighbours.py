"""Approximate nearest neighbours by shifted space-filling curves.

Each ordering projects the vectors to a few random directions, shifts and quantises them, and sorts by the
place on a Hilbert curve through that grid. Spark partitions the rows of each ordering by ranges of that key and sorts them,
which gives every row its rank; ``bin_rows`` successive ranks are a bin. A query looks at its own bin and
``reach`` bins on either side, in every ordering, and the best of all windows are merged and reranked by their exact distance.

A window is a number of rows, whatever the size of the table: the work grows with the queries, not with
queries times rows. How much of it is found depends on the vectors: neighbours that are near in
a few directions keep their places close; vectors without any structure, as random ones are, have no nearer
neighbourhood to find, and there recall follows from the share of the rows that the windows cover (README).

Equal vectors are one candidate until the end, with their ``k + 1`` smallest ids, and one query, however often they repeat: so no bin
is larger than ``bin_rows``, no vector takes a window for itself, and nothing is capped. Where a single
window covers all rows, the other orderings would compare the same pairs again and are left out.

Defined results: vectors that are null, zero, or hold null, NaN or infinite components, and rows with a null
id, take no part; vectors of different lengths are no neighbours; rows with one id are one candidate, the
nearest of them; a query's own id is no candidate for it; of two at one distance the smaller id comes first;
columns of other names have no effect; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.llm.common import HOT_ROWS, join_groups, quoted, released, small, stored, table

ORDERINGS = 8
DIMENSIONS = 6
BITS = 10
BIN = 2_000
REACH = 2
SAMPLE = 4_096


def hilbert(places: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of whole numbers below 2**bits.

    From the highest bit down, each axis's bit decides whether the first axis is reflected or exchanged in
    the lower bits; Gray decoding of what is left gives the digits of the key, interleaved.
    """
    x = [c.astype(np.int64) for c in places.T]
    for b in range(bits - 1, 0, -1):
        lower = (1 << b) - 1
        for i in range(len(x)):
            one = (x[i] >> b) & 1 == 1
            swap = np.where(one, 0, (x[0] ^ x[i]) & lower)
            x[0] = np.where(one, x[0] ^ lower, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    key = np.zeros(len(places), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | ((c ^ flip) >> b & 1)
    return key


class Curves:
    """The orderings: directions, shifts and the ranges of a sample's projections."""

    def __init__(self, sample: np.ndarray, orderings: int = ORDERINGS, dimensions: int = DIMENSIONS, seed: int = 7):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.k = min(dimensions, dim)
        self.ways = [np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, : self.k] for _ in range(orderings)]
        seen = [sample @ w for w in self.ways]
        self.low = [p.min(axis=0) for p in seen]
        self.width = [np.maximum(p.max(axis=0) - p.min(axis=0), 1e-12) for p in seen]
        self.shift = rng.random((orderings, self.k))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(rows, orderings): the key of each row in each ordering."""
        top = (1 << BITS) - 1
        found = []
        for w, low, width, shift in zip(self.ways, self.low, self.width, self.shift):
            at = ((x @ w - low) / width + shift) / 2
            found.append(hilbert(np.clip(at * top, 0, top).astype(np.int64), BITS))
        return np.stack(found, axis=1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vector: Column) -> Column:
    """True for a vector of finite components, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _nearest(wide: int, dim: int):
    """For the candidates (c, v) and the queries (q, w) of one bin: each query's ``wide`` nearest, itself included."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if rows.num_rows and asked.num_rows:
            c, ids = _matrix(rows.column("v"), dim), rows.column("c").to_numpy()
            norms = (c * c).sum(axis=1)
            every, names = _matrix(asked.column("w"), dim), asked.column("q").to_numpy()
            for at in range(0, len(every), 256):
                q = every[at : at + 256]
                squares = (q * q).sum(axis=1)
                near = squares[:, None] - 2 * q @ c.T + norms[None]
                slack = 1e-10 * (squares + norms.max())
                for i, one in enumerate(q):
                    best = np.arange(len(ids))
                    if len(ids) > wide:
                        best = np.flatnonzero(near[i] <= np.partition(near[i], wide - 1)[wide - 1] + slack[i])
                    d = np.sqrt(np.cumsum((c[best] - one) ** 2, axis=1)[:, -1])  # summed in the order of the components
                    if len(best) > wide:  # of those as near as the last one all stay: ids decide between them
                        keep = d <= np.partition(d, wide - 1)[wide - 1]
                        best, d = best[keep], d[keep]
                    for x, y in zip(out, (np.full(len(best), names[at + i]), ids[best], d)):
                        x.append(y)
        flat = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"q": pa.array(flat[0].astype(np.int64)), "c": pa.array(flat[1].astype(np.int64)), "score": pa.array(flat[2].astype(np.float64))})

    return run


def _ranked(before: dict[tuple[int, int], int], bin_rows: int):
    """Over the sorted rows of a partition: the bin of each row in its ordering."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in batches:
            part, o = (b.column(i).to_numpy() for i in (0, 1))
            rank = np.empty(len(o), dtype=np.int64)
            for one in np.unique(o).tolist():
                at = np.flatnonzero(o == one)
                first = seen.setdefault(one, before[int(part[0]), one])
                rank[at] = np.arange(first, first + len(at))
                seen[one] = first + len(at)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(rank // bin_rows)], names=["o", "c", "v", "asked", "bin"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", orderings: int = ORDERINGS, dimensions: int = DIMENSIONS, reach: int = REACH, bin_rows: int = BIN) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of vectors for which is_query holds.

    The curves are fitted to some SAMPLE vectors with the smallest hashes; every row is indexed.
    """
    id_, vector = F.col(quoted(id_col)), F.col(quoted(vector_col))
    good = vectors.where(id_.isNotNull() & usable(vector)).select(id_.cast("long").alias("id"), vector.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    good = good.withColumn("key", F.struct(F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")))
    out = None
    for r in good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").collect():  # lengths are few
        found = _search(good.where(F.size("v") == r["dim"]), r["dim"], k, orderings, dimensions, reach, bin_rows)
        out = found if out is None else out.unionByName(found)
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _search(good: DataFrame, dim: int, k: int, orderings: int, dimensions: int, reach: int, bin_rows: int) -> DataFrame:
    members = stored(good.groupBy("key", "id").agg(F.max("asked").alias("asked")))
    smallest = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    heads = members.select("key", "id", smallest.alias("n")).where(F.col("n") <= k + 1).groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = stored(good.groupBy("key").agg(F.first("v").alias("v"), F.max("asked").alias("asked")))
    classes = classes.withColumn("c", F.monotonically_increasing_id())  # of stored rows: always the same
    count = classes.count()
    most = members.groupBy("id").count().agg(F.max("count")).first()[0]
    wide = (k + 1) * most  # as many vectors hold k + 1 different ids
    low = F.xxhash64("v").cast("double") <= -(2.0**63) + min(1.0, (SAMPLE + 8 * math.sqrt(SAMPLE) + 100) / count) * 2.0**64
    sample = classes.where(low).select("v", "key").orderBy("key").limit(SAMPLE).collect()  # hardly more than SAMPLE rows
    if count <= bin_rows * (reach + 1):
        orderings = 1
    curves = Curves(np.array([r.v for r in sample], dtype=np.float64), orderings, dimensions)
    kind = dict(classes.dtypes)["v"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2_000):
                part = b.slice(i, 2_000)
                keys = pa.FixedSizeListArray.from_arrays(pa.array(curves.keys(_matrix(part.column(1), dim)).ravel()), orderings).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, keys], names=["c", "v", "asked", "keys"])

    keyed = classes.select("c", "v", "asked").mapInArrow(released(index), f"c long, v {kind}, asked boolean, keys array<long>")
    spread = keyed.select("c", "v", "asked", F.posexplode("keys").alias("o", "place"))
    spread = stored(spread.repartitionByRange("o", "place", "c").sortWithinPartitions("o", "place", "c").drop("place"))
    counts = sorted(tuple(r) for r in spread.groupBy(F.spark_partition_id().alias("part"), "o").count().collect())  # a row a partition, or few
    before, so_far = {}, {}
    for part, o, n in counts:
        before[part, o] = so_far.get(o, 0)
        so_far[o] = so_far.get(o, 0) + n
    placed = spread.select(F.spark_partition_id().alias("part"), "o", "c", "v", "asked").mapInArrow(released(_ranked(before, bin_rows)), f"o int, c long, v {kind}, asked boolean, bin long")
    placed = stored(placed)
    last = (count - 1) // bin_rows
    around = F.sequence(F.greatest(F.col("bin") - reach, F.lit(0)), F.least(F.col("bin") + reach, F.lit(last)))
    asked = placed.where("asked").select("o", F.col("c").alias("q"), F.col("v").alias("w"), F.explode(around).alias("bin"))
    by = ["o", "bin"]
    found = placed.select("o", "bin", "c", "v").groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(_nearest(wide, dim), "q long, c long, score double")
    found = found.groupBy("q", "c").agg(F.min("score").alias("score"))
    named = classes.select("c", "key").join(heads, "key").select("c", F.explode("ids").alias("id"))
    ids = found.join(named, "c").groupBy("q", "id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))
    best = ids.withColumn("n", rank).where(F.col("n") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("best"))
    best = best.join(classes.select(F.col("c").alias("q"), "key"), "q").select("key", "best")
    queries = members.where("asked").select("key", F.col("id").alias("query_id"))
    hot = stored(queries.groupBy("key").count().where(F.col("count") > HOT_ROWS).select("key"))
    others = join_groups(queries, best, "key", hot).withColumn("best", F.filter("best", lambda x: x["id"] != F.col("query_id")))
    if most > 1:  # a query with several vectors: the nearest to any of them
        each = others.select("query_id", F.explode("best").alias("x")).groupBy("query_id", F.col("x.id").alias("id")).agg(F.min("x.score").alias("score"))
        others = each.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("best"))
    ranked = others.select("query_id", F.posexplode(F.slice("best", 1, k)).alias("place", "x"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


#: All pairs of a query and a candidate. The windows of op5 cover tables of up to BIN * (REACH + 1) vectors
#: whole; on larger ones op5 may find other neighbours than the nearest.
SQL = """
WITH good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), near AS (
  SELECT q.vec_id AS query_id, c.vec_id, min(sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, b: a + b))) AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v) GROUP BY ALL
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM near) WHERE rank <= 10
"""
