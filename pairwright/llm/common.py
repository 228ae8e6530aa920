"""What several operators share: stored intermediate results, Arrow helpers, checked broadcasts."""

from __future__ import annotations

import ctypes
import sys
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: Rows, and bytes of their cells, up to which a small side of a join is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the session names in spark.checkpoint.dir. Only a
    local session without one (tests, a laptop) gets a temporary folder; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pairwright-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate results, on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows and bytes, else as it is. df should be stored."""
    wide = [f.name for f in df.schema if isinstance(f.dataType, (StringType, BinaryType, ArrayType, MapType, StructType))]
    size = F.lit(8 * len(df.columns))
    if wide:
        size = size + F.length(F.to_json(F.struct(*[F.col(quoted(c)) for c in wide])))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found["n"] <= rows and found["bytes"] <= most else df


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def columns(names: list[str]) -> list[Column]:
    return [F.col(quoted(c)) for c in names]


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores in front until no column has them."""
    low, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in low:
            name = "_" + name
        low.add(name.lower())
        out.append(name)
    return out


def schema_of(df: DataFrame, names: list[str], *more: str) -> str:
    """DDL of the named columns of df, and of more."""
    kinds = dict(df.dtypes)
    return ", ".join([*(f"{quoted(c)} {kinds[c]}" for c in names), *more])


#: Rows of one key from which on a join leaves them where they are.
HOT_ROWS = 1_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """rows joined to groups (one row a key) on key. hot: the keys with more than HOT_ROWS rows, stored. Their
    groups are broadcast, if their number allows it, so that no task gets all the rows of one key."""
    if hot.isEmpty():
        return rows.join(groups, key)
    keys = small(hot)
    few = small(stored(groups.join(keys, key, "left_semi")))
    return rows.join(keys, key, "left_anti").join(groups, key).unionByName(rows.join(few, key))


#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1_000


def text_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold BATCH_ROWS rows at most: with texts of some kilobytes the
    default of 10,000 takes tens of megabytes for each task, on both sides of the pipe to Python."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df


def give_back() -> None:
    """Returns the memory that a task of a worker has freed to the system; workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def held(owner: str) -> dict:
    """What a worker keeps for an operator from task to task; what it kept for another one goes."""
    every = sys.__dict__.setdefault("_pairwright_held", {})
    if every.keys() - {owner}:
        mine = every.get(owner, {})
        every.clear()
        every[owner] = mine
        give_back()
    return every.setdefault(owner, {})


def released(run, owner: str = ""):
    """run, a function of batches of an operator, that gives memory back in the end. What the worker keeps for
    other operators goes before."""

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(owner)
        yield from run(batches)
        give_back()

    return all_of


def in_arrow(df: DataFrame, run, schema, owner: str = "") -> DataFrame:
    """df.mapInArrow, whatever the names of df's columns; the batches' columns go by place."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(released(run, owner), schema)


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """A hash of all columns of a row."""
    plain = lambda f: F.to_json(F.col(quoted(f.name))) if "map<" in f.dataType.simpleString() else F.col(quoted(f.name))
    return F.xxhash64(F.lit(seed), *map(plain, df.schema.fields))


def utf8(column: str | Column) -> Column:
    """The text as bytes, null as no bytes."""
    c = F.col(quoted(column)) if isinstance(column, str) else column
    return F.coalesce(c.cast("binary"), F.lit(b""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary_views(column: pa.Array) -> tuple[memoryview, list[int]]:
    """The bytes of a binary column without nulls, and the offsets of its values in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type):
        wide = np.int64
    else:
        wide = np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=wide)[column.offset : column.offset + len(column) + 1]
    return memoryview(data if data is not None else b""), ends.tolist()


def texts(column: pa.Array) -> Iterator[bytes]:
    """Each value of a binary column as bytes; null as no bytes."""
    for x in column:
        yield x.as_py() or b""


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes starts[0], starts[0]+1, ... of all pieces, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)
