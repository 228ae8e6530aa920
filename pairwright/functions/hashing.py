"""FNV-1a of 64 bits over UTF-8, as a pandas UDF: all texts of a batch advance byte by byte together."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(values: list[bytes]) -> np.ndarray:
    out = np.full(len(values), OFFSET, dtype=np.uint64)
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(values), dtype=np.uint8)
    starts = np.cumsum(sizes) - sizes
    live = order
    with np.errstate(over="ignore"):
        for j in range(int(sizes.max(initial=0))):
            live = live[: int(np.searchsorted(-sizes[live], -j, side="left"))]
            out[live] = (out[live] ^ data[starts[live] + j]) * np.uint64(PRIME)
    return out


def hash_order(text: Column) -> Column:
    """A long that sorts as the unsigned hash of the text does."""

    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        h = fnv1a([(t or "").encode() for t in texts])
        return pd.Series((h ^ np.uint64(1 << 63)).view(np.int64))

    return udf(text)
