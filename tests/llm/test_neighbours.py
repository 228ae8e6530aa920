import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, id string, v string"


def brute(rows, k=10, asked=lambda i: i % 100 == 0):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v):
            good.setdefault(i, []).append(np.array(v, dtype=np.float32).astype(np.float64))
    out = {}
    for i, vs in good.items():
        if asked(i):
            near = sorted((min(float(np.sqrt(((a - b) ** 2).sum())) for a in vs for b in w), j) for j, w in good.items() if j != i)
            out[i] = near[:k]
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6)], "x", None) for i in range(420)]
    rows += [(500, None, None, None), (600, [0.0] * 6, None, None), (700, [float("nan")] + [1.0] * 5, None, None), (701, [float("inf")] + [1.0] * 5, None, None), (None, [1.0] * 6, None, None), (800, [1.0, None, 1.0, 1.0, 1.0, 1.0], None, None), (900, [1.0, 2.0], None, None), (5, rows[5][1], None, None)]
    got = neighbours.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = brute([r for r in rows if r[1] is None or len(r[1]) == 6])
    assert {q: [j for _, j in n] for q, n in found.items()} == {q: [j for _, j in n] for q, n in want.items()}
    assert all(a == pytest.approx(b, abs=1e-12) for q in want for (a, _), (b, _) in zip(found[q], want[q]))


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_recall(spark, spread):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((10, 64)) * spread
    x = rng.standard_normal((6_000, 64)) + centres[rng.integers(0, 10, 6_000)]
    rows = [(i, v.tolist(), None, None) for i, v in enumerate(x)]
    got = neighbours.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0, bin_rows=500).collect()
    x = x.astype(np.float32).astype(np.float64)
    hits = 0
    for q in range(0, 6_000, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len({int(j) for j in np.argsort(d)[:10]} & {r.vec_id for r in got if r.query_id == q})
    assert hits / 600 >= 0.9 and len(got) == 600


def test_hilbert_visits_neighbours():
    for k, bits in ((2, 4), (3, 3)):
        places = np.stack(np.meshgrid(*[np.arange(1 << bits)] * k, indexing="ij"), axis=-1).reshape(-1, k)
        key = neighbours.hilbert(places, bits)
        assert sorted(key.tolist()) == list(range(1 << bits * k))
        assert (np.abs(np.diff(places[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_one_vector_repeated(spark):
    rows = [(i, [1.0, 2.0, 3.0], None, None) for i in range(3_000)]
    got = neighbours.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 100).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 0.0) for i in range(10)]


def test_empty(spark):
    assert neighbours.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0
