import random

import numpy as np
import pytest

from pairwright.llm import mixing

SCHEMA = "doc_id long, text string, source string, target string"


def brute_targets(sizes):
    """By the rule itself: share out, stop what is above, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    due = 1.5 * sum(sizes.values())
    full, open_ = {}, set(names)
    while open_:
        rest = due - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            return full | share
        full |= {s: 2.0 * sizes[s] for s in above}
        open_ -= above
    return full


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, "w " * max(1, int(rng.lognormvariate(3, 1))), rng.choice(["a", "b", "ö", "c", None]) if i % 3 else "hot", "x") for i in range(3_000)]
    rows += [(5, rows[5][1], rows[5][2], None)] * 3 + [(None, "q r", "a", None), (9001, None, "b", None), (9002, "", "empty", None), (9003, " \t", None, None), (9004, "long " * 4_000, "c", None)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), block=200).collect()
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7), block=200).collect()
    pick = lambda r: (str(r.doc_id), str(r.source), r.size, r.copies)
    assert sorted(map(pick, got)) == sorted(map(pick, again))
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        assert 0 <= r.copies <= 2 or not r.size
    want = brute_targets(sizes)
    for s, t in want.items():
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - t) < 1e-6 * max(1, t) for r in mine)
        assert abs(sum(r.copies * r.size for r in mine) - t) <= 60
        assert abs(sum(r.copies for r in mine if r.size) - sum(t / sizes[s] for r in mine if r.size)) <= 3 if sizes[s] else True


def test_targets_when_all_fill_up(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1), ("c", 5)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df, share=2.0).collect()}
    assert got == pytest.approx({"a": 20.0, "b": 2.0, "c": 10.0})


def test_flight_keeps_totals_and_probabilities():
    rng = np.random.default_rng(1)
    size = np.floor(rng.lognormal(4, 1, 900))
    p = rng.random(900)
    total, tokens = p.sum(), (p * size).sum()
    mean = np.zeros(900)
    for k in range(60):
        out = mixing.flight(p, size, rng.integers(0, 2**63, 900).astype(np.uint64))
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert abs(out.sum() - total) < 1e-5 and abs((out * size).sum() - tokens) < 1e-2
        mean += out / 60
    assert abs((mean - p).mean()) < 1e-6
    assert np.corrcoef(mean, p)[0, 1] > 0.9


def test_flight_of_equal_sizes():
    out = mixing.flight(np.full(10, 0.5), np.full(10, 7), np.arange(10, dtype=np.uint64))
    assert out.sum() == pytest.approx(5) and ((out > 0) & (out < 1)).sum() <= 2


def test_landing_keeps_each_probability():
    p, size = np.array([0.3, 0.6]), np.array([5.0, 9.0])
    got = np.mean([mixing.landing(p, size, np.array([s, s], dtype=np.uint64), 6.9) for s in range(4_000)], axis=0)
    assert abs(got - p).max() < 0.03


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
