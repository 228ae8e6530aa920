import random

import numpy as np

from pairwright.llm import near_copies
from pairwright.llm.simhash import shingle_hashes

SCHEMA = "doc_id long, text string, key string, fp string, n string"


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute(rows):
    """The ids that stay, by all pairs."""
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if (not both) or len(sets[i] & sets[j]) >= 0.8 * both:
                group[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        rank = (r[0] is None, r[0] or 0)
        least[root(i)] = min(least.get(root(i), rank), rank)
    return sorted((i for _, i in least.values()))


def make(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    rows = []
    for g in range(40):
        base = [word() for _ in range(rng.choice([3, 30, 120, 600]))]
        rows.append((len(rows) * 3 % 997, " ".join(base)))
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, len(base) // 150, len(base) // 90, len(base) // 15])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows) * 3 % 997, " ".join(copy)))
    passage = " ".join(word() for _ in range(60))
    rows += [(2_000 + i, passage + " " + " ".join(word() for _ in range(40))) for i in range(60)]
    return rows


def test_stays_equal_brute_force(spark):
    for seed in (1, 2):
        rows = make(seed) + [(5_000, None), (5_001, ""), (5_002, " \n"), (5_003, "one"), (5_004, "One"), (None, "alone here"), (5_005, "x " * 60_000)]
        df = spark.createDataFrame([(*r, "k", None, "n") for r in rows], SCHEMA)
        got = near_copies.drop_near_copies(df)
        assert got.columns == df.columns
        assert sorted((r.doc_id for r in got.collect()), key=str) == sorted((i if not none else None for none, i in [(x is None, x) for x in brute_ids(rows)]), key=str)


def brute_ids(rows):
    return [i for i in brute([(r[0] if r[0] is not None else None, r[1]) for r in rows])] if all(r[0] is not None for r in rows) else [i for i in brute([r for r in rows if r[0] is not None])] + [None]


def test_repeated_rows_leave_one(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "HOT_ROWS", 2)
    rows = [(1, "a b c d e f g")] * 3 + [(2, "a b c d e f g"), (3, "other words altogether")]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(df).collect()) == [1, 3]


def test_large_groups_make_few_pairs(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(400):
        copy = list(base)
        copy[rng.randrange(200)] = f"e{i}"
        rows.append((i, " ".join(copy), None, None, None))
    got = near_copies.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.doc_id for r in got] == [0]


def family(rng, size, planted, n=400, own=46):
    """Texts that share a long passage but are no near copies (0.79), and copies of some that are (0.85)."""
    word = lambda: f"{rng.randrange(10**9):x}"
    passage = [word() for _ in range(n - own)]
    rows = [(i, " ".join(passage + [word() for _ in range(own + rng.randrange(3))])) for i in range(size)]
    for k in range(planted):
        words = rows[k * (size // planted)][1].split()
        at = len(words) - 32
        rows.append((size + k, " ".join(words[:at] + [word() for _ in range(32 + rng.randrange(2))])))
    return rows


def test_pairs_in_a_large_family_are_found(spark):
    rows = family(random.Random(4), 600, 30)
    sets = [shingles(t) for _, t in rows]
    assert max(len(sets[0] & s) / len(sets[0] | s) for s in sets[1:600]) < 0.8
    held = len(brute(rows))
    assert 570 <= held <= 600
    got = near_copies.drop_near_copies(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)).collect()
    assert sorted(r.doc_id for r in got) == brute(rows)


def footers(rng, pairs=12):
    """Texts, and each with a line of its words that is repeated 50 times (0.89 by sets)."""
    rows = []
    for k in range(pairs):
        words = [f"{rng.randrange(10**9):x}" for _ in range(104)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + words[10:22] * 50))]
    return rows


def test_repeated_footers_are_near_copies(spark):
    rows = footers(random.Random(6))
    assert brute(rows) == list(range(0, 24, 2))
    got = near_copies.drop_near_copies(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)).collect()
    assert sorted(r.doc_id for r in got) == brute(rows)


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(7)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in "ab")
        assert np.bitwise_count(near_copies.parity(a) ^ near_copies.parity(b)) <= len(np.setxor1d(a, b))


def one_band_pairs(rng, pairs=40):
    """Near copies that share a block in one of the bands only."""
    rows = []
    while len(rows) < 2 * pairs:
        a = [f"{rng.randrange(10**9):x}" for _ in range(104)]
        b = a[:93] + [f"{rng.randrange(10**9):x}" for _ in range(11)]
        keys = [near_copies.bands(np.unique(shingle_hashes(" ".join(x).encode(), 5))) for x in (a, b)]
        if (keys[0] == keys[1]).sum() == 1:
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    return rows


def test_pairs_of_one_block_meet_with_many_partitions(spark):
    rows = one_band_pairs(random.Random(8))
    assert brute(rows) == list(range(0, 80, 2))
    names = {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        got = near_copies.drop_near_copies(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r.doc_id for r in got) == brute(rows)


def test_overlaps_equal_set_operations():
    rng = random.Random(5)
    sets = [sorted(rng.sample(range(200), rng.randrange(120))) for _ in range(12)]
    a = [np.array(s, np.uint32) for s in sets]
    assert near_copies.overlaps(a[:5], a[5:]).tolist() == [[len(set(x) & set(y)) for y in sets[5:]] for x in sets[:5]]
    assert near_copies.overlaps(a, None).tolist() == [[len(set(x) & set(y)) for y in sets] for x in sets]


def test_empty(spark):
    assert near_copies.drop_near_copies(spark.createDataFrame([], SCHEMA)).count() == 0
