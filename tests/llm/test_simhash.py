import random

import numpy as np
import pytest
import xxhash

from pairwright.llm import simhash
from pairwright.llm.components import components

SCHEMA = "doc_id long, text string, fp string, component string"


def brute(rows, k=3, most=3):
    fps = []
    for _, text, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        words = [w for w in low.split(" ") if w]
        shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    ids = [r[0] for r in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                comp[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, f"{f:016x}", least.get(root(i))) for i, (d, f) in enumerate(zip(ids, fps))), key=str)


def rows_for(seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(["alpha", "Béta", "gamma", "delta", "É", "x"]) + str(rng.randrange(30)) for _ in range(rng.choice([1, 2, 3, 40, 300]))) for _ in range(25)]
    rows = [(i, t, "clash", None) for i, t in enumerate(base)]
    for i in range(60):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "edit"
        rows.append((100 + i, rng.choice([" ", "\n", "  ", "\t"]).join(words), None, "x"))
    return rows + [(7, base[7], None, None), (None, base[3], None, None), (500, None, None, None), (501, "", None, None), (502, " \n ", None, None), (503, "one " * 30_000, None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rows = rows_for(seed)
    found = simhash.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.id, f"{r.fp & (1 << 64) - 1:016x}", r.component) for r in found), key=str) == brute(rows)


def test_empty_table(spark):
    assert simhash.near_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_crowded_keys_lose_no_link(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 600:
        fps.add(rng.choice(sorted(fps)) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))))
    fps |= {rng.getrandbits(64) for _ in range(50)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {}
    arr = np.array(signed, dtype=np.int64).view(np.uint64)
    todo = set(range(len(arr)))
    while todo:
        i = todo.pop()
        group, front = {i}, [i]
        while front:
            j = front.pop()
            near = {int(x) for x in np.flatnonzero(np.bitwise_count(arr ^ arr[j]) <= 3)} & todo
            todo -= near
            group |= near
            front += near
        for j in group:
            want[signed[j]] = min(signed[x] for x in group)
    for crowd in (8, 2_000):
        got = {r.node: r.root for r in components(simhash.links(df, crowd=crowd)).collect()}
        assert {f: got.get(f, f) for f in signed} == want


def test_links_grow_with_members_not_their_square(spark):
    df = spark.createDataFrame([((1 << 40) ^ i,) for i in range(512)], "fp long")
    assert simhash.links(df).count() < 20 * 512


def test_components_chain(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(5, 5), (None, 3), (900, 901), (901, 900)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {900: 900, 901: 900}


def test_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 3)
    rows = [(i, "same text here", None, None) for i in range(8)] + [(20, "other words", None, None)]
    got = {r.id: r.component for r in simhash.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: 0 for i in range(8)} | {20: 20}
