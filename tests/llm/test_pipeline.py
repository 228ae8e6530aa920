import random

import pytest

import corpus_pipeline
from pairwright.llm import mixing, pieces, secrets
from tests.llm.test_near_copies import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BAD = ["scumbag", "blockhead"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioubdfgklmnprst") for _ in range(rng.randrange(2, 8)))
    rows, labels = [], []
    for i in range(700):
        y = int(rng.random() < 0.3)
        words = [word() for _ in range(rng.randrange(30, 90))]
        for _ in range(y * rng.randrange(1, 4)):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        if i % 20 == 3:
            words.insert(5, "password=abcdefgh" + str(i))
        rows.append((i, " ".join(words), "en", rng.choice(["a", "b", "c"])))
        labels.append((i, 0, y))
    for k in range(60):
        i, t, lang, s = rows[rng.randrange(700)]
        rows.append((700 + k, t + rng.choice(["", " tail"]), lang, s))
    rows.append((900, None, None, None))
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_each_stage_on_its_input(spark, corpus, tmp_path):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "pieces" or docs.columns == COLUMNS
        kept.append(docs.collect())
    clean = sorted(r[0] for r in rows if not set(BAD) & set((r[1] or "").split()))
    assert sorted(r.doc_id for r in kept[0]) == clean
    assert sorted(r.doc_id for r in kept[1]) == brute([(r.doc_id, r.text) for r in kept[0]])
    before = {r.doc_id: r for r in kept[1]}
    assert sorted(before) == sorted(r.doc_id for r in kept[2])
    for r in kept[2]:
        old = before[r.doc_id].text
        assert (r.text is None) == (old is None) and r.n_chars == (len(r.text) if r.text is not None else None)
        assert r.text == old or secrets.scan(old.encode())
        assert not secrets.scan((r.text or "").encode())
    sizes, taken = {}, {}
    for r in kept[2]:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    for r in kept[3]:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    goals = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert all(abs(taken.get(s, 0) - goals[s]) < 100 for s in sizes)
    model = pieces.load()
    assert sorted((r.doc_id, model.decode(__import__("numpy").array(r.ids))) for r in kept[4]) == sorted((r.doc_id, r.text) for r in kept[3])


def test_run_gives_the_last_stage(spark, corpus):
    got = corpus_pipeline.run(spark, corpus[0])
    assert got.columns == ["doc_id", "lang", "source", "ids", "text_sha256", "round_trip", "n_ids"] and got.count() > 0 and got.where("not round_trip").isEmpty()
