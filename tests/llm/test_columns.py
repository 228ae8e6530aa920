"""Columns of any name, empty tables and repeated rows, for all operators that keep or read other columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairwright.llm import audio, language, licenses, mixing, near_copies, pieces, queries, secrets, simhash, toxicity

TEXT = "some words of a text that goes on for a while so that it has shingles"
NAMES = ["_key", "_seed", "score", "a.b", "utf8", "k1", "times", "_utf8", "class", "toxicity"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{TEXT} {i} password=abcdefgh{i} scumbag" if i % 3 else TEXT, "en", "s", 9, *[f"{n}{i % 2}" for n in range(len(NAMES))]) for i in range(30)]
    rows += rows[:2] + [(None,) * (5 + len(NAMES))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame(rows, schema)


def test_stages_keep_columns_of_any_name(spark, docs, tmp_path):
    spark.createDataFrame([(i, 0, int(i % 3 > 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.where("false")):
            got = stage(spark, given, str(tmp_path))
            assert got.schema.names == docs.columns, name
            rows = got.collect()
            assert all(r["a.b"] == f"3{r.doc_id % 2}" for r in rows if r.doc_id is not None), name
            assert bool(rows) == (given is docs), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_rows_that_differ_in_other_columns(spark):
    rows = [(1, TEXT, "s", "x"), (1, TEXT, "s", "y"), (1, TEXT, "s", "y"), (2, "other words", "s", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` string")
    kept = [near_copies.drop_near_copies(x).collect() for x in (df, df.repartition(3), df.orderBy(F.desc("`a.b`")))]
    assert all(sorted(k) == sorted(kept[0]) and len(k) == 2 for k in kept)
    taken = mixing.take(df, share=2.0).collect()
    assert sorted(r["a.b"] for r in taken) == ["x", "x", "y", "y", "y", "y", "z", "z"]


@pytest.mark.parametrize("run", [
    lambda d: simhash.near_classes(d), lambda d: mixing.mix(d), lambda d: secrets.secrets(d), lambda d: audio.digests(audio.media(d)),
    lambda d: licenses.licenses(d), lambda d: language.predict(d, None), lambda d: pieces.encode(d, open(pieces.MODEL, "rb").read(), ["doc_id", "a.b"], check=True),
    lambda d: toxicity.score(d, toxicity.Model(None, None), ["doc_id", "a.b", "score"], out="s"),
])
def test_a_row_for_each_row(docs, run):
    assert run(docs).count() == docs.count() and run(docs.where("false")).count() == 0


def test_queries_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == (name == "op10_chat"), name
