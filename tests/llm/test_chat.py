import random
import re

from pyspark.sql import functions as F

from pairwright.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, id string"


def test_round_trip_and_mask(spark):
    rng = random.Random(4)
    bits = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "<^|", "<^^|im_end|>", "<", "|", "^", "\n", "é€", "assistant\n", "a b", "<\n|", ""]
    roles = ["user", "assistant", "system", None, "odd%0A\n<|role", ""]
    rows = [(c, t, rng.choice(roles), "".join(rng.choice(bits) for _ in range(rng.randrange(6))), "clash", None) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(100, 0, "user", None, None, None), (100, 1, "assistant", None, None, None), (101, 0, "assistant", "x" * 300_000, None, None), (None, None, "user", "n", None, None), (102, 3, "user", "b", None, None), (102, 3, "user", "a", None, None), (102, 3, "user", "a", None, None)]
    got = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_texts(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    by = {}
    for c, t, r, x, *_ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert len(got) == len(by)
    for g in got:
        want = sorted(by[g.id])
        assert [(t.role, t.text) for t in g.turns] == [w[1:] for w in want]
        assert g.learned == [w[2] for w in want if w[1] == "assistant"]
        changes = 1 + sum(a[1] != b[1] for a, b in zip(want, want[1:]))
        assert len(re.findall(re.escape(chat.START), g.formatted)) == changes == g.formatted.count(chat.END)


def test_many_turns(spark):
    turns = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é<|"), F.col("id").cast("string")).alias("text"))
    (got,) = chat.format_chats(turns).select(chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_texts(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    assert [t.text for t in got.turns] == [f"é<|{i}" for i in range(20_000)]
    assert got.learned == [f"é<|{i}" for i in range(20_000) if i % 3]


def test_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_sql(spark, tmp_path):
    import duckdb

    rows = [(1, 0, "user", "hi"), (1, 1, "user", "ünd"), (1, 2, "assistant", "<|im_end|>"), (2, 0, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    with duckdb.connect() as con:
        con.sql(f"create view conversations as from '{tmp_path}/conversations.parquet/*.parquet'")
        want = con.sql(chat.SQL).fetchall()
    got = [tuple(r) for r in chat.query(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) == 3
