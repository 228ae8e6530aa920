"""What the plans must look like."""

import re

from pyspark.sql import functions as F

from pairwright.operators import reports, verdicts
from pairwright.plans import rules
from pairwright.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_share_one_scan_of_the_columns_they_read(spark, tmp_path):
    spark.range(100).select("id", *[F.col("id").cast("string").alias(n) for n in "abcdef"]).write.parquet(str(tmp_path / "t"))
    t = tables.from_frame(spark.read.parquet(str(tmp_path / "t")), row=F.col("id"))
    text = 'rule "x" {\n left = a\n right = b\n}\nrule "y" {\n left = c\n pattern = "1"\n}\nrule "z" {\n check = "a == 1"\n}\n'
    p = plan(reports.counters(verdicts.evaluate(t, rules.parse(text)).verdicts))
    assert len(re.findall(r"FileScan parquet", p)) == 1
    assert set(re.search(r"ReadSchema: struct<([^>]*)>", p)[1].split(",")) <= {"id:bigint", "a:string", "b:string", "c:string"}
    assert "Python" not in p and "Pandas" not in p and "CartesianProduct" not in p
    assert p.count("HashAggregate") >= 2 and len(re.findall(r"Exchange hashpartitioning", p)) == 1


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(100).select("id", F.col("id").cast("string").alias("a")).write.parquet(str(tmp_path / "t"))
    t = tables.from_frame(spark.read.parquet(str(tmp_path / "t")), row=F.col("id"))
    text = 'rule "x" {\n left = a\n right = a\n}\n'
    p = plan(verdicts.evaluate(t, rules.parse(text), row_filter=F.col("_row") > 50).verdicts)
    assert "GreaterThan(id,50)" in p


def test_small_relations_are_broadcast(spark, tmp_path):
    spark.range(1_000).select("id", (F.col("id") % 7).cast("string").alias("a"), (F.col("id") % 3).cast("string").alias("b")).write.parquet(str(tmp_path / "t"))
    t = tables.from_frame(spark.read.parquet(str(tmp_path / "t")), row=F.col("id"))
    df = reports.counters(verdicts.evaluate(t, rules.parse('rule "x" {\n left = a\n right = b\n mapping = auto\n}\n')).verdicts)
    df.collect()
    assert "BroadcastHashJoin" in plan(df)


def test_windows_stop_at_the_limits(spark):
    t = tables.from_frame(spark.range(100).select("id", (F.col("id") % 7).cast("string").alias("a"), (F.col("id") % 3).cast("string").alias("b")), row=F.col("id"))
    v = verdicts.evaluate(t, rules.parse('rule "x" {\n left = a\n right = b\n mapping = auto\n}\n')).verdicts
    groups = reports.top_groups(v, [3])
    for df in (groups, reports.group_ids(v, groups, [3]), reports.ambiguity_examples(v, [3])):
        assert "WindowGroupLimit" in plan(df)


def test_counting_looks_at_alike_rows_once(spark):
    df = spark.range(10_000).select("id", (F.col("id") % 7).cast("string").alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    text = 'rule "x" {\n left = a\n right = b\n}\nrule "y" {\n left = a\n right = b\n mapping = auto\n multi = true\n}\n'
    ev = verdicts.evaluate(tables.from_frame(df, row=F.col("id")), rules.parse(text))
    got = reports.count(ev)
    assert "Generate explode(array(" in plan(got) or "HashAggregate" in plan(got)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, reports.counters(ev.verdicts).collect()))
    one = verdicts.evaluate(tables.from_frame(spark.range(50).select("id", F.col("id").cast("string").alias("a")), row=F.col("id")), rules.parse('rule "x" {\n left = a\n right = a\n}\n'))
    assert sorted(map(tuple, reports.count(one).collect())) == sorted(map(tuple, reports.counters(one.verdicts).collect()))
