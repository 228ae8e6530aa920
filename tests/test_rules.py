import json

import numpy as np
import pytest

from pairwright.functions.hashing import fnv1a
from pairwright.operators import mapping, reports, search, verdicts
from pairwright.plans import rules
from pairwright.plans.rules import RuleError
from pairwright.sources import generator, tables
from tests.fixtures import DESKS, LOAN_RULES, LOANS


def write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def run(spark, folder, csv, text, refs=None, **how):
    table = tables.from_csv(spark, write(folder, "t.csv", csv), id_column=how.pop("id_column", None))
    given = {n: spark.createDataFrame([r.split(",") for r in t.split()[1:]], ", ".join(f"{h} string" for h in t.split()[0].split(","))) for n, t in (refs or {}).items()}
    return table, verdicts.evaluate(table, rules.parse(text), mapping.References(spark, given), **how)


def numbers(r):
    return tuple(r[k] for k in ("rows_checked", "rows_passed", "rows_failed", "rows_skipped", "rows_validation_skipped", "transform_errors", "unmapped_values"))


@pytest.fixture(scope="module")
def loans(spark, tmp_path_factory):
    _, ev = run(spark, tmp_path_factory.mktemp("p"), LOANS, LOAN_RULES, DESKS, id_column="loan")
    return reports.report(ev)


def by_hash(*ids):
    return [i for _, i in sorted(zip(fnv1a([i.encode() for i in ids]).tolist(), ids))]


def test_loans(loans):
    tariff, desk, days, scanned = loans["rules"]
    assert numbers(tariff) == (7, 6, 1, 0, 0, 0, 0) and tariff["status"] == "failed"
    m = tariff["mapping"]
    assert (m["source"], m["distinct_inputs"], m["ambiguous_inputs"]) == ("auto", 4, 1)
    assert [(e["input"], e["canonical"], e["ambiguous"]) for e in m["entries"]] == [("adult", "A1", False), ("child", "C1", False), ("guest", "G1", False), ("student", "S1", True)]
    (unclear,) = m["ambiguities"]
    assert (unclear["input"], unclear["targets"]) == ("student", [{"value": "S1", "count": 3}, {"value": "A1", "count": 1}])
    assert unclear["examples"] == [{"id": "L1", "row": 1, "left": "student", "right": "S1", "expected": "S1"}]
    top = tariff["pass_results"][0]
    assert (top["left"], top["right"], top["expected"], top["count"], top["ids"]) == ("student", "S1", "S1", 3, by_hash("L1", "L2", "L4"))
    assert tariff["fail_results"] == [{"left": "student", "right": "A1", "expected": "S1", "count": 1, "ids": ["L6"]}]
    assert numbers(desk) == (7, 7, 0, 0, 0, 0, 0) and desk["status"] == "failed" and desk["mapping"]["ambiguous_inputs"] == 1
    assert numbers(days) == (7, 5, 2, 0, 0, 1, 0) and "mapping" not in days
    assert numbers(scanned) == (7, 6, 1, 0, 0, 0, 0) and scanned["fail_results"][0]["ids"] == ["L6"]
    assert (loans["rules_total"], loans["rules_passed"], loans["rules_failed"], loans["rows_checked"]) == (4, 0, 4, 7)


def test_renderings(loans):
    assert json.loads(reports.render_json(loans)) == loans
    text, page = reports.render_text(loans), reports.render_html(loans, "A <title>")
    assert "[FAIL] tariff of a group" in text and "student" in text
    assert "A &lt;title&gt;" in page and page.count('<section id="rule-') == 4 and "<details>" in page


def test_entries_up_to_a_number(spark, tmp_path):
    _, ev = run(spark, tmp_path, LOANS, LOAN_RULES, DESKS, id_column="loan")
    m = reports.report(ev, most_entries=2)["rules"][0]["mapping"]
    assert [e["input"] for e in m["entries"]] == ["adult", "child"] and m["distinct_inputs"] == 4


def test_counting_equals_verdicts(spark, tmp_path):
    csv = LOANS + "".join(LOANS.split("\n", 1)[1] for _ in range(5))
    _, ev = run(spark, tmp_path, csv, LOAN_RULES, DESKS)
    assert sorted(map(tuple, reports.count(ev).collect())) == sorted(map(tuple, reports.counters(ev.verdicts).collect()))


def test_empty_and_optional(spark, tmp_path):
    csv = "a,b\nx,1\n,\n , \ny,2\nz,9\n"
    text = 'rule "t" {\n left = a\n right = b\n trim = true\n allow_empty = true\n mapping_files = [ref]\n mapping_left = k\n mapping_right = v\n}\n'
    text += text.replace('"t"', '"u"').replace(" trim = true\n", "")
    _, ev = run(spark, tmp_path, csv, text, {"ref": "k,v\nx,1\ny,3"})
    one, two = reports.report(ev)["rules"]
    assert numbers(one) == (5, 1, 2, 2, 0, 0, 1) and numbers(two) == (5, 1, 3, 1, 0, 0, 2)
    assert two["fail_results"][0]["expected"].startswith("<unmapped:")


def test_predicates_and_fallback_columns(spark, tmp_path):
    csv = "a,b,kind\n,x,p\ny,,p\n,,q\nz,w,old\n"
    text = """rule "r" {
  left = or(a, b)
  right = "#1"
  validation_skipped = and(eq(kind, old), not(empty(a)), any_in([a, b], [w]), not_in(kind, [zz]), ne(b, "q"), not_empty(or(a, b)))
}
"""
    _, ev = run(spark, tmp_path, csv, text)
    r = reports.report(ev)["rules"][0]
    assert numbers(r) == (4, 2, 1, 0, 1, 0, 0) and r["left"] == "or(a, b)"
    assert r["validation_skipped_results"] == [{"left": "z", "right": "w", "count": 1, "ids": ["row:4"]}]


def test_cascade_of_sources(spark, tmp_path):
    csv = "city,area,code\nParis,,PAR\nRome,north,RN\nRome,south,XX\nOslo,,OSL\nLyon,,LYO\n"
    text = """rule "c" {
  right = code
  mapping {
    files = [one]
    left = city
    right = code
  }
  mapping {
    files = [two]
    left = [city, area]
    right = code
    when = unmapped
  }
}
"""
    refs = {"one": "city,code\nParis,PAR\nLyon,LYX", "two": "city,area,code\nRome,north,RN\nRome,south,RS"}
    _, ev = run(spark, tmp_path, csv, text, refs)
    r = reports.report(ev)["rules"][0]
    assert numbers(r) == (5, 2, 3, 0, 0, 0, 1) and r["left"] == "city"
    left = {v.left for v in ev.verdicts.collect()}
    assert left == {"Paris", "Rome|north", "Rome|south", "Oslo|", "Lyon"}


def test_any_of_several_targets(spark, tmp_path):
    csv = "k,v\na,1\na,2\na,3\nb,1\n"
    text = 'rule "m" {\n left = k\n right = v\n mapping_files = [ref]\n mapping_left = k\n mapping_right = [x, y]\n}\n'
    text += text.replace('"m"', '"n"').replace("right = v\n", "right = v\n compare = ne\n", 1)
    _, ev = run(spark, tmp_path, csv, text, {"ref": "k,x,y\na,1,2"})
    m, n = reports.report(ev)["rules"]
    assert numbers(m) == (4, 2, 2, 0, 0, 0, 1) and numbers(n) == (4, 1, 3, 0, 0, 0, 1)


def test_comparisons_and_patterns(spark, tmp_path):
    csv = "a,b\nx;y,x;y;z\nx,x\nx,y\n"
    ops = ("eq", "ne", "subset", "superset", "intersect")
    text = "defaults {\n multi = true\n}\n" + "".join(f'rule "{o}" {{\n left = a\n right = b\n compare = {o}\n}}\n' for o in ops)
    text += 'rule "p" {\n left = a\n pattern = "^x[[:punct:]]?y?$"\n}\nrule "q" {\n left = a\n pattern = ";"\n compare = not_matches\n}\n'
    _, ev = run(spark, tmp_path, csv, text)
    assert [r["rows_passed"] for r in reports.report(ev)["rules"]] == [1, 2, 2, 1, 2, 3, 2]


def test_derive_check_and_inline(spark, tmp_path):
    csv = "gross,tax,net,version\n10,3,7,1.2\n5,1,3,x\n"
    text = """rule "inline" {
  left = gross - tax
  right = net
}
rule "check" {
  check = 'gross - tax = net'
}
rule "derive" {
  derive = 'split(version, ".") as (major, minor), major ++ "-" ++ minor as both'
  left = both
  right = net
  compare = ne
}
"""
    _, ev = run(spark, tmp_path, csv, text)
    a, b, c = reports.report(ev)["rules"]
    assert (a["rows_passed"], b["rows_passed"], c["rows_passed"]) == (1, 1, 2)
    assert (a["left"], b["left"], b["right"]) == ("gross - tax", "gross - tax = net", "true")
    assert {v.left for v in ev.verdicts.where("rule = 2").collect()} == {"1-2", "x-"}


def test_hits_and_search(spark, tmp_path):
    csv = "a,b\n" + "x,x\n" * 4 + "x,y\n" * 3 + '"q, ""r""","two\nlines"\n'
    table, ev = run(spark, tmp_path, csv, 'rule "r" {\n left = a\n right = b\n}\n', cells=True)
    found = search.hits(ev, 0, limit=2).orderBy("_row").collect()
    assert [r._row for r in found] == [1, 2, 5, 6] and found[0].cells == ["x", "x"]
    assert [r._row for r in search.hits(ev, 0, limit=10, distinct=True).orderBy("_row").collect()] == [1, 5, 8]
    assert sum(r.heading for r in search.with_headings(search.hits(ev, 0)).collect()) == 3
    assert [r.c0 for r in search.search(table, "^TWO").collect()] == ['q, "r"']
    assert tuple(search.totals(table, "y", visible=["b"], limit=2).first()) == (3, 8, True)
    assert search.search(table, 'b eq "y" and a eq "x"', "expression").count() == 3
    assert [r._row for r in search.search(table, "Q,", "prefix").collect()] == [8]
    assert [tuple(r) for r in search.detail(table, 8).collect()] == [(0, "a", 'q, "r"'), (1, "b", "two\nlines")]
    only = verdicts.evaluate(table, rules.parse('rule "r" {\n left = a\n right = b\n}\n'), row_filter=search.condition(table, "y"))
    assert [r._row for r in only.verdicts.collect()] == [5, 6, 7]


def test_profiles(tmp_path):
    p = search.Profiles(str(tmp_path / "p.json"))
    p.save("mine", ["a"])
    assert search.Profiles(str(tmp_path / "p.json")).named == {"mine": ["a"]}
    (tmp_path / "p.json").write_text("{broken")
    assert search.Profiles(str(tmp_path / "p.json")).named == {}
    assert search.visible(["a", "b", "c"], {"a", "b"}, {"b"}) == ["b", "c"] and search.attributes(["Ab", "c"], "B") == ["Ab"]


@pytest.mark.parametrize(
    "text",
    ["", "rule x {\n", 'rule "a" {\n left = a\n}', 'rule "a" {\n left = a\n right = b\n oops = 1\n}', 'rule "a" {\n left = a\n right = b\n compare = near\n}', 'x = "', "defaults {\n}\n", 'rule "a" {\n check = "x"\n left = a\n}', 'rule "a" {\n left = a\n right = b\n transform_left = shout\n}', 'rule "a" {\n left = a\n pattern = "(?=x)"\n}', 'rule "a" {\n left = a\n right = b\n skip = maybe(a)\n}'],
)
def test_bad_rules(spark, text):
    with pytest.raises(RuleError):
        rules.parse(text)


def test_bad_columns(spark, tmp_path):
    for text in ("left = zz\n right = a", "left = a\n right = a\n mapping_filter = eq(a, b)", "left = a\n right = a\n compare = matches"):
        with pytest.raises(RuleError):
            run(spark, tmp_path, "a,b\n1,2\n", f'rule "r" {{\n {text}\n}}\n')


def test_generator_agrees_with_its_rules(spark):
    df = generator.frame(spark, 300, bad_rate=0.3)
    text = """rule "date" {
  left = recorded_on
  pattern = "^\\\\d{4}-\\\\d{2}-\\\\d{2}$"
}
rule "temp" {
  derive = 'string(round(float(temp_c) * 9 / 5 + 32)) as f'
  left = f
  right = temp_f
}
rule "country" {
  left = city
  right = country
  mapping_files = [cities]
  mapping_left = city
  mapping_right = country
}
"""
    ev = verdicts.evaluate(tables.from_frame(df, "id"), rules.parse(text), mapping.References(spark, {"cities": generator.reference(spark)}))
    got = {r.rule: r for r in reports.counters(ev.verdicts).collect()}
    assert all(r.failed > 0 and r.passed > 0 for r in got.values())
    assert max(r.failed for r in got.values()) - min(r.failed for r in got.values()) <= 1
    assert list(generator.generate(50)) == list(generator.generate(50)) != list(generator.generate(50, seed=1))


def test_generator_in_chunks(spark, monkeypatch):
    whole = list(generator.generate(1_000, bad_rate=0.3))
    monkeypatch.setattr(generator, "CHUNK", 64)
    assert list(generator.generate(1_000, bad_rate=0.3)) == whole
    assert whole[0][0] == "W000001" and all(30 <= int(r[6]) <= 90 for r in whole)
    for rate in (0.0, 1.0):
        for size in (2, 200):
            rows = list(generator.generate(size, bad_rate=rate))
            good = [r for r in rows if [r[1], r[2]] in [list(c[:2]) for c in generator.CITIES] and "-" in r[3][4:5] and int(r[5]) == int(float(r[4]) * 9 / 5 + 32 + 0.5 if float(r[4]) > -17 else 0)]
            assert 0 < len(good) < size and min(len(good), size - len(good)) == 1
    assert list(generator.generate(0)) == [] and [tuple(r) for r in generator.frame(spark, 1, seed=3).collect()] == [tuple(r) for r in generator.generate(1, seed=3)]


def test_numbers_are_a_sequence():
    state, out = 7 ^ 0x9E3779B97F4A7C15, []
    for _ in range(20):
        state = (state + 0x9E3779B97F4A7C15) & (1 << 64) - 1
        z = (state ^ state >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        z = (z ^ z >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
        out.append(z ^ z >> 31)
    assert generator.numbers(7, np.arange(1, 21)).tolist() == out


def test_files_are_split_unless_cells_hold_line_ends(spark, tmp_path):
    plain = write(tmp_path, "plain.csv", "a,b\n" + "".join(f'{i},"x, ""{i}"""\n' for i in range(5_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        t = tables.from_csv(spark, plain)
        assert t.df.rdd.getNumPartitions() > 4 and not tables.has_line_ends(spark, plain)
        assert [(r._row, r.c0, r.c1) for r in t.df.orderBy("_row").collect()] == [(i + 1, str(i), f'x, "{i}"') for i in range(5_000)]
        broken = write(tmp_path, "broken.csv", '"a\nb",c\n1,"x\ny"\n2,z\n')
        t = tables.from_csv(spark, broken)
        assert t.headers == ["a\nb", "c"] and [(r._row, r.c0, r.c1) for r in t.df.orderBy("_row").collect()] == [(1, "1", "x\ny"), (2, "2", "z")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_empty_file_and_header_alone(spark, tmp_path):
    t = tables.from_csv(spark, write(tmp_path, "none.csv", ""))
    assert t.headers == [] and t.df.count() == 0 and search.search(t, "x").count() == 0
    _, ev = run(spark, tmp_path, "a,b\n", 'rule "r" {\n left = a\n right = b\n}\n')
    r = reports.report(ev)
    assert (r["rows_checked"], r["rules_failed"], r["rules"][0]["status"]) == (0, 0, "passed") and reports.count(ev).count() == 0


def test_standard_input_leaves_no_file(spark, tmp_path, monkeypatch):
    import atexit
    import io
    import os

    gone, monkeyed = [], io.TextIOWrapper(io.BytesIO(b"a,b\n1,1\n"))
    monkeypatch.setattr("sys.stdin", monkeyed)
    monkeypatch.setattr(atexit, "register", lambda f, **how: gone.append((f, how)))
    assert tables.from_stdin(spark).df.count() == 1
    for f, how in gone:
        f(**how)
    assert len(gone) == 1 and not os.path.exists(gone[0][0].__self__)


def test_progress(spark):
    import io

    from pairwright.progress import Progress

    out = io.StringIO()
    with Progress(spark, out=out, each=0.01) as p:
        spark.range(2_000_000).repartition(8).selectExpr("sum(sqrt(id))").collect()
    assert "tasks" in out.getvalue() and out.getvalue().endswith("\r") and p.ended.is_set()


def test_tokens_over_repeated_row_numbers(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a;b", "x;y"), (1, "b", "y"), (1, "a;b", "x;y")], "n long, l string, r string")
    text = 'rule "m" {\n left = l\n right = r\n multi = true\n separator = ";"\n mapping = auto\n}\n'
    ev = verdicts.evaluate(tables.from_frame(df, row=F.col("n")), rules.parse(text))
    assert {(v.left, v.outcome, v.expected) for v in ev.verdicts.collect()} == {("a;b", "passed", "x, y"), ("b", "passed", "y")}


def test_cli(spark, tmp_path, capsys, monkeypatch):
    from pairwright import cli

    csv, vl, out = write(tmp_path, "t.csv", "a;b\n1;1\n2;3\n"), write(tmp_path, "r.vl", 'rule "r" {\n left = a\n right = b\n}\n'), tmp_path / "o.json"
    monkeypatch.setattr(cli, "session", lambda cores: spark)
    assert cli.main(["validate", csv, "-r", vl, "-d", ";", "--format", "json", "-o", str(out)]) == 1
    assert json.loads(out.read_text())["rules"][0]["rows_failed"] == 1
    assert cli.main(["validate", csv, "-r", vl, "-d", ";", "--no-fail"]) == 0
    assert cli.main(["validate", csv, "-r", str(tmp_path / "none.vl")]) == 1
    assert cli.main(["search", csv, "-s", "3", "-d", ";"]) == 0 and "2;3" in capsys.readouterr().out
    assert cli.main(["generate", "5", "-o", str(tmp_path / "w.csv"), "--reference", str(tmp_path / "c.csv")]) == 0
    assert len((tmp_path / "w.csv").read_text().splitlines()) == 6


def test_stream(spark, tmp_path):
    from pairwright.streaming.rules import counter_stream, verdict_stream

    spark.createDataFrame([(1, "a", "a"), (2, "a", "b")], "n long, x string, y string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n long, x string, y string").parquet(str(tmp_path / "in"))
    from pyspark.sql import functions as F

    v = verdict_stream(stream, rules.parse('rule "r" {\n left = x\n right = y\n}\n'), F.col("n"))
    q = counter_stream(v).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.outcome, r.rows) for r in spark.table("counts").collect()} == {("passed", 1), ("failed", 1)}


def test_hash():
    for text in (b"", b"a", "é€".encode(), b"x" * 300):
        h = 0xCBF29CE484222325
        for b in text:
            h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
        assert int(fnv1a([b"zz", text])[1]) == h
