import pytest
from pyspark.sql import functions as F

from pairwright.functions import numbers, transforms
from pairwright.functions.patterns import PatternError, Regex, to_java
from pairwright.plans import expression, rules, values
from pairwright.plans.compiled import compile_filter

CASES = {
    "1 + 2 * 3": "7", "2 ** 3 ** 2": "512", '"10" lt "2"': "true", '"10" < "2"': "false", '"foo" == "foo"': "", '"a" + "b"': "", '"a" ++ "b"': "ab",
    '"abc"[1]': "b", '"abcdef"[1:3]': "bc", "[10,20,30][-1]": "30", '"a,b,c" | split(",") | join("-")': "a-b-c", "10 - 3 = 7": "true", "6 / 2": "3",
    'and(1,"x")': "x", "or(0,5)": "5", "typeof(null)": "none", '"\\u{41}"': "A", "7 // 2": "3", "-7 // 2": "-3", "-7.5 % 2": "-1.5", "1 / 0": "", "-2 ** 2": "4",
    'not "a" eq "b"': "false", '"b" in "abc"': "true", '"01" in ["1"]': "true", '"x" not in ["y"]': "true", '"ab12" | match(_, /\\d+/)': "12", '"aXbX" | replace("X", "-")': "a-b-",
    '" a " | trim | upper': "A", 'len("é€")': "2", "len([1,2])": "2", 'coalesce("", null, "z")': "z", "round(-2.5)": "-3", "round(2.5)": "3", "max(3, 12, 7)": "12", 'min("b", "a")': "a",
    'if("", "y", "n")': "n", 'unless("", "y", "n")': "y", '"0" and "t"': "t", "is_null(null)": "true", 'is_empty([])': "true", '"abc"[-2:]': "bc", '"abc"[9]': "", '"a-b-c" | split("-", 1)': "a,b-c",
    "1_000 + 0.5": "1000.5", '"abc".upper()': "ABC", 'first("abc") ++ last("abc")': "ac", 'int("7.0")': "", "int(7.0)": "7", 'float("x")': "", 'startswith("abc", "ab")': "true", "1e3": "1000",
    '"x" | concat(_, "y", _)': "xyx", 'contains(["a", "2"], 2.0)': "true", '/^a/i in "Abc"': "true", "true": "true", "not null": "true", "typeof([1])": "list", 'slice("abcdef", 2, 4)': "cd",
}


def test_goldens(spark):
    build = values.Compiler(lambda n: values.cell(F.lit(n)), lambda a: values.null())
    for part in range(0, len(CASES), 16):
        some = list(CASES)[part : part + 16]
        row = spark.range(1).select(*[build(expression.parse(c)).text.alias(f"x{i}") for i, c in enumerate(some)]).first()
        for i, c in enumerate(some):
            assert row[i] == CASES[c], c


@pytest.mark.parametrize("source", ["", "1 +", "foo(1)", "(1", '"a', "1 2", "[1", "a as b", "/x", "a.1"])
def test_errors(source):
    with pytest.raises((expression.ExpressionError, PatternError)):
        expression.parse(source)


def test_derive():
    a, b = expression.parse_derive('split(v, ".") as (x, y), x ++ y as z')
    assert (a.names, a.is_tuple, b.names) == (("x", "y"), True, ("z",))
    with pytest.raises(expression.ExpressionError):
        expression.parse_derive("1 + 2")


def test_filter_needs_known_columns(spark):
    with pytest.raises(rules.RuleError):
        compile_filter("nope > 1", ["a"])


TRANSFORMED = [
    ('date("%d/%m/%Y")', "31/12/2020", "2020-12-31", True), ('date("%d/%m/%Y")', "1/2/2020", "2020-02-01", True), ('date("%Y-%m-%d")', "", "", False), ('date("%Y-%m-%d")', "2020-12-31T23:30:00-01:00", "2021-01-01", True),
    ("bool", "YES", "true", True), ("bool", "0", "false", True), ("bool", "x", "x", False), ('match(regex("(\\\\d{4})-(\\\\d{2})"), 2)', "2020-07-01", "07", True), ('regex_replace("(\\\\w+)@(\\\\w+)", "$2/$1")', "bob@example", "example/bob", True),
    ('regex_keep("\\\\d")', "a1b2c3", "123", True), ("int", " +007 ", "7", True), ("int", "7.0", "7.0", False), ("float", "1e3", "1000", True), ("float", "0.00000012", "0.00000012", True), ("float", "1d", "1d", False), ("float", "nan", "nan", False),
    ("trim | collapse", "  a \t b ", "a b", True), ('replace("a", "$1")', "aba", "$1b$1", True), ('replace("", "-")', "ab", "-a-b-", True), ('prefix("<") | suffix(">")', "x", "<x>", True), ("match(regex(\"z\")) | upper", "abc", "ABC", False), ("lower", "ÄÖ", "äö", True),
]


def test_transforms(spark):
    for part in range(0, len(TRANSFORMED), 8):
        some = TRANSFORMED[part : part + 8]
        made = [transforms.run(F.lit(text), rules.transforms(rules.parse_value(steps))) for steps, text, _, _ in some]
        row = spark.range(1).select(*[c for pair in made for c in pair]).first()
        for i, (steps, text, want, ok) in enumerate(some):
            assert (row[2 * i], row[2 * i + 1]) == (want, ok), (steps, text)


def test_patterns(spark):
    def found(pattern, text, **how):
        return spark.range(1).select(Regex(pattern, **how).found(F.lit(text))).first()[0]

    assert found("^[^@[:space:]]+$", "ab") and not found("^[^@[:space:]]+$", "a b")
    assert not found("a$", "a\n") and found(r"^\w+$", "été") and found("ÉT", "été", ignore_case=True)
    assert found(r"(?P<x>a)b", "ab") and found(r"\x{41}", "A")
    for bad in ("(?=a)", r"(a)\1", "(a", "[a", "a)", "*", "(?<!a)b", "a++"):
        with pytest.raises(PatternError):
            to_java(bad)


def test_double_text(spark):
    for x, want in ((5.0, "5"), (0.1, "0.1"), (123456789.5, "123456789.5"), (1e-7, "0.0000001"), (float("nan"), "NaN"), (float("-inf"), "-inf"), (-2.50, "-2.5"), (1e14, "100000000000000")):
        assert spark.range(1).select(numbers.double_text(F.lit(x))).first()[0] == want
