import pytest
from pyspark.sql import functions as F

from commitlens.functions import predicates as P
from commitlens.functions import scalars as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["x"])
    return row.select(column.alias("r")).collect()[0]["r"]


def test_octal_path(spark):
    path = r"docs/\305\273\303\263\305\202w \342\202\254.md"
    assert one(spark, X.decode_octal_path(F.col("p")), p=path) == "docs/Żółw €.md"
    assert one(spark, X.decode_octal_path(F.col("p")), p=f'"{path}"') == "docs/Żółw €.md"
    assert one(spark, X.decode_octal_path(F.col("p")), p="plain.txt") == "plain.txt"


def test_work_items(spark):
    text = "fixes Web-12, web-12 and api-7x (not api-x); see 9-9"
    assert one(spark, X.work_items(F.col("c"), r"[a-zA-Z]+-[0-9]+"), c=text) == ["WEB-12", "WEB-12", "API-7"]
    assert one(spark, X.work_items(F.col("c"), ""), c=text) == []


@pytest.mark.parametrize(("text", "expected"), [("Xml, .cs; CS   ; JAVA ", [".xml", ".cs", ".java"]), ("", [])])
def test_extensions(spark, text, expected):
    assert one(spark, X.normalise_extensions(F.col("c")), c=text) == expected


@pytest.mark.parametrize(("line", "expected"), [("R087\told.c\tnew.c", (16, "new.c", "old.c")), ("C100\ta\tb", (8, "b", "a")), ("A\tx", (2, "x", None)), ("DD\tx", (32, "x", None)), ("M\tx", (4, "x", None)), ("T\tx", (512, "x", None)), ("Q\tx", (1, "x", None))])
def test_change_line(spark, line, expected):
    assert tuple(one(spark, c, c=line) for c in X.change_fields(F.col("c"))) == expected


@pytest.mark.parametrize(("line", "depth"), [("\t\tx", 2), ("        x", 2), ("\t  x", 1), ("x", 0), ("       x", 1)])
def test_indentation(spark, line, depth):
    assert one(spark, X.indentation(F.col("c")), c=line) == depth


@pytest.mark.parametrize(("value", "inside"), [(5.0, True), (9.0, True), (7.0, True), (4.9, False), (9.1, False)])
def test_range_is_inclusive(spark, value, inside):
    assert one(spark, P.in_range(F.col("v"), 5, 9), v=value) is inside


def test_degree_rounds_half_to_even(spark):
    assert one(spark, X.coupling_degree(F.lit(1), F.lit(4), F.lit(5))) == 12.5
    assert one(spark, X.coupling_degree(F.lit(0), F.lit(0), F.lit(0))) is None


def test_min_max_of_no_range_is_nan(spark):
    r = one(spark, X.min_max_normal(F.lit(3), F.lit(3), F.lit(3)))
    assert r != r


def test_whole_days_are_24_hours(spark):
    r = one(spark, X.whole_days(F.lit("2020-01-01 23:00:00").cast("timestamp"), F.lit("2020-01-03 22:00:00").cast("timestamp")))
    assert r == 1


def test_local_path(spark):
    assert one(spark, X.local_path(F.col("p"), "c:\\w", "trunk"), p="trunk/a/b.c") == "c:\\w\\a\\b.c"
