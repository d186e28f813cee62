"""Literal cases of the scalar functions, each as one row of a DataFrame."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import geometry as g
from factloom.functions import numbers as n
from factloom.functions import text as t
from factloom.functions import vectors as v


def apply(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(values)], f"k int, x {kind}")
    return [r.y for r in df.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_standard_number(spark):
    cases = {"1,234": 1234, "1.234,56": 1234.56, "1,234.56": 1234.56, "(1,234)": -1234, "": None, "abc": None, "42": 42, "12,5": 12.5, "1.234": 1.234, "1.234.567": 1234567, "12,": 12, "(-5)": -5, "15%": 15, "--5": 5, "VND 7": 7, None: None}
    assert apply(spark, list(cases), n.standard_number) == list(cases.values())


def test_parse_and_classify_numbers(spark):
    assert apply(spark, ["1,234 VND", "(loss)", "", "see 12 pages"], n.parse_number) == [1234, None, None, 12]
    assert apply(spark, ["1,234", "42", "hello", "", "7", None], n.is_numeric) == [True, True, False, False, False, False]
    assert apply(spark, ["1,234", "a 5 b", "abc", "²"], n.is_numeric_lenient) == [True, True, False, True]
    assert apply(spark, ["1.234,56", "-5", "(1,234)", "15%", "1.234.567", None], n.is_number) == [True, True, False, False, False, False]
    assert apply(spark, ["12019", "20245", "none"], n.extract_year) == [2019, 2024, None]
    assert apply(spark, ["FY2019 to CY2021", "x"], n.last_year) == [2021, None]
    assert apply(spark, [65.0, 3700.0, -1.0, None], n.format_duration, "double") == ["1:05", "1:01:40", "--:--", "--:--"]
    assert apply(spark, ["5.2 million", "300 tonnes", "none"], n.scaled_number) == [5200000, 300, None]


def test_value_unit(spark):
    got = apply(spark, ["Emissions: 1,234 tCO2e", "Energy: 500 MWh", "Reduction: 15.5%", "none", "100 tCO2", "50% of 100 tCO2e", "1234,56 MWh", None], t.value_unit)
    assert [tuple(x) if x else None for x in got] == [(1234, "tCO2e"), (500, "MWh"), (15.5, "%"), None, (100, "tCO2e"), (100, "tCO2e"), (56, "MWh"), None]


def test_scope_words(spark):
    assert apply(spark, ["Scope 1 and Scope 2", "SCOPE 3", "", None], t.explicit_scopes) == [["Scope 1", "Scope 2"], ["Scope 3"], [], []]
    cases = {"Scope 1 emissions": True, "carbon footprint analysis": True, "GDP growth forecast 3.5%": True, "The weather is nice today": False, "": False, None: False}
    assert apply(spark, list(cases), t.eligible) == list(cases.values())


def test_names(spark):
    assert apply(spark, ["hello world.pdf", "", "../../../etc/passwd", None], t.safe_filename) == ["hello world.pdf", "untitled", "......etcpasswd", "untitled"]
    assert apply(spark, ["Brisel Energy - 2015 - Report"], t.company_name) == ["brisel_energy"]
    assert apply(spark, ["a  b\n c 12"], t.kb_clean) == ["a b c"]
    assert apply(spark, ["GHG", "Total assets", "Fuel use", ""], t.is_heading) == [True, True, False, False]


def test_boxes(spark):
    df = spark.range(1).select(g.normalize(g.box(620.0, 700.0, 900.0, 760.0), F.lit(2480), F.lit(3508)).alias("a"), g.expand(g.box(10, 10, 90, 90), 5, 5, F.lit(100), F.lit(100)).alias("b"), g.area(g.box(0, 0, 10, 10)).alias("c"), g.normalize(g.box(-5.0, 30.0, 200.0, 10.0), F.lit(100), F.lit(100)).alias("d"))
    r = df.first()
    assert tuple(r.a) == (250, 200, 363, 217) and tuple(r.b) == (5, 5, 95, 95) and r.c == 100 and tuple(r.d) == (0, 100, 1000, 300)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0],), ([0.0, 0.0, 0.0],)], "x array<double>")
    rows = df.select(v.norm(F.col("x")).alias("n"), v.l2_normalize(F.col("x")).alias("u"), v.argmax(F.col("x")).alias("a"), v.softmax(F.col("x")).alias("p")).collect()
    assert rows[0].n == 3 and rows[0].a == 1 and rows[1].u == [0, 0, 0] and sum(rows[0].p) == pytest.approx(1)
