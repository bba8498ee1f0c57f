"""Edge cases of the scalar rules."""

import pytest
from pyspark.sql import functions as F

from lacuna.functions import geo, names, sql, values


def column(spark, kind, data, fn):
    rows = [(i, v) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


NAMES = {
    "Parus major L.": "parus major",
    "Viola albida var. chaerophylloides (Regel) F.Maek.": "viola albida chaerophylloides",
    "Rana sp.": None,
    "Apis cerana F., 1793": "apis cerana",
    None: None,
    "": None,
    "  Abies (Sub) alba\tMill.": "abies alba",
    "Lycaena dispar subsp. rutila": "lycaena dispar rutila",
    "Homo Sapiens Linnaeus": "homo sapiens",
    "CF. Aves VAR. minor": "aves minor",
    "Aë bee cee": "a bee cee",
}


def test_managed_key(spark):
    assert column(spark, "string", list(NAMES), names.managed_key) == list(NAMES.values())


def test_sql_functions_equal_columns(spark):
    sql.register(spark)
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    got = df.select(F.expr("managed_key(n)"), F.expr("vernacular_key(n)"), F.expr("binomial(n)")).collect()
    want = df.select(
        names.managed_key(F.col("n")), names.vernacular_key(F.col("n")), names.binomial(F.col("n"))
    ).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_tokens_of_missing_name(spark):
    assert column(spark, "string", [None, "", "Rana sp.", "a (b) c"], names.name_tokens) == [[], [], ["Rana"], ["a", "c"]]


def test_vernacular_drops_unicode_space(spark):
    data = ["박 새", "박　새", "박 새", " 박\t새\n", None]
    assert column(spark, "string", data, names.vernacular_key) == ["박새"] * 4 + [""]


def test_vernacular_is_idempotent(spark):
    data = ["가 나", "　다 ", "라"]
    once = column(spark, "string", data, names.vernacular_key)
    assert column(spark, "string", once, names.vernacular_key) == once


def test_grade(spark):
    data = ["Ⅰ급", "1", " i ", "Ⅱ", "II 급", "2", "", None, "기타"]
    assert column(spark, "string", data, names.grade) == ["I", "I", "I", "II", "II", "II", "", "", "기타"]


def test_years(spark):
    data = ["2024-05-01", "5/1/2024", "4225", "", None, "abcd"]
    assert column(spark, "string", data, values.year_from_date) == ["2024", "2024", "4225", "", "", ""]
    years = ["2024", "1899", "1900", "2026", "2027", "4225", "", "abcd", None, " 2001 "]
    assert column(spark, "string", years, values.clean_year) == [2024, None, 1900, 2026, None, None, None, None, None, 2001]


def test_numbers(spark):
    got = column(spark, "string", ["1.5", " 2 ", "abc", "", None, "NaN", "Infinity", "-0.0"], values.parse_number)
    assert got == [1.5, 2.0, None, None, None, None, None, 0.0]
    assert str(got[-1]) == "0.0"


def test_half_coordinate_is_unknown(spark):
    df = spark.createDataFrame([("1", "2"), ("1", ""), ("x", "2")], "a string, b string")
    x, y = values.coordinate(F.col("a"), F.col("b"))
    assert [tuple(r) for r in df.select(x, y).collect()] == [(1.0, 2.0), (None, None), (None, None)]


@pytest.mark.parametrize(
    "last,status", [(None, "undiscovered"), (0, "dormant"), (2016, "dormant"), (2017, "found"), (2026, "found")]
)
def test_status(spark, last, status):
    assert column(spark, "int", [last], lambda c: values.discovery_status(c, "2026-06-29")) == [status]


def test_projection_is_symmetric_and_metric(spark):
    df = spark.createDataFrame([(126.5, 37.0), (128.5, 37.0), (127.5, 37.0)], "lon double, lat double")
    (x1, y1), (x2, y2), (x0, _) = [
        tuple(r) for r in df.select(*geo.tm_xy(F.col("lon"), F.col("lat"), geo.EPSG_5179)).collect()
    ]
    assert abs((x1 + x2) / 2 - 1_000_000) < 1e-6 and abs(y1 - y2) < 1e-6 and abs(x0 - 1_000_000) < 1e-9
    assert 88_900 < x2 - 1_000_000 < 89_050


def test_colour_ends_and_missing(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (99.0,), (None,), (5.0,)], "v double")
    rgba = geo.colour_ramp(F.col("v"), F.lit(0.0), F.lit(10.0), "temp")
    got = [tuple(r) for r in df.select(*rgba.values()).collect()]
    assert got[0] == (0x2C, 0x7B, 0xB6, 1) and got[1] == got[2] == (0xD7, 0x19, 0x1C, 1)
    assert got[3] == (0, 0, 0, 0) and got[4] == (0xFF, 0xFF, 0xBF, 1)
