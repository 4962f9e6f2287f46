import datetime as dt

import pytest
from pyspark.sql import functions as F

from tradewell.functions import numbers, ptbr, text


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def python_brl(v):
    return "R$ " + f"{v or 0:,.2f}".replace(",", "X").replace(".", ",").replace("X", ".")


def test_format_brl_is_python_formatting(spark):
    values = [0.0, 1.0, 1234.5, 1234567.891, -9876.5, 0.125, 0.375, 1e9, None, 2.675, -0.5]
    assert column(spark, values, "double", ptbr.format_brl) == [python_brl(v) for v in values]


def test_parse_brl_reads_the_leading_number(spark):
    cases = {
        "R$ 1.234,56": 1234.56,
        "R$1.234": 1234.0,
        "R$\u00a07,5": 7.5,
        "\u00a0-R$ 3": -3.0,
        "Infinity": float("inf"),
        "12,5 unidades": 12.5,
        "1,2,3": 1.2,
        "-7,25": -7.25,
        "abc": 0.0,
        "": 0.0,
        "  8": 8.0,
        ",5": 0.5,
        "1e3": 1000.0,
        "10.5": 105.0,
    }
    assert column(spark, list(cases), "string", ptbr.parse_brl) == list(cases.values())


def test_brl_round_trip(spark):
    values = [k * 977.13 for k in range(200)]
    back = column(spark, values, "double", lambda c: ptbr.parse_brl(ptbr.format_brl(c)))
    assert back == [round(v, 2) for v in values]


def test_plain_and_float_text(spark):
    values = [0.0, 12.0, 12.5, 1e7, 123456789.25, 1e12, -3.0, 0.01]
    plain = ["0", "12", "12.5", "10000000", "123456789.25", "1000000000000", "-3", "0.01"]
    assert column(spark, values, "double", numbers.plain_number_text) == plain
    assert column(spark, [0.0, 12.5, -16.25], "double", numbers.float_text) == ["0.0", "12.5", "-16.25"]


def test_fixed_text_rounds_the_binary_value(spark):
    values = [7.05, -16.25, 25.15, 1234.55, 0.0]
    got = column(spark, values, "double", lambda c: numbers.fixed_text(c, 1))
    assert got == [f"{v:.1f}" for v in values]


@pytest.mark.parametrize(
    ("total", "n", "want"), [(5, 2, 3), (-5, 2, -3), (4, 3, 1), (-4, 3, -1), (0, 7, 0), (9, 0, None)]
)
def test_half_up_div(spark, total, n, want):
    row = spark.range(1).select(
        numbers.half_up_div(F.lit(total).cast("bigint"), F.lit(n).cast("bigint"))
    )
    assert row.first()[0] == want


def test_half_cent_mean_rounds_up(spark):
    df = spark.createDataFrame([(212950.26,), (212950.27,)], "a double")
    assert df.select(numbers.money_avg(F.col("a"))).first()[0] == 212950.27


def test_title_text_splits_on_blanks_only(spark):
    got = column(spark, [" smart-tv  ", "RIO DE JANEIRO", "casa & decoração"], "string", text.title_text)
    assert got == ["Smart-tv", "Rio De Janeiro", "Casa & Decoração"]


def test_bad_dates_are_null(spark):
    values = ["2024-02-29", "2023-02-29", "", "30/01/2024", None]
    assert column(spark, values, "string", text.parse_date) == [dt.date(2024, 2, 29), None, None, None, None]


def test_slug(spark):
    got = column(spark, ["Receita  por\tMês", "", None], "string", lambda c: ptbr.slug(c, "dados"))
    assert got == ["receita_por_mês", "dados", "dados"]


def test_fill_template_prints_missing_values(spark):
    df = spark.createDataFrame([("a", None)], "x string, y int")
    assert df.select(text.fill_template("<{x}> {y}!")).first()[0] == "<a> None!"


def test_score_text(spark):
    assert column(spark, [0.123456, 1.0], "double", text.score_text) == ["0.1235", "1.0000"]


def test_sums_are_rounded_once(spark):
    df = spark.createDataFrame([(0.004,)] * 1000 + [(0.125,), (float("nan"),), (None,)], "a double")
    row = df.select(numbers.money_sum(F.col("a")), numbers.cents_sum(F.col("a")), numbers.money_avg(F.col("a"))).first()
    assert tuple(row) == (4.13, 413, 0.0)
    one = spark.createDataFrame([(0.125,), (-0.125,), (2.675,), (1.005,)], "a double")
    assert [r[0] for r in one.select(numbers.cents(F.col("a"))).collect()] == [13, -13, 268, 101]
    assert one.agg(numbers.money_avg(F.col("a"))).first()[0] == 0.92
