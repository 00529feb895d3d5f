"""Trap tests for the canonical numeric / date forms, Spark vs DuckDB."""
import datetime as dt
import random
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import types as T

from loanlens.functions import canon as K
from loanlens.plans import sqlkit as S


def _duck_values(expr, values, typ="DOUBLE"):
    con = duckdb.connect()
    vals = ", ".join(f"(CAST({v!r} AS {typ}))" if v is not None else "(NULL)" for v in values)
    return [r[0] for r in con.sql(f"SELECT {expr} FROM (VALUES {vals}) t(x)").fetchall()]


ROUND_CASES = [1.005, 0.285, 2.675, 0.125, -0.125, 12.345, 99.995, 0.0, 1e-9, 33.333333333333336]


def test_rnd_half_away_from_zero_on_decimal_text(spark):
    df = spark.createDataFrame([(v,) for v in ROUND_CASES], "x double").coalesce(1)
    got = [r[0] for r in df.select(K.rnd("x", 2)).collect()]
    assert got[:6] == [Decimal("1.01"), Decimal("0.29"), Decimal("2.68"), Decimal("0.13"),
                       Decimal("-0.13"), Decimal("12.35")]


def test_quantize6_same_digits_in_both_engines(spark):
    # exact ties at the 7th decimal place whose binary value is not exact
    cases = [0.4321 / 8, 1 / 3200, 7 / 3200, 0.0078125, 123.4567895, 2.5e-7, 1 / 3]
    df = spark.createDataFrame([(v,) for v in cases], "x double")
    got = [r[0] for r in df.select(K.quantize6("x")).collect()]
    assert got == _duck_values(S.quantize6("x"), cases)
    assert all(v.as_tuple().exponent == -6 for v in got)


def test_avg_x_is_exact_sum_over_count(spark):
    df = spark.createDataFrame([(Decimal("0.1000"),), (Decimal("0.2000"),), (None,)],
                               T.StructType([T.StructField("x", T.DecimalType(10, 4))]))
    assert df.agg(K.avg_x("x")).first()[0] == pytest.approx(0.15, abs=0)


def test_iavg_truncates_toward_zero(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert df.agg(K.iavg("x")).first()[0] == 1
    df = spark.createDataFrame([(-1,), (-2,)], "x int")
    assert df.agg(K.iavg("x")).first()[0] == -1
    assert _duck_values(S.iavg("x"), [-1, -2], "INTEGER")[0] == -1


def test_flag_average_is_double_not_five_decimals(spark):
    df = spark.createDataFrame([("Defaulted",), ("Current",), ("Current",)], "loan_status string")
    v = df.agg(K.flag_rate(K.is_bad())).first()[0]
    assert v == 1 / 3


def test_pct_keeps_wide_values(spark):
    df = spark.createDataFrame([(5000, 1)], "n long, d long")
    assert df.select(K.pct("n", "d")).first()[0] == Decimal("500000.00")


# shares that come out a cent higher when they are rounded to six places first
PERCENT = [(5001, 10001, "50.00"), (8336, 10003, "83.33"), (3574, 10007, "35.71"), (1, 3, "33.33"), (2, 3, "66.67"), (1, 8, "12.50"),
           (1, 800, "0.13"), (-1, 800, "-0.13"), (0, 7, "0.00"), (3 * 10 ** 12, 7 * 10 ** 12, "42.86")]


def test_percentages_are_rounded_once(spark):
    df = spark.createDataFrame([(n, d) for n, d, _ in PERCENT], "n long, d long").coalesce(1)
    got = [r[0] for r in df.select(K.pct("n", "d")).collect()]
    assert got == [Decimal(x) for _, _, x in PERCENT]
    rows = ", ".join(f"({n}, {d})" for n, d, _ in PERCENT)
    assert [r[0] for r in duckdb.sql(f"SELECT {S.pct('n', 'd')} FROM (VALUES {rows}) t(n, d)").fetchall()] == got


def test_rounded_averages_against_fractions(spark):
    from fractions import Fraction
    rng = random.Random(1)
    rows = [(Decimal(rng.randrange(-10 ** 7, 10 ** 7)) / 100, Decimal(rng.randrange(1, 10 ** 6)) / 100 if rng.random() < 0.9 else None)
            for _ in range(997)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField(c, T.DecimalType(15, 2)) for c in "xy"]))
    got = df.agg(K.ravg("x", 2, 100), K.ravg_ratio("x", "y", 2, 100, 12), K.ravg_diff("x", "y", 2, 100), K.ravg("y", 0)).first()

    def half_up(f, d):
        n = int(abs(f) * 10 ** d * 2 + 1) // 2
        return Decimal(n if f >= 0 else -n).scaleb(-d)
    xs, ys = [Fraction(x) for x, _ in rows], [Fraction(y) for _, y in rows if y is not None]
    mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
    assert list(got) == [half_up(mx * 100, 2), half_up(mx * 100 / (my * 12), 2), half_up((mx - my) * 100, 2), half_up(my, 0)]


def test_integer_average_of_large_values(spark):
    df = spark.createDataFrame([(3_000_000_000,), (3_000_000_001,), (2 ** 60,)], "x long")
    assert df.agg(K.iavg("x")).first()[0] == (6_000_000_001 + 2 ** 60) // 3
    w = Window.partitionBy()
    assert df.where("x < 4000000000").select(K.iavg_over("x", w)).first()[0] == 3_000_000_000


def test_pct_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(5, 0)], "n long, d long")
    assert df.select(K.pct("n", "d")).first()[0] is None


def test_month_boundaries_count_boundaries_not_whole_months(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 31), dt.date(2020, 2, 1)),
                                (dt.date(2020, 2, 1), dt.date(2020, 1, 31)),
                                (dt.date(2019, 12, 31), dt.date(2021, 1, 1))], "a date, b date")
    got = [r[0] for r in df.select(K.month_boundaries("a", "b")).collect()]
    assert got == [1, -1, 13]


def test_day_diff_may_be_negative(spark):
    df = spark.createDataFrame([(dt.date(2020, 3, 1), dt.date(2020, 2, 1))], "a date, b date")
    assert df.select(K.day_diff("a", "b")).first()[0] == -29


def test_safe_timestamp_null_on_bad_text(spark):
    df = spark.createDataFrame([("2001-02-03",), ("not-a-date",), (None,)], "s string")
    got = [r[0] for r in df.select(K.safe_timestamp("s")).collect()]
    assert got[0] == dt.datetime(2001, 2, 3) and got[1] is None and got[2] is None


def test_currency_en_us(spark):
    df = spark.createDataFrame([(Decimal("1234567.50"),), (Decimal("0.05"),), (Decimal("-1234.50"),)],
                               T.StructType([T.StructField("x", T.DecimalType(38, 2))]))
    got = [r[0] for r in df.select(K.currency("x")).collect()]
    assert got == ["$1,234,567.50", "$0.05", "-$1,234.50"]


def test_past_due_prefix_and_null_status(spark):
    df = spark.createDataFrame([("Past Due (1-15 days)",), ("past due",), (None,)], "loan_status string")
    got = [r[0] for r in df.select(K.flag(K.is_past_due())).collect()]
    assert got == [1, 0, 0]
