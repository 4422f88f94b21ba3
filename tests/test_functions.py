from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from merchantry.functions import calendar, codes, numeric


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_month_number_accepts_names_and_numbers(spark):
    got = values(spark, [("jan",), ("March",), ("DECEMBER",), ("7",), ("may",), (None,)], "m string",
                 calendar.month_number(F.col("m")))
    assert got == [1, 3, 12, 7, 5, None]
    assert values(spark, [(7,)], "m int", calendar.month_number(F.col("m"))) == [7]


def test_month_number_rejects_other_text(spark):
    with pytest.raises(Exception, match="not a month"):
        values(spark, [("foo",)], "m string", calendar.month_number(F.col("m")))


def test_month_name_of_opening_balance_is_null(spark):
    assert values(spark, [(0,), (1,), (12,), (13,)], "m int", calendar.month_name(F.col("m"))) == [
        None, "January", "December", None]


def test_relative_week_floors_and_ends_after_twelve(spark):
    start = dt.date(2001, 1, 1)
    rows = [(start, start + dt.timedelta(days=d)) for d in (-1, 0, 6, 7, 83, 84)]
    got = values(spark, rows, "a date, b date", calendar.relative_week(F.col("a"), F.col("b")))
    assert got == [None, 1, 1, 2, 12, None]


def test_period_start(spark):
    day = dt.date(2001, 5, 16)  # a Wednesday
    for frame, want in [("Daily", day), ("Weekly", dt.date(2001, 5, 14)), ("Monthly", dt.date(2001, 5, 1)),
                        ("Yearly", dt.date(2001, 1, 1)), ("unknown", day)]:
        assert values(spark, [(day,)], "d date", calendar.period_start(F.col("d"), frame)) == [want]


def test_rounding_is_half_to_even_on_the_scaled_double(spark):
    got = values(spark, [(0.5,), (1.5,), (2.5,), (-0.5,)], "v double", numeric.half_even(F.col("v")))
    assert got == [0.0, 2.0, 2.0, 0.0]
    assert values(spark, [(1.225,), (2.675,)], "v double", numeric.half_even(F.col("v"), 2)) == [1.23, 2.68]


def test_clean_number(spark):
    rows = [(float("inf"),), (float("-inf"),), (float("nan"),), (None,), (2.5,)]
    assert values(spark, rows, "v double", numeric.clean_number(F.col("v"))) == [0.0, 0.0, 0.0, 0.0, 2.0]


def test_ratio_and_zero_guards(spark):
    assert values(spark, [(1.0, 0.0)], "a double, b double", numeric.ratio(F.col("a"), F.col("b"))) == [None]
    assert values(spark, [(0,), (3,)], "a int", numeric.zero_as_one(F.col("a"))) == [1, 3]


def test_packcode(spark):
    rows = [("PK1", "i"), ("NO", "i"), ("", "i"), (None, "i"), ("KH7", "i")]
    pack, item = F.col("p"), F.col("i")
    assert values(spark, rows, "p string, i string", codes.packcode_or_item(pack, item)) == [
        "PK1", "i", "i", "i", "KH7"]
    assert values(spark, rows, "p string, i string", codes.packcode_or_item(pack, item, "KH")) == [
        "PK1", "i", "i", "i", "i"]
