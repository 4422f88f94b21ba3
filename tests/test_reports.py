from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from merchantry.plans import sales_reports


def bins(spark, values, outliers=False):
    df = spark.createDataFrame([(1, float(v)) for v in values], "zid int, value double")
    rows = sales_reports.histogram_bins(df, outliers).collect()
    return {(r["bin_start"], r["bin_end"]): r["count"] for r in rows}


def test_histogram_of_a_small_range(spark):
    got = bins(spark, [0, 0.5, 1, 3])
    # Edges 0, 1, 2, 3: the maximum sits on the last edge and is in no bin.
    assert got == {(0.0, 1.0): 2, (1.0, 2.0): 1, (2.0, 3.0): 0}


def test_histogram_drops_negatives_unless_asked(spark):
    got = bins(spark, [-5, 0, 4])
    assert (0.0, 1.0) in got and sum(got.values()) == 1
    full = bins(spark, [-5, 0, 4], outliers=True)
    assert full[None, 0.0] == 1 and full[4.0, None] == 1 and sum(full.values()) == 3


def test_histogram_width_is_the_whole_part_of_a_hundredth(spark):
    got = bins(spark, [0, 250, 249.5])
    assert (0.0, 2.0) in got and (248.0, 250.0) in got and len(got) == 125 and got[248.0, 250.0] == 1


def test_histogram_below_zero_has_no_bins(spark):
    assert bins(spark, [-9, -3]) == {}


def test_perspective_must_be_coarser(spark):
    df = spark.createDataFrame([(1, 2000, 1.0)], "zid int, year int, totalsales double")
    with pytest.raises(ValueError):
        sales_reports.descriptive_stats(df, "Sales", "Year", "Month", "Mean")


def test_two_level_counts(spark):
    rows = [(1, 2000, 1, "a"), (1, 2000, 1, "b"), (1, 2000, 2, "a"), (1, 2000, 2, "a")]
    df = spark.createDataFrame(rows, "zid int, year int, month int, cusid string")
    stat = lambda **kw: sales_reports.descriptive_stats(df, "Customers", "Year/Month", "Year", "Mean", **kw).first()["value"]
    assert stat() == 3.0 and stat(two_level=True) == 1.5


def test_ratios_guard_zero_denominators(spark):
    sales = spark.createDataFrame([(1, 2000, 1, "c", 10.0)], "zid int, year int, month int, cusid string, totalsales double")
    returns = spark.createDataFrame([(1, 2000, 2, "c", 4.0)], "zid int, year int, month int, cusid string, treturnamt double")
    got = {(r["period"], r["ratio"]): r["value"] for r in sales_reports.sales_ratios(sales, returns).collect()}
    assert got["2000-01", "Net Sales per Order"] == 10.0 and got["2000-01", "Orders to Returns Ratio"] == 0.0
    # A month with returns only has net sales 0 and divides by 1 where there are no orders.
    assert got["2000-02", "Net Sales per Order"] == 0.0 and got["2000-02", "Orders to Returns Ratio"] == 1.0


def test_distribution_checks_its_combinations(spark):
    df = spark.createDataFrame([(1, "c", "v", 2.0)], "zid int, cusid string, voucher string, totalsales double")
    with pytest.raises(ValueError):
        sales_reports.distribution(df, df, "Customer", "Counts")
    row = sales_reports.distribution(df, df, "Customer", "Sales").first()
    assert (row["entity"], row["value"]) == ("c", 2.0)


def test_distribution_of_returns_groups_by_the_return_voucher(spark):
    returns = spark.createDataFrame([(1, "c", "r1", 2.0), (1, "c", "r1", 3.0)],
                                    "zid int, cusid string, revoucher string, treturnamt double")
    rows = sales_reports.distribution(returns.select("zid", F.col("cusid")), returns, "Returns", "Voucher").collect()
    assert [(r["entity"], r["value"]) for r in rows] == [("r1", 5.0)]
