from __future__ import annotations


import pytest

from merchantry.operators import netting

SALES = "zid int, area string, itemcode string, itemname string, year int, month int, totalsales decimal(18,4)"
RETURNS = SALES.replace("totalsales", "treturnamt")


def frames(spark, sales, returns):
    from decimal import Decimal
    fix = lambda rows: [(*r[:-1], Decimal(str(r[-1]))) for r in rows]
    return spark.createDataFrame(fix(sales), SALES), spark.createDataFrame(fix(returns), RETURNS)


@pytest.fixture
def pair(spark):
    return frames(
        spark,
        [(1, "N", "a", "A", 2000, 1, 10), (1, "N", "b", "B", 2000, 1, 5), (1, None, "a", "A", 2000, 1, 99),
         (2, "N", "a", "A", 2000, 1, 7)],
        [(1, "N", "a", "A", 2000, 1, 4), (1, "N", "a", "A", 2000, 2, 3), (1, "S", "b", "B", 2000, 2, 1)])


def test_period_with_returns_only_stays_in_the_cross_tab(pair):
    rows = {(r["zid"], r["area"], r["month"]): (r["net"], r["grand_total"])
            for r in netting.net_by_period(*pair, ["area"]).collect()}
    assert rows == {(1, "N", 1): (11.0, 8.0), (1, "N", 2): (-3.0, 8.0), (1, "S", 2): (-1.0, -1.0), (2, "N", 1): (7.0, 7.0)}


def test_period_with_returns_only_is_lost_by_month(pair):
    rows = {(r["zid"], r["month"]): r["net_sales"] for r in netting.net_by_month(*pair).collect()}
    assert rows == {(1, 1): 110.0, (2, 1): 7.0}


def test_wide_form_sorts_and_fills(pair):
    wide = netting.net_wide(netting.net_by_period(*pair, ["area"]), ["area"], [(2000, 2), (2000, 1)])
    assert wide.columns == ["zid", "area", "2000_01", "2000_02", "grand_total"]
    assert [tuple(r) for r in wide.collect()] == [
        (1, "N", 11.0, -3.0, 8.0), (1, "S", 0.0, -1.0, -1.0), (2, "N", 7.0, 0.0, 7.0)]


def test_month_major_order(pair):
    long = netting.net_by_period(*pair, ["area"])
    wide = netting.net_wide(long, ["area"], [(1999, 2), (2000, 1), (2000, 2)], month_major=True)
    assert wide.columns[2:-1] == ["2000_01", "1999_02", "2000_02"]


def test_cells_add_up_to_the_net_of_all_rows(pair):
    sales, returns = pair
    cells = netting.net_cells(sales, returns, ["itemcode"]).groupBy().sum("net").first()[0]
    assert float(cells) == 10 + 5 + 99 + 7 - 4 - 3 - 1


def test_cross_relation_needs_two_dimensions(pair):
    with pytest.raises(ValueError):
        netting.cross_relation(*pair, "area", "area")
    rows = {(r["zid"], r["area"], r["itemcode"]): (r["net"], r["grand_total"])
            for r in netting.cross_relation(*pair, "area", "product").collect()}
    assert rows[(1, "N", "a")] == (3.0, 8.0) and rows[(1, "N", "b")] == (5.0, 8.0)


def test_periods_of(pair):
    assert netting.periods_of(*pair) == [(2000, 1), (2000, 2)]


def test_margin_mode_adds_the_adjustment(spark):
    sales = spark.createDataFrame([(1, "N", 2000, 1, 10.0)], "zid int, area string, year int, month int, gross_margin double")
    returns = spark.createDataFrame(
        [(1, "N", 2000, 1, 6.0, 4.0)], "zid int, area string, year int, month int, treturnamt double, returncost double")
    assert netting.net_margin_by_period(sales, returns, ["area"]).first()["net"] == 8.0
