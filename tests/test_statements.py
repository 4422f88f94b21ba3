from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from merchantry.operators.ordered import cumulative_by_month
from merchantry.plans import statements as st

ROWS = "zid int, project string, period string, line string, value decimal(28,4)"
INCOME = {
    "01-1-Revenue": (-1000, -2000), "02-1-Cost of Revenue": (600, 1100),
    "03-1-Office & Administrative Expenses": (100, 150), "05-1-Depreciation/Amortization": (20, 30),
    "08-1-Interest Expense": (10, 15), "09-1-Income Tax & VAT": (30, 40), st.UNMAPPED: (5, 5),
}
BALANCE = {
    "01-3-Cash": (300, 450), "02-1-Accounts Receivable": (200, 260), "03-1-Inventories": (150, 120),
    "06-1-Property, Plant & Equipment": (500, 480), "08-1-Accounts Payable": (-180, -210), "11-1-Debt": (-400, -350),
    "13-1-Total Shareholders Equity": (-330, -85),
}


def statement(spark, lines):
    from decimal import Decimal
    rows = [(1, "P", period, line, Decimal(v)) for line, vs in lines.items() for period, v in zip(("2000", "2001"), vs)]
    return spark.createDataFrame(rows, ROWS)


@pytest.fixture(scope="module")
def books(spark):
    return st.financial_statements(statement(spark, INCOME), statement(spark, BALANCE))


def cells(df):
    return {(r["line"], r["period"]): r["value"] for r in df.collect()}


def test_income_totals_treat_missing_lines_as_zero(books):
    got = cells(books[0])
    assert got["02-2-Gross Profit", "2000"] == -400
    assert got["07-2-EBIT", "2000"] == -280
    assert got["08-2-EBT", "2000"] == -270
    assert got["10-1-Net Income", "2000"] == -240
    assert got["04-3-Discount Expense", "2000"] == 0
    assert not any(line == st.UNMAPPED for line, _ in got)


def test_unmapped_lines_enter_only_on_request(spark):
    got = cells(st.income_statement(statement(spark, INCOME), include_unmapped=True))
    assert got["10-1-Net Income", "2000"] == -235 and got[st.UNMAPPED, "2000"] == 5


def test_balance_check(books):
    got = cells(books[1])
    assert got["13-2-Retained Earnings", "2001"] == -665
    assert got["04-2-Total Current Assets", "2000"] == 650
    assert got["Balance", "2000"] == sum(v[0] for v in BALANCE.values())
    assert got["13-3-Balance Check", "2001"] == sum(v[1] for v in BALANCE.values()) - 665
    assert got["01-1-Assets", "2000"] == 0


def test_cash_flow(books):
    got = cells(books[2])
    assert got["04-1-Accounts Receivable", "2000"] == 0 and got["04-1-Accounts Receivable", "2001"] == 60
    operating = -665 + 30 + 60 - 30 + 0 - 30
    assert got["07-Total Operating Cashflow", "2001"] == operating
    assert got["12-Total Investing Cashflow", "2001"] == -20
    financing = 50 + 245 + (-665 + 240) + 0
    assert got["18-Total Financing Cashflow", "2001"] == financing
    change = -(operating - 20 + financing - (-665 + 240) - 30)
    assert got["20-Year Opening Cash", "2001"] == 300 and got["21-Change in Cash", "2001"] == change
    assert got["22-Year Ending Cash", "2001"] == 300 + change
    assert got["20-Year Opening Cash", "2000"] == 0 and got["22-Year Ending Cash", "2000"] == 0


def test_ratios_and_reporting_sign(books):
    rows = {(r["statement"], r["line"], r["period"]): r["value"] for r in st.three_statements(*books).collect()}
    assert rows["income", "01-1-Revenue", "2000"] == 1000
    assert rows["ratios", "COGS Ratio", "2000"] == 60.0
    assert rows["ratios", "Current Ratio", "2000"] == round(650 / 580, 3)
    assert rows["ratios", "Inventory Days", "2001"] == round(-120 * 365 / 1100, 3)
    # Total debt needs all three of its parts; one of them is 0 here, so its ratios are 0.
    assert rows["ratios", "Debt/Equity", "2000"] == 0
    assert rows["ratios", "Acid Test*", "2000"] == 0
    assert sum(1 for s, _, p in rows if s == "ratios" and p == "2000") == 43


def test_cumulative_balance_ends_at_the_yearly_total(spark):
    rows = [(1, "P", "a", 2000, 0, 5.0), (1, "P", "a", 2000, 3, 2.0), (1, "P", "b", 2000, 5, 1.0), (1, "Q", "a", 2000, 1, 9.0)]
    df = spark.createDataFrame(rows, "zid int, project string, ac_code string, year int, month int, value double") \
        .withColumn("value", F.col("value").cast("decimal(18,4)"))
    got = {(r["project"], r["ac_code"], r["month"]): float(r["value"])
           for r in cumulative_by_month(df, ["ac_code"], "value").collect()}
    assert [got["P", "a", m] for m in range(6)] == [5, 5, 5, 7, 7, 7]
    assert [got["P", "b", m] for m in range(6)] == [0, 0, 0, 0, 0, 1]
    assert ("Q", "a", 2) not in got and got["Q", "a", 1] == 9


def test_grid_keeps_accounts_without_postings(spark):
    accounts = spark.createDataFrame(
        [(1, "A1", "n", "Income", "1", "2", "3", "K00"), (1, "A2", "n", "Income", "1", "2", "3", "zzz")],
        "zid int, ac_code string, ac_name string, ac_type string, ac_lv1 string, ac_lv2 string, ac_lv3 string, ac_lv4 string")
    rollup = spark.createDataFrame([(1, "P", "A1", 2001, 2, 10.06)], "zid int, project string, ac_code string, year int, month int, value double")
    projects = spark.createDataFrame([(1, "P"), (1, "Q")], "zid int, project string")
    got = {(r["project"], r["ac_code"], r["period"]): (r["line"], float(r["value"])) for r in st.statement_yearly(
        accounts, rollup, projects, {"K00": "01-1-Revenue"}, 2001, 2).collect()}
    assert len(got) == 8
    assert got["P", "A1", "2001"] == ("01-1-Revenue", 10.1) and got["Q", "A1", "2001"][1] == 0
    assert got["P", "A2", "2000"] == (st.UNMAPPED, 0.0)


def test_last_full_month():
    assert st.last_full_month(1) == 12 and st.last_full_month(7) == 6


def test_wide_statement_orders_lines(books):
    wide = st.statement_wide(books[0], ["2000", "2001"])
    lines = [r["line"] for r in wide.collect()]
    assert lines == sorted(lines) and wide.columns == ["zid", "project", "line", "2000", "2001"]


def test_lines_from_the_rollup_equal_the_sums_of_the_account_grid(spark):
    rng = random.Random(12)
    accounts = spark.createDataFrame(
        [(z, f"A{n}", f"name {n}", "Income", "a", "b", "c", rng.choice(["K00", "K01", "K02", None])) for z in (1, 2) for n in range(12)],
        "zid int, ac_code string, ac_name string, ac_type string, ac_lv1 string, ac_lv2 string, ac_lv3 string, ac_lv4 string")
    rollup = spark.createDataFrame(
        [(rng.choice([1, 2]), rng.choice("PQ"), f"A{rng.randrange(14)}", rng.randrange(1999, 2003), rng.randrange(1, 13),
          Decimal(rng.randrange(-9999, 9999)) / 100) for _ in range(200)],
        "zid int, project string, ac_code string, year int, month int, value decimal(18,4)")
    projects = spark.createDataFrame([(1, "P"), (1, "Q"), (2, "P"), (2, "Q"), (2, "R")], "zid int, project string")
    args = (accounts, rollup, projects, {"K00": "01-1-Revenue", "K01": "02-1-Cost of Revenue"}, 2002, 3)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    lines = st.statement_lines(*args)
    grid = st.statement_yearly(*args).groupBy(*st.GROUP, "line").agg(F.sum("value").alias("value"))
    assert rows(lines) == rows(grid) and lines.filter("project = 'R'").count() > 0
    assert rows(st.income_statement(lines)) == rows(st.income_statement(st.statement_yearly(*args)))
