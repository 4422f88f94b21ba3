"""Sales net of returns."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame

from merchantry.cases import case
from merchantry.functions.calendar import MONTHS
from merchantry.operators import netting, prep
from merchantry.sources.driver_tables import DriverTables

YEARS = list(range(1995, 2002))
NEEDS = {"salesman": (False, True), "product": (True, False), "product_group": (True, False)}


def net_sql(rows: list[str], columns: list[str], sale: str = "totalsales", back: str = "treturnamt",
            operator: str = "-") -> str:
    """The two cross-tabs, aligned by a full join, as a report would do it by hand."""
    keys = ["zid", *rows, *columns]
    listed = ", ".join(keys)
    return f"""
    WITH sold AS (SELECT {listed}, sum({sale}) AS v FROM f_sales GROUP BY {listed}),
         back AS (SELECT {listed}, sum({back}) AS w FROM f_return GROUP BY {listed}),
         cells AS (SELECT {listed}, COALESCE(v, 0) {operator} COALESCE(w, 0) AS net FROM sold FULL JOIN back USING ({listed}))
    SELECT {listed}, round_even(CAST(net AS DOUBLE), 0) AS net,
           round_even(CAST(sum(net) OVER (PARTITION BY {", ".join(["zid", *rows])}) AS DOUBLE), 0) AS grand_total
    FROM cells"""


PERIOD = ["year", "month"]
for _name, _dims in netting.DIMENSIONS.items():
    def _sales(t: DriverTables, name: str = _name) -> DataFrame:
        need = NEEDS.get(name, (False, False))
        return netting.net_by_period(t.sales(*need), t.returns(*need), netting.DIMENSIONS[name])

    def _margin(t: DriverTables, name: str = _name) -> DataFrame:
        people = NEEDS.get(name, (False, False))[1]
        return netting.net_margin_by_period(
            prep.derive_margin(t.sales(True, people)), t.returns(True, people), netting.DIMENSIONS[name])

    def _yoy(t: DriverTables, name: str = _name) -> DataFrame:
        people = NEEDS.get(name, (False, False))[1]
        return netting.net_by_period(
            prep.derive_margin(t.sales(True, people)), t.returns(True, people), netting.DIMENSIONS[name],
            "gross_margin", "treturnamt")

    case(f"net_sales_by_{_name}", net_sql(_dims, PERIOD))(_sales)
    case(f"net_margin_by_{_name}", net_sql(_dims, PERIOD, "gross_margin", "returncost - treturnamt", "+"))(_margin)
    case(f"yoy_margin_by_{_name}", net_sql(_dims, PERIOD, "gross_margin", "treturnamt"))(_yoy)


@case("net_quantity_by_product", net_sql(["itemcode", "itemname"], PERIOD, "quantity", "returnqty"))
def net_quantity_by_product(t: DriverTables) -> DataFrame:
    return netting.net_by_period(
        t.sales(True, False), t.returns(True, False), ["itemcode", "itemname"], "quantity", "returnqty")


_WIDE = ", ".join(
    f"COALESCE(sum(CASE WHEN year = {y} AND month = {m} THEN net END), 0) AS \"{y}_{m:02d}\""
    for y in YEARS for m in range(1, 13))


@case("net_pivot", f"""
    SELECT zid, area, {_WIDE}, grand_total FROM ({net_sql(["area"], PERIOD)}) GROUP BY zid, area, grand_total""")
def net_pivot(t: DriverTables) -> DataFrame:
    long = netting.net_by_period(t.sales(False, False), t.returns(False, False), ["area"])
    return netting.net_wide(long, ["area"], [(y, m) for y in t.years for m in range(1, 13)])


@case("yoy_pivots", f"""
    SELECT zid, itemgroup, {_WIDE}, grand_total
    FROM ({net_sql(["itemgroup"], PERIOD, "gross_margin", "treturnamt")}) GROUP BY zid, itemgroup, grand_total""")
def yoy_pivots(t: DriverTables) -> DataFrame:
    long = netting.net_by_period(
        prep.derive_margin(t.sales(True, False)), t.returns(True, False), ["itemgroup"], "gross_margin", "treturnamt")
    return netting.net_wide(long, ["itemgroup"], [(y, m) for y in t.years for m in range(1, 13)], month_major=True)


for _rows, _columns in itertools.permutations(netting.DIMENSIONS, 2):
    if (_rows, _columns) == ("salesman", "area"):
        continue  # registered as cross_relation
    def _cross(t: DriverTables, rows: str = _rows, columns: str = _columns) -> DataFrame:
        items = "product" in rows or "product" in columns
        people = "salesman" in (rows, columns)
        return netting.cross_relation(t.sales(items, people), t.returns(items, people), rows, columns)
    case(f"cross_relation_{_rows}_{_columns}", net_sql(netting.DIMENSIONS[_rows], netting.DIMENSIONS[_columns]))(_cross)


@case("cross_relation", net_sql(["spid", "spname"], ["area"]))
def cross_relation(t: DriverTables) -> DataFrame:
    return netting.cross_relation(t.sales(False, True), t.returns(False, True), "salesman", "area")


def _cross_sql(rows: str, columns: str) -> str:
    row_keys, column_keys = netting.DIMENSIONS[rows], netting.DIMENSIONS[columns]
    listed = ", ".join(["zid", *row_keys, *column_keys])
    return f"""
    SELECT zid, '{rows}' AS row_dimension, '{columns}' AS column_dimension,
           CAST({row_keys[0]} AS VARCHAR) AS row_id, CAST({row_keys[-1]} AS VARCHAR) AS row_name,
           CAST({column_keys[0]} AS VARCHAR) AS column_id, CAST({column_keys[-1]} AS VARCHAR) AS column_name,
           round_even(CAST(net AS DOUBLE), 0) AS net,
           round_even(CAST(sum(net) OVER (PARTITION BY zid, {", ".join(row_keys)}) AS DOUBLE), 0) AS grand_total
    FROM (SELECT {listed}, sum(amount) AS net FROM signed GROUP BY {listed})"""


_ALL_KEYS = ", ".join(["zid", *[c for keys in netting.DIMENSIONS.values() for c in keys]])


# The union of the single reports over one signed table.
@case("cross_relations", f"""
    WITH signed AS MATERIALIZED (
        SELECT {_ALL_KEYS}, totalsales AS amount FROM f_sales UNION ALL SELECT {_ALL_KEYS}, -treturnamt FROM f_return)
    """ + " UNION ALL ".join(_cross_sql(a, b) for a, b in itertools.permutations(netting.DIMENSIONS, 2)))
def cross_relations(t: DriverTables) -> DataFrame:
    return netting.cross_relations(t.sales(True, True), t.returns(True, True), steps=True)


def month_sql(sale: str, back: str) -> str:
    names = ", ".join(f"'{m}'" for m in MONTHS)
    return f"""
    SELECT s.zid, s.year, s.month, CAST(v AS DOUBLE) AS sales_value, CAST(COALESCE(w, 0) AS DOUBLE) AS return_value,
           CAST(v - COALESCE(w, 0) AS DOUBLE) AS net_sales, [{names}][s.month] || '_' || s.year AS xaxis
    FROM (SELECT zid, year, month, sum({sale}) AS v FROM f_sales GROUP BY zid, year, month) s
    LEFT JOIN (SELECT zid, year, month, sum({back}) AS w FROM f_return GROUP BY zid, year, month) r
      ON s.zid = r.zid AND s.year = r.year AND s.month = r.month"""


@case("net_by_month", month_sql("totalsales", "treturnamt"))
def net_by_month(t: DriverTables) -> DataFrame:
    return netting.net_by_month(t.sales(False, False), t.returns(False, False))


@case("net_margin_by_month", month_sql("gross_margin", "treturnamt"))
def net_margin_by_month(t: DriverTables) -> DataFrame:
    return netting.net_by_month(prep.derive_margin(t.sales(True, False)), t.returns(True, False), "gross_margin")


@case("net_sales_series", f"SELECT zid, year, month, net_sales FROM ({month_sql('totalsales', 'treturnamt')})")
def net_sales_series(t: DriverTables) -> DataFrame:
    return netting.net_by_month(t.sales(False, False), t.returns(False, False)).select(
        "zid", "year", "month", "net_sales")


_BY_YEAR = ", ".join(f"sum(CASE WHEN year = {y} THEN net_sales END) AS y{y}" for y in YEARS)


@case("yoy_series", f"""
    SELECT zid, month, {_BY_YEAR} FROM ({month_sql('totalsales', 'treturnamt')}) GROUP BY zid, month""")
def yoy_series(t: DriverTables) -> DataFrame:
    return netting.yoy_series(t.sales(False, False), t.returns(False, False), t.years)


@case("yoy_series_margin", f"""
    SELECT zid, month, year, net_sales, xaxis FROM ({month_sql('gross_margin', 'treturnamt')})""")
def yoy_series_margin(t: DriverTables) -> DataFrame:
    return netting.yoy_series(
        prep.derive_margin(t.sales(True, False)), t.returns(True, False), None, "gross_margin")
