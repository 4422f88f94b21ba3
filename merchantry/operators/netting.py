"""Sales net of returns, by any dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from merchantry.functions import calendar, numeric
from merchantry.operators.figures import stored_figure
from merchantry.operators.prep import require_keys
from merchantry.session import cut_lineage, stored_instead

PERIOD = ["year", "month"]

# The report dimensions and the columns each one stands for.
DIMENSIONS = {
    "salesman": ["spid", "spname"],
    "area": ["area"],
    "customer": ["cusid", "cusname"],
    "product": ["itemcode", "itemname"],
    "product_group": ["itemgroup"],
}


def net_cells(
    sales: DataFrame,
    returns: DataFrame,
    keys: Sequence[str],
    sale_value: str = "totalsales",
    return_value: str = "treturnamt",
    add: bool = False,
) -> DataFrame:
    """Exact net per key: sales minus returns, or plus when the return value is an adjustment.

    Both sides are one signed stream, so keys found on either side stay and one
    aggregation does the work of two cross-tabs and their alignment.
    """
    keys = ["zid", *keys]
    factor = 1 if add else -1
    signed = (
        require_keys(sales, keys).select(*keys, F.col(sale_value).alias("amount"))
        .unionByName(
            require_keys(returns, keys).select(*keys, (F.col(return_value) * factor).alias("amount"))
        )
    )
    return signed.groupBy(*keys).agg(numeric.total(F.col("amount")).alias("net"))


def _rounded(name: str, digits: int | None):
    exact = F.col(name)
    return (exact if digits is None else numeric.half_even(exact, digits)).cast("double").alias(name)


def net_by_period(
    sales: DataFrame, returns: DataFrame, rows: Sequence[str], sale_value: str = "totalsales",
    return_value: str = "treturnamt", add: bool = False, digits: int | None = 0,
) -> DataFrame:
    """Long cross-tab rows x (year, month) with the row's grand total."""
    cells = net_cells(sales, returns, [*rows, *PERIOD], sale_value, return_value, add)
    # One row per month and report row: the window never holds more than the calendar.
    row = W.partitionBy("zid", *rows)
    return (
        cells.withColumn("grand_total", F.sum("net").over(row))
        .select("zid", *rows, *PERIOD, _rounded("net", digits), _rounded("grand_total", digits))
    )


def net_margin_by_period(sales: DataFrame, returns: DataFrame, rows: Sequence[str],
                         digits: int | None = 0) -> DataFrame:
    """Gross margin plus (return cost - return amount)."""
    adjusted = returns.withColumn("adjustment", F.col("returncost") - F.col("treturnamt"))
    return net_by_period(sales, adjusted, rows, "gross_margin", "adjustment", True, digits)


def net_wide(long: DataFrame, rows: Sequence[str], periods: Sequence[tuple[int, int]],
             month_major: bool = False) -> DataFrame:
    """Presentation form of net_by_period: a column yyyy_mm per period, largest total first."""
    order = sorted(periods, key=(lambda p: (p[1], p[0])) if month_major else (lambda p: p))
    labels = [f"{year}_{month:02d}" for year, month in order]
    label = F.concat_ws("_", F.col("year").cast("string"), F.lpad(F.col("month").cast("string"), 2, "0"))
    return (
        long.withColumn("_label", label)
        .groupBy("zid", *rows, "grand_total").pivot("_label", labels).agg(F.sum("net"))
        .fillna(0.0, labels)
        .select("zid", *rows, *labels, "grand_total")
        .orderBy("zid", F.desc("grand_total"), *rows)
    )


def periods_of(*frames: DataFrame) -> list[tuple[int, int]]:
    """Calendar months present in the frames: as many rows as months, whatever the volume."""
    months = None
    for df in frames:
        part = require_keys(df, PERIOD).select(*PERIOD).distinct()
        months = part if months is None else months.union(part)
    return sorted((r["year"], r["month"]) for r in months.distinct().collect())


def cross_relation(sales: DataFrame, returns: DataFrame, rows: str, columns: str,
                   digits: int | None = 0) -> DataFrame:
    """Net sales of any dimension against any other, in long form with row totals."""
    if rows == columns:
        raise ValueError("two different dimensions are needed")
    row_keys, column_keys = DIMENSIONS[rows], DIMENSIONS[columns]
    cells = net_cells(sales, returns, [*row_keys, *column_keys])
    totals = cells.groupBy("zid", *row_keys).agg(F.sum("net").alias("grand_total"))
    return cells.join(totals, ["zid", *row_keys]).select(
        "zid", *row_keys, *column_keys, _rounded("net", digits), _rounded("grand_total", digits)
    )


def _present(dimension: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in DIMENSIONS[dimension]])


def _with_totals(facts: DataFrame, digits: int | None) -> DataFrame:
    """Every fact with its totals: of each of its dimensions, over the facts that have the other one, as ``_a_b``. ``facts`` is a
    stored frame that only the caller knows; the result takes its place."""
    found = {}
    # Dimensions with names can have any number of members, so their totals may need an exchange; the others come last.
    for a in sorted(DIMENSIONS, key=lambda d: -len(DIMENSIONS[d])):
        keys, others = ["zid", *DIMENSIONS[a]], [b for b in DIMENSIONS if b != a]
        # Facts are summed once for each combination of dimensions they have, not once for each dimension.
        sums = facts.filter(_present(a)).groupBy(*keys, *[_present(b).alias(f"_{b}") for b in others]).agg(
            numeric.total(F.col("amount")).alias("net"))
        totals = sums.groupBy(*keys).agg(*[numeric.total(F.when(F.col(f"_{b}"), F.col("net"))).alias(f"_{a}_{b}") for b in others])
        totals = totals.select(*keys, *[_rounded(f"_{a}_{b}", digits) for b in others])
        found[a] = stored_figure(totals)
    named = [a for a in found if len(DIMENSIONS[a]) > 1]
    mixed = stored = facts
    for a, totals in found.items():
        mixed = mixed.join(totals, ["zid", *DIMENSIONS[a]], "left")
        # What one exchange left is gone before the next one; the last one's comes with the dimensions without names.
        if a in named[:-1]:
            mixed = stored = stored_instead(mixed, stored, "facts")
    return stored_instead(mixed, stored, "facts")


def cross_relations(sales: DataFrame, returns: DataFrame, digits: int | None = 0, steps: bool = False) -> DataFrame:
    """``cross_relation`` of every dimension against every other:
    (zid, row_dimension, column_dimension, row_id, row_name, column_id, column_name, net, grand_total).

    A pair and its mirror share their cells. Facts are derived once and meet the totals of their rows before they are
    grouped, so the cells, many times as many as the facts, are exchanged once and then are the result. With ``steps`` each
    pair's cells are stored by a job of their own, so that only one pair's exchange is on disk at a time. Of a dimension
    with one column, id and name are equal.
    """
    columns = [c for dimension in DIMENSIONS.values() for c in dimension]
    signed = (
        require_keys(sales, ["zid"]).select("zid", *columns, F.col("totalsales").alias("amount"))
        .unionByName(require_keys(returns, ["zid"]).select("zid", *columns, (-F.col("treturnamt")).alias("amount")))
    )
    facts = _with_totals(cut_lineage(signed, "facts"), digits)

    def entry(a: str, b: str) -> Column:
        ends = [(name, F.col(DIMENSIONS[d][i]).cast("string"))
                for side, d in (("row", a), ("column", b)) for name, i in ((f"{side}_id", 0), (f"{side}_name", -1))]
        return F.struct(F.lit(a).alias("row_dimension"), F.lit(b).alias("column_dimension"),
                        *[value.alias(name) for name, value in ends], F.col(f"_{a}_{b}").alias("grand_total"))

    def relations(a: str, b: str) -> DataFrame:
        # The totals are the same in all facts of a cell.
        cells = facts.filter(_present(a) & _present(b)).groupBy("zid", *DIMENSIONS[a], *DIMENSIONS[b]).agg(
            numeric.total(F.col("amount")).alias("net"), *[F.max(t).alias(t) for t in (f"_{a}_{b}", f"_{b}_{a}")])
        cells = cells.withColumn("net", _rounded("net", digits))
        cells = cut_lineage(cells, "cells") if steps else cells
        return cells.select("zid", "net", F.inline(F.array(entry(a, b), entry(b, a))))

    long = reduce(DataFrame.unionByName, [relations(a, b) for a, b in combinations(DIMENSIONS, 2)])
    return long.select("zid", "row_dimension", "column_dimension", "row_id", "row_name", "column_id", "column_name", "net", "grand_total")


def net_by_month(sales: DataFrame, returns: DataFrame, sale_value: str = "totalsales",
                 return_value: str = "treturnamt") -> DataFrame:
    """Sales, returns and net per month; months without any sale are left out."""
    keys = ["zid", *PERIOD]
    tagged = (
        require_keys(sales, keys).select(
            *keys, F.col(sale_value).alias("sold"), F.lit(None).alias("back"), F.lit(True).alias("sale"))
        .unionByName(require_keys(returns, keys).select(
            *keys, F.lit(None).alias("sold"), F.col(return_value).alias("back"), F.lit(False).alias("sale")))
    )
    monthly = tagged.groupBy(*keys).agg(
        numeric.total(F.col("sold")).alias("sales_value"),
        numeric.total(F.col("back")).alias("return_value"),
        F.bool_or("sale").alias("sale"),
    ).filter("sale")
    return monthly.select(
        *keys,
        F.col("sales_value").cast("double").alias("sales_value"),
        F.col("return_value").cast("double").alias("return_value"),
        (F.col("sales_value") - F.col("return_value")).cast("double").alias("net_sales"),
        F.concat_ws("_", calendar.month_name(F.col("month")), F.col("year").cast("string")).alias("xaxis"),
    )


def yoy_series(sales: DataFrame, returns: DataFrame, years: Sequence[int] | None = None,
               sale_value: str = "totalsales", return_value: str = "treturnamt") -> DataFrame:
    """Month by month beside the other years: long, or with a column per year when years are given."""
    long = net_by_month(sales, returns, sale_value, return_value).select(
        "zid", "month", "year", "net_sales", "xaxis"
    )
    if years is None:
        return long
    labels = [str(y) for y in years]
    return (
        long.groupBy("zid", "month").pivot("year", list(years)).agg(F.sum("net_sales"))
        .select("zid", "month", *[F.col(y).alias(f"y{y}") for y in labels])
    )
