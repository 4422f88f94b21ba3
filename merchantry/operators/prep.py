"""Filters, coercions and derived columns applied before any report."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.functions import calendar, codes, numeric
from merchantry.operators.figures import stored_figure

# The page filters, in the order they are applied.
CASCADE = ["year", "month", "spid", "cusid", "itemcode", "area", "itemgroup"]

# Item groups that purchasing plans for.
PLANNED_ITEM_GROUPS = [
    "Finished Goods Packaging", "RAW Material Packaging", "Furniture Fittings", "Hardware",
    "Industrial & Household", "Sanitary",
]


def filter_in(df: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """Keep rows whose column is among values; nothing selected keeps everything."""
    return df.filter(F.col(column).isin(list(values))) if values else df


def cascading_filters(
    sales: DataFrame, returns: DataFrame, selected: Mapping[str, Sequence]
) -> tuple[DataFrame, DataFrame]:
    """The same selections on sales and returns. Pairs are selected by id, not by name."""
    unknown = set(selected) - set(CASCADE)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    for column in CASCADE:
        sales = filter_in(sales, column, selected.get(column))
        returns = filter_in(returns, column, selected.get(column))
    return sales, returns


def latest_years(df: DataFrame, years: int = 2) -> DataFrame:
    """Per company: rows of the last ``years`` calendar years present in df."""
    last = stored_figure(df.groupBy("zid").agg(F.max("year").alias("last_year")))
    return (
        df.join(last, "zid")
        .filter(F.col("year").between(F.col("last_year") - (years - 1), F.col("last_year")))
        .drop("last_year")
    )


def filter_options(df: DataFrame, column: str) -> DataFrame:
    return df.select("zid", column).distinct()


def pair_options(df: DataFrame, identifier: str, name: str) -> DataFrame:
    """Distinct 'id - name' texts to choose from."""
    return (
        df.select("zid", identifier, name).distinct()
        .select("zid", codes.id_and_name(F.col(identifier), F.col(name)).alias("option"))
    )


def collection_filters(
    sales: DataFrame,
    returns: DataFrame,
    collections: DataFrame,
    payments: DataFrame,
    years: Sequence | None = None,
    months: Sequence | None = None,
    customers: Sequence | None = None,
    salespeople: Sequence | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Selections of the collection page.

    Collections carry no salesperson: they follow the customers those salespeople sold to
    (in all sales, before any other selection). Payments carry neither customer nor
    salesperson and are only narrowed in time.
    """
    served = sales
    frames = [
        filter_in(filter_in(df, "year", years), "month", months)
        for df in (sales, returns, collections, payments)
    ]
    frames[:3] = [filter_in(df, "cusid", customers) for df in frames[:3]]
    frames[:2] = [filter_in(df, "spid", salespeople) for df in frames[:2]]
    if salespeople:
        buyers = filter_in(served, "spid", salespeople).select("zid", "cusid").distinct()
        frames[2] = frames[2].join(buyers, ["zid", "cusid"], "left_semi")
    return tuple(frames)


def trailing_window(sales: DataFrame, purchases: DataFrame, years: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per company: sales and receipts after (last sale date - 365 * years), and that cutoff.

    A receipt also needs its voucher and its date.
    """
    cutoff = stored_figure(
        sales.groupBy("zid").agg(F.date_sub(F.max("date"), 365 * years).alias("cutoff"))
    )
    # The least cutoff of all companies reaches the scans as a literal; each company's own follows by the join.
    least = cutoff.agg(F.min("cutoff")).first()[0]
    if least is not None:
        sales, purchases = sales.filter(F.col("date") > F.lit(least)), purchases.filter(F.col("combinedate") > F.lit(least))
    recent_sales = sales.join(cutoff, "zid").filter(F.col("date") > F.col("cutoff")).drop("cutoff")
    received = (
        purchases.filter(F.col("grnvoucher").isNotNull() & F.col("combinedate").isNotNull())
        .join(cutoff, "zid").filter(F.col("combinedate") > F.col("cutoff")).drop("cutoff")
    )
    return recent_sales, received, cutoff


def open_orders(purchases: DataFrame, cutoff: DataFrame) -> DataFrame:
    """Orders not received yet, dated after the company's cutoff."""
    return (
        purchases.filter(F.col("grnvoucher").isNull() & F.col("combinedate").isNotNull())
        .join(cutoff, "zid").filter(F.col("combinedate") > F.col("cutoff")).drop("cutoff")
    )


def item_group_filter(stock: DataFrame, groups: Sequence[str] = PLANNED_ITEM_GROUPS) -> DataFrame:
    return stock.filter(F.col("itemgroup").isin(list(groups)))


def coerce_numeric(df: DataFrame, except_columns: Iterable[str], as_type: str = "double") -> DataFrame:
    """Every other column to a number; text that is no number becomes null."""
    keep = set(except_columns)
    return df.select([
        F.col(c) if c in keep else numeric.to_number(F.col(c).cast("string"), as_type).alias(c)
        for c in df.columns
    ])


def coerce_dates(df: DataFrame, column: str = "date") -> DataFrame:
    """Column to a date; rows without a valid one are dropped."""
    as_date = F.col(column).cast("string").try_cast("timestamp_ntz").cast("date")
    return df.withColumn(column, as_date).filter(F.col(column).isNotNull())


def derive_margin(sales: DataFrame) -> DataFrame:
    return sales.withColumns({
        "gross_margin": F.col("totalsales") - F.col("cost"),
        "rate": numeric.ratio(F.col("totalsales"), F.col("quantity")),
    })


def derive_calendar(df: DataFrame) -> DataFrame:
    """Day of month, day name, and the month as its name (its number stays in month_no)."""
    return df.withColumns({
        "DOM": calendar.day_of_month(F.col("date")),
        "DOW": calendar.day_name(F.col("date")),
        "month_no": F.col("month"),
        "month": calendar.month_name(F.col("month")),
    })


def sanitize_numbers(df: DataFrame, columns: Iterable[str], digits: int = 0) -> DataFrame:
    """Infinite and missing to 0, the rest rounded half to even."""
    return df.withColumns({c: numeric.clean_number(F.col(c), digits) for c in columns})


def decimal_to_double(df: DataFrame) -> DataFrame:
    return df.select([
        F.col(name).cast("double").alias(name) if kind.startswith("decimal") else F.col(name)
        for name, kind in df.dtypes
    ])


def require_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop rows with a null key: they belong to no group of a report."""
    if not keys:
        return df
    return df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
