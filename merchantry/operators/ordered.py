"""Order-dependent figures. Windows run over rows already combined per day or month, so a
group is never longer than the calendar, whatever share of the facts its key holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from merchantry.functions import numeric
from merchantry.operators.prep import require_keys


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``, as an aggregate: one candidate row per task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("row")).select(*keys, "row.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("row")).select(*keys, "row.*").select(*df.columns)


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows per group, ranked. Each task keeps k rows per group before the exchange."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def days_since_previous(df: DataFrame, keys: Sequence[str], date: str, tie: Sequence[str],
                        name: str) -> DataFrame:
    """Days to the previous row of the same key in (date, tie) order; 0 for the first.

    Rows sharing a date have gap 0 except the first of them, so the window only sees
    distinct dates.
    """
    days = df.groupBy(*keys, date).agg(F.min(F.struct(*tie)).alias("_first"))
    gap = F.datediff(F.col(date), F.lag(date).over(W.partitionBy(*keys).orderBy(date)))
    days = days.withColumn("_gap", F.coalesce(gap, F.lit(0)))
    leads = F.struct(*tie) == F.col("_first")
    return (
        df.join(days, [*keys, date])
        .withColumn(name, F.when(leads, F.col("_gap")).otherwise(0))
        .drop("_first", "_gap")
    )


def seasonal_mean(sales: DataFrame, share: int = 5) -> DataFrame:
    """Per item: mean monthly quantity over the months that reach 1/share of the plain mean."""
    keys = ["zid", "itemcode"]
    monthly = require_keys(sales, [*keys, "year", "month"]).groupBy(*keys, "year", "month").agg(
        numeric.total(F.col("quantity")).alias("quantity")
    )
    item = W.partitionBy(*keys)
    kept = (
        monthly.withColumn("months", F.count("*").over(item))
        .withColumn("all_months", F.sum("quantity").over(item))
        # quantity >= mean / share, without dividing
        .filter(F.col("quantity") * F.col("months") * share >= F.col("all_months"))
    )
    return kept.groupBy(*keys).agg(
        numeric.ratio(F.sum("quantity"), F.count("quantity")).alias("n_mean")
    )


def receivable_timeline(sales: DataFrame, returns: DataFrame, collections: DataFrame) -> DataFrame:
    """Per customer and day: the day's amounts, the last sale date so far and the receivable
    built up so far.

    On one day sales come before returns and returns before collections. Returns count once
    there has been a sale. Collections do not reduce the receivable.
    """
    keys = ["zid", "cusid", "date"]
    money = "decimal(18,4)"
    streams = [(sales, "totalsales", "sold"), (returns, "treturnamt", "returned"), (collections, "value", "collected")]
    events = None
    for df, value, name in streams:
        is_sale = name == "sold"
        part = require_keys(df, keys).select(
            *keys, F.col(value).cast(money).alias(name), F.lit(int(is_sale)).alias("sale_rows"),
            F.lit(int(name == "collected")).alias("collection_rows"))
        events = part if events is None else events.unionByName(part, allowMissingColumns=True)
    # A customer-day is one row from here on; nothing below meets a group longer than the calendar.
    daily = events.groupBy(*keys).agg(
        *[numeric.total(F.col(name)).alias(name) for _, _, name in streams],
        F.sum("sale_rows").alias("sale_rows"), F.sum("collection_rows").alias("collections"),
    )
    so_far = W.partitionBy("zid", "cusid").orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    sale_date = F.when(F.col("sale_rows") > 0, F.col("date"))
    counted_back = F.when(F.col("last_sale").isNotNull(), F.col("returned")).otherwise(0)
    return (
        daily.withColumn("last_sale", F.max(sale_date).over(so_far))
        .withColumn("receivable", F.sum(F.col("sold") - counted_back).over(so_far))
        .drop("sale_rows")
    )


def cumulative_by_month(df: DataFrame, keys: Sequence[str], value: str, last_month: DataFrame | None = None) -> DataFrame:
    """Balance per key and year up to each month 0..last month that has postings in the frame.

    ``last_month`` gives (zid, project, year, last_month); the default is the latest month
    found for the company, project and year.
    """
    scope = ["zid", "project", "year"]
    last = last_month if last_month is not None else df.groupBy(*scope).agg(F.max("month").alias("last_month"))
    monthly = df.groupBy(*scope, *keys, "month").agg(F.sum(value).alias(value))
    # One array of month sums per account and year (13 cells at most) instead of a grid join.
    cells = monthly.groupBy(*scope, *keys).agg(
        F.map_from_entries(F.collect_list(F.struct("month", value))).alias("cells")
    )
    zero = F.lit(0).cast(monthly.schema[value].dataType)
    running = F.aggregate(
        F.sequence(F.lit(0), F.col("month")),
        zero,
        lambda total, m: (total + F.coalesce(F.try_element_at(F.col("cells"), m), zero)).cast(
            monthly.schema[value].dataType),
    )
    return (
        cells.join(last, scope)
        .withColumn("month", F.explode(F.sequence(F.lit(0), F.col("last_month"))))
        .select(*scope, *keys, "month", running.alias(value))
    )


def period_diff(long: DataFrame, keys: Sequence[str], period: str, value: str, name: str = "change") -> DataFrame:
    """Change against the previous period of the same key; 0 for the first."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(period))
    return long.withColumn(name, F.coalesce(F.col(value) - before, F.lit(0)))


def previous_value(long: DataFrame, keys: Sequence[str], period: str, value: str, name: str) -> DataFrame:
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(period))
    return long.withColumn(name, before)
