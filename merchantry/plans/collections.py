"""How long customers take to pay, and cash flows over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.functions import calendar, numeric
from merchantry.operators import aggregate
from merchantry.operators.ordered import receivable_timeline
from merchantry.operators.prep import decimal_to_double, require_keys

CUSTOMER = ["zid", "cusid"]


def customer_names(customers: DataFrame) -> DataFrame:
    """The least name per customer, from sales or from a customer table; repeats go before names are compared."""
    named = require_keys(customers, CUSTOMER).filter(F.col("cusname").isNotNull())
    return named.select(*CUSTOMER, "cusname").distinct().groupBy(*CUSTOMER).agg(F.min("cusname").alias("cusname"))


def _counts() -> Column:
    """A day's collections count while there was a sale before and the receivable is positive."""
    return (F.col("collections") > 0) & F.col("last_sale").isNotNull() & (F.col("receivable") > 0)


def _day_sum() -> Column:
    return F.datediff("date", "last_sale") * F.col("collections")


def _customer_figures(timeline: DataFrame, names: DataFrame) -> DataFrame:
    """Name, totals and mean days per customer: the timeline is already laid out by customer, and the name comes last."""
    days = numeric.ratio(F.sum(F.when(_counts(), _day_sum())), F.sum(F.when(_counts(), F.col("collections"))))
    figures = decimal_to_double(timeline.groupBy(*CUSTOMER).agg(
        days.alias("average_days_to_collection"),
        F.sum("sold").alias("total_sale"), F.sum("returned").alias("total_return"),
        F.sum("collected").alias("total_collection"),
    )).filter(F.col("average_days_to_collection").isNotNull())
    return figures.join(customer_names(names), CUSTOMER, "left")


def collection_days(sales: DataFrame, returns: DataFrame, collections: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Average days to collection per customer, with the customer's totals. Each stream is read once; ``names`` is a
    customer table, without it the sales name the customers."""
    return _customer_figures(receivable_timeline(sales, returns, collections), sales if names is None else names)


def _monthly(timeline: DataFrame) -> DataFrame:
    return timeline.filter(_counts()).groupBy(
        *CUSTOMER, F.year("date").alias("year"), F.month("date").alias("month")
    ).agg(numeric.ratio(F.sum(_day_sum()), F.sum("collections")).alias("collection_days"))


def collection_days_by_month(sales: DataFrame, returns: DataFrame, collections: DataFrame) -> DataFrame:
    """Long form of the cross-tab: mean days per customer and month of collection."""
    return _monthly(receivable_timeline(sales, returns, collections))


def collection_days_pivot(sales: DataFrame, returns: DataFrame, collections: DataFrame,
                          periods: Sequence[tuple[int, int]] | None = None, names: DataFrame | None = None) -> DataFrame:
    """Mean days per customer and month, the mean of the non-zero months, and the totals.

    With ``periods`` the months become columns yyyy_mm; without, rows.
    """
    timeline = receivable_timeline(sales, returns, collections)
    monthly = _monthly(timeline)
    average = aggregate.row_mean_nonzero(monthly, CUSTOMER, "collection_days")
    if periods is None:
        cells = monthly
    else:
        labels = [f"{y}_{m:02d}" for y, m in sorted(periods)]
        label = F.concat_ws("_", F.col("year").cast("string"), F.lpad(F.col("month").cast("string"), 2, "0"))
        cells = aggregate.pivot_sum(monthly, CUSTOMER, label, labels, "collection_days")
    return (
        cells.join(average, CUSTOMER)
        .join(_customer_figures(timeline, sales if names is None else names).drop("average_days_to_collection"), CUSTOMER)
        .withColumn("average", numeric.zero_if_null(F.col("average"))))


def collection_gap(sales: DataFrame, collections: DataFrame) -> DataFrame:
    """Average days between a customer's collections, and the average collection.

    The gaps in date order add up to last minus first, so no ordering is needed.
    Customers never sold to are left out.
    """
    dated = require_keys(collections, [*CUSTOMER, "date"])
    grouped = dated.groupBy(*CUSTOMER).agg(
        numeric.ratio(F.datediff(F.max("date"), F.min("date")), F.count("date") - 1).alias("average_days_between"),
        numeric.ratio(F.sum("value"), F.count("value")).alias("average_collection"))
    return grouped.join(customer_names(sales), CUSTOMER).select(
        *CUSTOMER, "cusname", "average_days_between", "average_collection")


# Upper ends of the right-closed ranges of average days, and their names.
SEGMENT_EDGES = [0, 2, 5, 10, 20, 30, 50, 100]
SEGMENT_NAMES = [
    "0-2 days", "3-5 days", "6-10 days", "11-20 days", "21-30 days", "31-50 days", "51-100 days",
]


def segment_of(days: Column) -> Column:
    """Name of the range; 0 and everything above 100 has none."""
    name = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(SEGMENT_EDGES, SEGMENT_EDGES[1:], SEGMENT_NAMES))):
        name = F.when((days > low) & (days <= high), label).otherwise(name)
    return name


def collection_segments(average_days: DataFrame) -> DataFrame:
    """Customers and their totals per range of average days; every range is listed."""
    sums = ["total_sale", "total_return", "total_collection"]
    zero = [F.lit(0).cast(numeric.MONEY).alias(c) for c in sums]
    listed = average_days.select("zid").distinct().select(
        "zid", F.explode(F.array(*[F.lit(n) for n in SEGMENT_NAMES])).alias("range_of_average_days"),
        F.lit(0).alias("customers"), *zero)
    placed = average_days.select(
        "zid", segment_of(F.col("average_days_to_collection")).alias("range_of_average_days"),
        F.lit(1).alias("customers"), *[F.col(c).cast(numeric.MONEY) for c in sums]
    ).filter(F.col("range_of_average_days").isNotNull())
    return decimal_to_double(placed.unionByName(listed).groupBy("zid", "range_of_average_days").agg(
        F.sum("customers").alias("count"),
        F.sum("total_sale").alias("total_sales"), F.sum("total_return").alias("total_return"),
        F.sum("total_collection").alias("total_collection")))


# Flow measures and the column each stream carries them in.
FLOWS = {"totalsales": "totalsales", "treturnamt": "treturnamt", "value_collection": "value", "value_payment": "value"}


def _flows(streams: Sequence[DataFrame], bucket: Column, name: str) -> DataFrame:
    """Four streams, one aggregation: a bucket found in any of them is listed, 0 elsewhere."""
    tagged = None
    for df, (measure, column) in zip(streams, FLOWS.items()):
        value = F.abs(F.col(column)) if measure == "value_collection" else F.col(column)
        part = require_keys(df, ["date"]).select(
            "zid", bucket.alias(name), value.cast(numeric.MONEY).alias(measure))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    return decimal_to_double(tagged.groupBy("zid", name).agg(
        *[numeric.total(F.col(m)).alias(m) for m in FLOWS]))


def flow_by_timeframe(sales: DataFrame, returns: DataFrame, collections: DataFrame, payments: DataFrame,
                      timeframe: str = "Monthly") -> DataFrame:
    bucket = F.date_format(calendar.period_start(F.col("date"), timeframe), "yyyy-MM-dd")
    return _flows([sales, returns, collections, payments], bucket, "timeframe")


def flow_by_dom(sales: DataFrame, returns: DataFrame, collections: DataFrame, payments: DataFrame) -> DataFrame:
    return _flows([sales, returns, collections, payments], calendar.day_of_month(F.col("date")), "DOM")


def flow_by_dow(sales: DataFrame, returns: DataFrame, collections: DataFrame, payments: DataFrame) -> DataFrame:
    return _flows([sales, returns, collections, payments], calendar.day_name(F.col("date")), "DOW")


def flow_long(flows: DataFrame, bucket: str) -> DataFrame:
    return flows.unpivot(["zid", bucket], list(FLOWS), "category", "value")
