"""Summaries, ratios, statistics and histograms of sales and returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.functions import calendar, numeric
from merchantry.operators import aggregate
from merchantry.operators.netting import PERIOD
from merchantry.operators.prep import decimal_to_double, require_keys
from merchantry.operators.figures import stored_figure
from merchantry.session import cut_lineage


def sales_summary(sales: DataFrame, returns: DataFrame) -> DataFrame:
    """Nine totals per company."""
    sold = sales.groupBy("zid").agg(
        numeric.total(F.col("totalsales")).alias("total_sales"),
        F.count_distinct("voucher").alias("number_of_orders"),
        F.count_distinct("cusid").alias("number_of_customers"),
        F.count_distinct("itemcode").alias("number_of_products"))
    back = returns.groupBy("zid").agg(
        numeric.total(F.col("treturnamt")).alias("total_returns"),
        F.count_distinct("revoucher").alias("number_of_returns"),
        F.count_distinct("cusid").alias("number_of_customers_returned"),
        F.count_distinct("itemcode").alias("number_of_products_returned"))
    both = sold.join(back, "zid", "full").fillna(0)
    sales_total, return_total = F.col("total_sales"), F.col("total_returns")
    return both.select(
        "zid", numeric.half_even(sales_total, 2).cast("double").alias("total_sales"),
        numeric.half_even(return_total, 2).cast("double").alias("total_returns"),
        (sales_total - numeric.half_even(return_total, 2)).cast("double").alias("net_sales"),
        "number_of_orders", "number_of_returns", "number_of_customers", "number_of_customers_returned",
        "number_of_products", "number_of_products_returned")


def margin_summary(sales: DataFrame, returns: DataFrame) -> DataFrame:
    """Sales, returns, return cost, net sales and gross margin per company."""
    sold = sales.groupBy("zid").agg(
        numeric.total(F.col("totalsales")).alias("total_sales"),
        numeric.total(F.col("gross_margin")).alias("margin"))
    back = returns.groupBy("zid").agg(
        numeric.total(F.col("treturnamt")).alias("total_returns"),
        numeric.total(F.col("returncost")).alias("total_return_cost"))
    both = sold.join(back, "zid", "full").fillna(0)
    return decimal_to_double(both.select(
        "zid", "total_sales", "total_returns", "total_return_cost",
        (F.col("total_sales") - F.col("total_returns")).alias("net_sales"),
        (F.col("margin") + F.col("total_return_cost") - F.col("total_returns")).alias("total_gross_margin")))


# The ratios a report shows, each with its numerator and denominator.
RATIOS = {
    "Net Sales per Order": ("net_sales", "orders"),
    "Net Sales per Customer": ("net_sales", "customers"),
    "Orders per Customer": ("orders", "customers"),
    "Returns per Customer Return": ("customer_returns", "returns"),
    "Orders to Returns Ratio": ("returns", "orders"),
    "Customers to Customer Returns Ratio": ("customer_returns", "customers"),
}


def sales_ratios(sales: DataFrame, returns: DataFrame, digits: int = 2) -> DataFrame:
    """Six ratios per company and month, long: (zid, period, ratio, value).

    Orders and returns count rows. A month without sales has net sales 0.
    """
    keys = ["zid", *PERIOD]
    sold = require_keys(sales, keys).groupBy(*keys).agg(
        F.count("*").alias("orders"), F.count_distinct("cusid").alias("customers"),
        numeric.total(F.col("totalsales")).alias("sold"))
    back = require_keys(returns, keys).groupBy(*keys).agg(
        F.count("*").alias("returns"), F.count_distinct("cusid").alias("customer_returns"),
        numeric.total(F.col("treturnamt")).alias("back"))
    # Both sides are one row per month by now.
    merged = sold.join(back, keys, "full").withColumn(
        "net_sales", F.when(F.col("sold").isNotNull(), F.col("sold") - numeric.zero_if_null(F.col("back"))))
    merged = merged.fillna(0)
    cells = [
        numeric.half_even(F.col(top).cast("double") / numeric.zero_as_one(F.col(bottom)), digits).alias(name)
        for name, (top, bottom) in RATIOS.items()
    ]
    period = calendar.period_label(F.col("year"), F.col("month")).alias("period")
    return merged.select("zid", period, *cells).unpivot(["zid", "period"], list(RATIOS), "ratio", "value")


def ratios_wide(long: DataFrame, periods: Sequence[str]) -> DataFrame:
    return aggregate.pivot_first(long, ["zid", "ratio"], "period", periods, "value")


# Time grains and the columns each one groups by.
TIMINGS = {
    "Year/Month/Date": ["year", "month", "DOM"],
    "Year/Month/Day": ["year", "month", "DOW"],
    "Year/Month": ["year", "month"],
    "Year/Date": ["year", "DOM"],
    "Year/Day": ["year", "DOW"],
    "Month/Date": ["month", "DOM"],
    "Month/Day": ["month", "DOW"],
    "Month": ["month"],
    "Year": ["year"],
    "Date": ["DOM"],
    "Day": ["DOW"],
}
METRICS = {
    "Orders": "voucher", "Customers": "cusid", "Products": "itemcode",
    "Sales": "totalsales", "Return": "treturnamt", "Margins": "gross_margin",
}
MONEY_METRICS = ["Sales", "Return", "Margins"]


def _grain(df: DataFrame, metric: str, timing: str, perspective: str, two_level: bool) -> tuple[DataFrame, list[str]]:
    if not set(TIMINGS[perspective]) <= set(TIMINGS[timing]):
        raise ValueError(f"{perspective} is not a coarser view of {timing}")
    fine = ["zid", *TIMINGS[timing]]
    coarse = ["zid", *TIMINGS[perspective]]
    column = METRICS[metric]
    if metric in MONEY_METRICS:
        # Amounts stay exact decimals up to the statistic.
        summed = require_keys(df, fine).groupBy(*fine).agg(numeric.total(F.col(column)).alias("value"))
        return summed, coarse
    counted = aggregate.nunique_by(df, fine, column, "value")
    if two_level:
        return counted, coarse
    # Distinct counts are added up to the coarse grain before any statistic.
    return aggregate.sum_by(counted, coarse, "value"), coarse


def descriptive_stats(df: DataFrame, metric: str, timing: str, perspective: str, statistic: str,
                      two_level: bool = False) -> DataFrame:
    """Mean or Median of the timing-grain figures seen from the coarser perspective; Total
    shows the figures themselves. ``two_level`` averages distinct counts instead of adding them up.
    """
    grouped, coarse = _grain(df, metric, timing, perspective, two_level)
    if statistic == "Total":
        return grouped.withColumn("value", F.col("value").cast("double"))
    # At most one row per calendar day goes into each group here.
    mean = numeric.ratio(F.sum("value"), F.count("value"))
    figure = mean if statistic == "Mean" else F.median(F.col("value").cast("double"))
    return grouped.groupBy(*coarse).agg(figure.alias("value"))


def descriptive_spread(df: DataFrame, metric: str, timing: str, perspective: str,
                       two_level: bool = False, digits: int = 2) -> DataFrame:
    """Spread of the figures behind descriptive_stats, per company."""
    grouped, _ = _grain(df, metric, timing, perspective, two_level)
    return aggregate.spread_stats(grouped, ["zid"], "value", digits)


# Columns of the distribution page with the metrics each one offers.
DISTRIBUTIONS = {
    "Customer": ["Voucher Count", "Sales", "Returns", "Margin", "Cost"],
    "Products": ["Counts", "Sales", "Returns", "Cost", "Margin", "Quantity"],
    "Sales": ["Voucher", "Counts"],
    "Returns": ["Voucher", "Counts"],
    "Cost": ["Voucher", "Counts"],
    "Margin": ["Voucher", "Counts"],
    "Quantity": ["Counts"],
}
DISTRIBUTION_COLUMNS = {
    "Customer": "cusid", "Products": "itemcode", "Sales": "totalsales", "Returns": "treturnamt",
    "Cost": "cost", "Quantity": "quantity", "Margin": "gross_margin",
}


def distribution(sales: DataFrame, returns: DataFrame, column: str, metric: str) -> DataFrame:
    """One figure per entity: (zid, entity, value)."""
    if metric not in DISTRIBUTIONS[column]:
        raise ValueError(f"{column} offers {DISTRIBUTIONS[column]}")
    on_returns = "Returns" in (column, metric)
    df = returns if on_returns else sales
    subject = DISTRIBUTION_COLUMNS[column]
    voucher = "revoucher" if on_returns else "voucher"
    if metric == "Counts":
        result = aggregate.value_counts(df, subject).withColumnsRenamed({subject: "entity", "count": "value"})
    elif metric == "Voucher Count":
        result = aggregate.nunique_by(df, ["zid", subject], voucher, "value").withColumnRenamed(subject, "entity")
    elif metric == "Voucher":
        result = aggregate.sum_by(df, ["zid", voucher], subject, "value").withColumnRenamed(voucher, "entity")
    else:
        value = DISTRIBUTION_COLUMNS[metric]
        result = aggregate.sum_by(df, ["zid", subject], value, "value").withColumnRenamed(subject, "entity")
    return result.select("zid", "entity", F.col("value").cast("double").alias("value")) \
        .transform(decimal_to_double)


def histogram_bins(values: DataFrame, include_outliers: bool = False) -> DataFrame:
    """Left-closed bins of about a hundredth of the range, from 0, empty ones included.

    Negative values and values at or beyond the last edge are in no bin unless
    ``include_outliers`` adds one bin below and one above.
    """
    values = cut_lineage(values.select("zid", "value"))
    span = values.groupBy("zid").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    width = F.greatest((F.col("high") - F.col("low")) / 100, F.lit(1.0)).cast("long")
    edges = stored_figure(
        span.withColumn("width", width)
        .withColumn("stop", F.col("high").cast("long") + F.col("width"))
        # edges 0, w, 2w ... below stop leave ceil(stop / w) - 1 bins
        .withColumn("bins", F.greatest(F.ceil(F.col("stop") / F.col("width")) - 1, F.lit(0)))
        .select("zid", "width", "bins")
    )
    bin_no = F.floor(F.col("value") / F.col("width"))
    low = F.when(F.col("value") < 0, F.lit(-1))
    high = F.when(bin_no >= F.col("bins"), F.col("bins"))
    counted = (
        values.join(edges, "zid").withColumn("bin", F.coalesce(low, high, bin_no))
        .groupBy("zid", "bin").agg(F.count("*").alias("count"))
    )
    # Two nested ranges: a company with very many bins is spread out without one huge array.
    chunk = 1000
    grid = (
        edges.filter(F.col("bins") > 0)
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("bins") - 1) / chunk))))
        .withColumn("bin", F.explode(F.sequence(
            F.col("block") * chunk, F.least((F.col("block") + 1) * chunk, F.col("bins")) - 1)))
        .select("zid", "width", "bin")
    )
    start = (F.col("bin") * F.col("width")).cast("double")
    inside = grid.join(counted, ["zid", "bin"], "left").select(
        "zid", start.alias("bin_start"), (start + F.col("width")).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("count"))
    if not include_outliers:
        return inside
    outer = counted.join(edges, "zid").filter((F.col("bin") < 0) | (F.col("bin") >= F.col("bins")))
    return inside.unionByName(outer.select(
        "zid", F.when(F.col("bin") >= 0, start).alias("bin_start"),
        F.when(F.col("bin") < 0, F.lit(0.0)).alias("bin_end"), "count"))
