"""Grouped figures. All of them combine on the map side, so a hot group costs one row per task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from merchantry.functions import numeric
from merchantry.operators.prep import decimal_to_double, require_keys
from merchantry.operators.figures import stored_figure
from merchantry.session import cut_lineage


def sum_by(df: DataFrame, keys: Sequence[str], value: str, name: str | None = None) -> DataFrame:
    name = name or value
    grouped = require_keys(df, keys).groupBy(*keys).agg(numeric.total(F.col(value)).alias(name))
    return decimal_to_double(grouped)


def nunique_by(df: DataFrame, keys: Sequence[str], value: str, name: str | None = None) -> DataFrame:
    return require_keys(df, keys).groupBy(*keys).agg(F.count_distinct(value).alias(name or value))


def mean_by(df: DataFrame, keys: Sequence[str], value: str, name: str | None = None) -> DataFrame:
    mean = numeric.ratio(F.sum(value), F.count(value))
    return require_keys(df, keys).groupBy(*keys).agg(mean.alias(name or value))


def _narrowed(facts: DataFrame, bounds: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """One round of ``quantiles_by``: the bounds shrink to the least and greatest value of the bin that holds the rank."""
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    # Bounds far apart would overflow as a difference; half of each does not.
    scale = F.when(finite(hi - lo), 1.0).otherwise(0.5)
    place = F.floor((v * scale - lo * scale) / (hi * scale - lo * scale) * bins)
    # An infinite bound and NaN, the greatest value of all, are bins of their own until the bounds are finite.
    unbounded = F.when(F.isnan(v), 3).when(v == float("inf"), 2).when(v == -float("inf"), 0).otherwise(1)
    bin_no = F.when(finite(lo) & finite(hi), F.least(place, F.lit(bins - 1))).otherwise(unbounded)
    group = [*keys, "quantile"]
    counted = (
        facts.join(bounds, list(keys)).filter((v >= lo) & (v <= hi)).withColumn("bin", bin_no)
        .groupBy(*group, "bin").agg(
            F.sum("copies").alias("copies"), F.min("v").alias("least"), F.max("v").alias("greatest"))
    )
    # A group has at most ``bins`` rows by now, however many values it has.
    running = W.partitionBy(*group).orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        counted.withColumn("inside", F.sum("copies").over(running))
        .join(bounds, group)
        .filter((F.col("rank") <= F.col("below") + F.col("inside"))
                & (F.col("rank") > F.col("below") + F.col("inside") - F.col("copies")))
        .select(*group, "q", "n", "rank", F.col("least").alias("lo"), F.col("greatest").alias("hi"),
                (F.col("below") + F.col("inside") - F.col("copies")).alias("below"),
                (F.col("below") + F.col("inside")).alias("upto"))
    )


def quantiles_by(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float],
                 accuracy: int = 10_000) -> DataFrame:
    """Exact linear-interpolated quantiles per group, for groups of any size, by refined histograms.

    Values become rows (group, value, copies) once. Between its bounds, each quantile's group is counted in ``accuracy``
    bins of equal width; the bin that holds the wanted rank gives the next bounds, its least and greatest value. The
    first and last bin always hold a value each, so bounds shrink in every round; a quantile is found when they are
    equal. The upper neighbour that interpolation needs is the least value above. No group is ever ranked.

    Nulls are left out, NaN counts as the greatest value; a group without values has no row.
    """
    keys = list(keys)
    values = require_keys(df.select(*keys, F.col(value).cast("double").alias("v")), [*keys, "v"])
    facts = cut_lineage(values.groupBy(*keys, "v").agg(F.count("*").alias("copies")), "values")
    names = list(quantiles)
    wanted = F.array(*[F.struct(F.lit(name).alias("quantile"), F.lit(float(q)).alias("q")) for name, q in quantiles.items()])
    ends = facts.groupBy(*keys).agg(F.sum("copies").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    bounds = stored_figure(
        ends.select(*keys, "n", "lo", "hi", F.inline(wanted))
        .withColumn("rank", F.floor(F.col("q") * (F.col("n") - 1)) + 1)
        .withColumn("below", F.lit(0).cast("long")).withColumn("upto", F.col("n")))
    found = bounds.filter("lo = hi")
    # Rounds follow the spread of the values, not their number: a factor of ``accuracy`` of the range each.
    while not (open_ones := bounds.filter("lo != hi")).isEmpty():
        bounds = stored_figure(_narrowed(facts, open_ones, keys, accuracy))
        found = found.unionByName(bounds.filter("lo = hi").select(found.columns))
    found = stored_figure(found.withColumn("position", F.col("q") * (F.col("n") - 1)))
    # Only where the next rank is not a copy of the same value does the neighbour matter.
    apart = found.filter(F.col("upto") < F.ceil("position") + 1).select(*keys, "quantile", F.col("lo").alias("lower"))
    above = (
        facts.join(apart, keys).filter(F.col("v") > F.col("lower"))
        .groupBy(*keys, "quantile").agg(F.min("v").alias("upper"))
    )
    share = F.col("position") - F.floor("position")
    # Equal neighbours are the value itself, also where it is infinite.
    figure = F.when(F.col("upper").isNull() | (share == 0), F.col("lo")).otherwise(
        F.col("lo") * (1 - share) + F.col("upper") * share)
    return (
        found.join(above, [*keys, "quantile"], "left").withColumn("figure", figure)
        .groupBy(*keys).pivot("quantile", names).agg(F.first("figure"))
    )


def median_by(df: DataFrame, keys: Sequence[str], value: str, name: str | None = None) -> DataFrame:
    return quantiles_by(df, keys, value, {name or value: 0.5})


def spread_stats(df: DataFrame, keys: Sequence[str], value: str, digits: int = 2) -> DataFrame:
    """Variance, deviation, range, interquartile range, skewness and kurtosis per group.

    Meant for figures already summed per calendar period, so a group has at most one row per
    day and the exact percentiles stay small. For groups of raw rows use quantiles_by.
    """
    v = F.col(value).cast("double")
    figures = {
        "variance": F.var_samp(v),
        "std_dev": F.stddev_samp(v),
        "minimum": F.min(v),
        "maximum": F.max(v),
        "iqr": F.percentile(v, 0.75) - F.percentile(v, 0.25),
        "skew": numeric.skewness_unbiased(v),
        "kurt": numeric.kurtosis_unbiased(v),
    }
    return require_keys(df, keys).groupBy(*keys).agg(
        *[numeric.half_even(figure, digits).alias(name) for name, figure in figures.items()]
    )


def value_counts(df: DataFrame, column: str, keys: Sequence[str] = ("zid",)) -> DataFrame:
    return require_keys(df, [*keys, column]).groupBy(*keys, column).agg(F.count("*").alias("count"))


def rows_by_period(df: DataFrame, name: str) -> DataFrame:
    return require_keys(df, ["zid", "year", "month"]).groupBy("zid", "year", "month").agg(
        F.count("*").alias(name)
    )


def distinct_by_period(df: DataFrame, figures: dict[str, str]) -> DataFrame:
    """Different values per month: (zid, year, month, figure, n). ``figures`` maps names to columns.

    Each figure is an aggregate of its own over its column, so no row is multiplied; a task exchanges a value once,
    however often it occurs there. ``operators/distinct`` gives counts that can be merged over months.
    """
    keys = ["zid", "year", "month"]
    parts = [nunique_by(df, keys, c, "n").select(*keys, F.lit(name).alias("figure"), "n") for name, c in figures.items()]
    return reduce(DataFrame.unionByName, parts)


def multi_agg(df: DataFrame, keys: Sequence[str], count: str, sums: Sequence[str]) -> DataFrame:
    """A count of one column beside sums of others."""
    return decimal_to_double(require_keys(df, keys).groupBy(*keys).agg(
        F.count(count).alias("count"),
        *[numeric.total(F.col(c)).alias(f"total_{c}") for c in sums],
    ))


def signed_sum(df: DataFrame, keys: Sequence[str], values: dict[str, str], sign: str = "sign") -> DataFrame:
    """Net of in- and outgoing movements: sum of value times sign."""
    return df.groupBy(*keys).agg(
        *[numeric.total(F.col(v) * F.col(sign)).alias(name) for name, v in values.items()]
    )


def pivot_sum(df: DataFrame, rows: Sequence[str], column: Column, labels: Sequence[str], value: str,
              fill: bool = True) -> DataFrame:
    """Cross-tab of sums. The column labels are given: no extra pass to find them."""
    wide = (
        require_keys(df, rows).withColumn("_label", column)
        .groupBy(*rows).pivot("_label", list(labels)).agg(F.sum(value).cast("double"))
    )
    return wide.fillna(0.0, list(labels)) if fill else wide


def pivot_mean(df: DataFrame, rows: Sequence[str], column: Column, labels: Sequence[str], value: str) -> DataFrame:
    wide = (
        require_keys(df, rows).withColumn("_label", column)
        .groupBy(*rows).pivot("_label", list(labels)).agg(numeric.ratio(F.sum(value), F.count(value)))
    )
    return wide.fillna(0.0, list(labels))


def pivot_first(df: DataFrame, rows: Sequence[str], column: str, labels: Sequence[str], value: str) -> DataFrame:
    """One cell per row and label; where there are several, the least, so the result is fixed."""
    return df.groupBy(*rows).pivot(column, list(labels)).agg(F.min(value))


def row_total(long: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return sum_by(long, keys, value, "grand_total")


def row_mean_nonzero(long: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean of the non-zero cells of each row of a cross-tab kept in long form."""
    cell = F.when(F.col(value) != 0, F.col(value))
    return long.groupBy(*keys).agg(numeric.ratio(F.sum(cell), F.count(cell)).alias("average"))


def column_total(long: DataFrame, period: Sequence[str], label: str, name: str, value: str) -> DataFrame:
    """The cells plus one more line per period holding their sum."""
    line = long.groupBy(*period).agg(F.sum(value).alias(value)).withColumn(label, F.lit(name))
    return long.unionByName(line.select(long.columns))
