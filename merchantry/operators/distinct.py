"""Exact distinct counts that can be merged: a bitmap of dense ids per month, whose OR gives years and totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.operators.prep import require_keys
from merchantry.operators.sync import serial_key
from merchantry.session import cut_lineage

MONTH = ["zid", "year", "month"]


def month_bitmaps(df: DataFrame, figures: Mapping[str, str]) -> DataFrame:
    """Which values occur in which month: (zid, year, month, figure, bucket, bitmap). ``figures`` maps names to columns.

    The different values of a company and figure are numbered without gaps, so its bitmaps are dense: 4 KB for up to
    32,768 values. A fact leaves its task once per month and value. Nulls are no value; a month without any has no row.
    """
    facts = require_keys(df, MONTH)
    parts = [
        facts.select(*MONTH, F.lit(name).alias("figure"), F.col(column).cast("string").alias("value"))
        .filter(F.col("value").isNotNull()).distinct()
        for name, column in figures.items()
    ]
    values = cut_lineage(reduce(DataFrame.unionByName, parts), "values")
    # One numbering for all: the numbers of a figure and company follow one another.
    owner = ["figure", "zid", "value"]
    ids = serial_key(values.select(*owner).distinct(), owner, "id")
    return cut_lineage(
        values.join(ids, owner)
        .groupBy(*MONTH, "figure", F.bitmap_bucket_number("id").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bitmap")), "bitmaps")


def merged(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The bitmaps of a coarser view: ``keys`` and figure."""
    return bitmaps.groupBy(*keys, "figure", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def counted(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Different values per ``keys`` and figure, of bitmaps already merged to these keys."""
    return bitmaps.groupBy(*keys, "figure").agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def distinct_rollup(bitmaps: DataFrame) -> DataFrame:
    """Different values per month, year and company: (zid, year, month, figure, n), null where it is not split by that.

    Years come from the months' bitmaps and totals from those of the years; the facts are not read again.
    """
    years = cut_lineage(merged(bitmaps, ["zid", "year"]), "bitmaps")
    levels = [counted(bitmaps, MONTH), counted(years, ["zid", "year"]), counted(merged(years, ["zid"]), ["zid"])]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), levels)
