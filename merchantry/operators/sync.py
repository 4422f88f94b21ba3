"""Incremental table synchronisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.operators.figures import stored_figure
from merchantry.operators.ordered import latest_per_key
from merchantry.session import cut_lineage


def watermarks(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: the latest insert and update time. Tables without them are left out."""
    parts = [
        df.agg(F.max("itime").alias("itime"), F.max("utime").alias("utime"))
        .select(F.lit(name).alias("table_name"), "itime", "utime")
        for name, df in tables.items() if "itime" in df.columns and "utime" in df.columns
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def changed_since(df: DataFrame, itime: datetime | str | None, utime: datetime | str | None, inclusive: bool = False) -> DataFrame:
    """Rows inserted or updated after the watermark, or at it if inclusive; no watermark means a first sync of all rows."""
    marks = {name: at for name, at in (("itime", itime), ("utime", utime)) if at is not None}
    if not marks:
        return df
    ends = {n: F.lit(str(at)).cast(df.schema[n].dataType) for n, at in marks.items()}
    later = [F.col(n) >= end if inclusive else F.col(n) > end for n, end in ends.items()]
    return df.filter(reduce(lambda a, b: a | b, later))


def incremental_extract(source: DataFrame, target: DataFrame, inclusive: bool = False) -> DataFrame:
    """Source rows past the target's watermark. The watermark is one row, read first, so the
    comparison reaches the source scan as a plain pushed-down predicate."""
    mark = target.agg(F.max("itime").alias("itime"), F.max("utime").alias("utime")).first()
    return changed_since(source, mark["itime"], mark["utime"], inclusive)


def missing_rows(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full source rows whose key pair is not in the target yet."""
    return source.join(target.select(*keys).distinct(), list(keys), "left_anti")


def _bucket(keys: Sequence[str], size: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(size))


def _in_buckets(df: DataFrame, keys: Sequence[str], buckets: DataFrame | None, size: int) -> DataFrame:
    if buckets is None:
        return df
    return df.withColumn("_bucket", _bucket(keys, size)).join(
        buckets.withColumnRenamed("bucket", "_bucket"), "_bucket", "left_semi").drop("_bucket")


def unequal_buckets(source: DataFrame, target: DataFrame, keys: Sequence[str], sizes: Sequence[int]) -> tuple[DataFrame, int]:
    """Buckets of the keys in which the source holds others than the target, and the finest number of buckets.

    Per bucket both sides give the number of keys and the exact sums of two hashes over them, combined on the map side: no
    key is exchanged. Only buckets that differ are looked at again, with the next, finer number; each of ``sizes`` is a
    multiple of the one before, so a finer bucket lies in one coarser.
    """
    found, size = None, sizes[0]
    for finer in sizes:
        def digest(df: DataFrame, name: str) -> DataFrame:
            sums = [F.sum(F.xxhash64(*seed, *keys).cast("decimal(20,0)")) for seed in ([], [F.lit(1)])]
            inside = _in_buckets(df.select(*keys).dropna(), keys, found, size)
            return inside.groupBy(_bucket(keys, finer).alias("bucket")).agg(F.struct(F.count("*"), *sums).alias(name))
        both = digest(source, "here").join(digest(target, "there"), "bucket", "left")
        found = stored_figure(both.filter(~F.col("here").eqNullSafe(F.col("there"))).select("bucket"))
        size = finer
    return found, size


def reconciled_missing(source: DataFrame, target: DataFrame, keys: Sequence[str],
                       sizes: Sequence[int] = (1 << 12, 1 << 20)) -> DataFrame:
    """The rows of ``missing_rows`` by set reconciliation: only keys of buckets that differ are compared.

    For two large tables that hold nearly the same keys. Keys should be unique on both sides: repeated ones make buckets
    unequal, which costs time and not rows. As in a join, a key with a null is never found in the target.
    """
    buckets, size = unequal_buckets(source, target, keys, sizes)
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    compared = _in_buckets(source.filter(complete), keys, buckets, size).join(
        _in_buckets(target.select(*keys).dropna(), keys, buckets, size), list(keys), "left_anti")
    return compared.unionByName(source.filter(~complete))


def serial_key(df: DataFrame, order: Sequence[str], name: str = "serial", after: int = 0) -> DataFrame:
    """Serial numbers without gaps, after + 1 and on, in the order of ``order``, which should be unique.

    Rows are sorted by ranges and written once; a number is the place in its range plus the rows of the ranges before.
    The driver only sees one count per range.
    """
    spark = df.sparkSession
    placed = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "serials")
    in_range = F.shiftright("_at", 33).alias("_range")
    sizes = sorted(tuple(r) for r in placed.groupBy(in_range).agg(F.count("*")).collect())
    starts, start = [], after
    for which, rows in sizes:
        starts.append((which, start))
        start += rows
    first = stored_figure(spark.createDataFrame(starts, "_range long, _start long").coalesce(1))
    place = F.col("_at") - F.shiftleft("_range", 33) + 1
    return placed.withColumn("_range", in_range).join(first, "_range").withColumn(
        name, F.col("_start") + place).drop("_at", "_range", "_start")


def with_continued_serials(source: DataFrame, target: DataFrame, keys: Sequence[str], name: str = "serial") -> DataFrame:
    """The target and the source rows it lacks, numbered on from the target's greatest serial."""
    last = target.agg(F.max(name)).first()[0] or 0
    new = serial_key(missing_rows(source, target, keys), keys, name, last)
    return target.unionByName(new.select(target.columns))


def surrogate_key(df: DataFrame, business_key: Sequence[str], name: str = "uuid") -> DataFrame:
    """A key computed from the business key: the same row gets the same key in every run."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in business_key]
    return df.withColumn(name, F.sha2(F.concat_ws("\u001f", *parts), 256))


def merge_latest(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target with changed keys replaced by their newest version. Only the changes are
    de-duplicated; untouched target rows pass an anti-join. Merging twice changes nothing."""
    newest = latest_per_key(
        changes.withColumn("_at", F.greatest(F.col("itime"), F.col("utime"))),
        keys, ["_at", *[c for c in changes.columns if c not in keys]],
    ).drop("_at")
    kept = target.join(newest.select(*keys), list(keys), "left_anti")
    return kept.select(target.columns).unionByName(newest.select(target.columns))


def append(target: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes added as further rows; an updated row then exists in both versions."""
    return target.unionByName(changes.select(target.columns))


def synchronise(source: DataFrame, target: DataFrame, keys: Sequence[str], mode: str = "merge") -> DataFrame:
    """One sync run: rows past the watermark, plus rows whose key never arrived.

    Keys past the watermark and keys that are missing overlap; each row is taken once. Merging
    also takes rows at the watermark itself, as another change may have come at that very time.
    """
    fresh = incremental_extract(source, target, mode == "merge")
    late = missing_rows(missing_rows(source, target, keys), fresh, keys)
    changes = fresh.unionByName(late)
    return merge_latest(target, changes, keys) if mode == "merge" else append(target, changes)
