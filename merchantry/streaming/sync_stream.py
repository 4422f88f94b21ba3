"""The synchronisation run as a stream over newly landed files.

The table is held as a base, one row per key and sorted by it, and the change folders written since. Once the changes exceed a
share of the base, a new base takes them in and the log publishes it together with an empty set of changes. So what is read
depends on the table and that share, never on how many changes have ever landed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from merchantry.operators.ordered import latest_per_key
from merchantry.session import cut_lineage
from merchantry.sources import commits

BATCH = "sync_batch"
AT = "sync_changed_at"
BASE = "base"
#: Changes, as a share of the base's rows, beyond which they are taken into a new base.
SHARE = 0.25


def landed(spark: SparkSession, path: str, schema) -> DataFrame:
    """New files below path as a stream, with the declared schema."""
    return spark.readStream.schema(schema).parquet(path)


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn(AT, F.greatest(F.col("itime"), F.col("utime")))


def _changes_folder(folder: str, base: int) -> str:
    """Changes since the base of that number."""
    return f"{folder}/changes/since={base}"


def _stored_schema(schema) -> StructType:
    return StructType([*schema.fields, StructField(AT, schema["itime"].dataType), StructField(BATCH, LongType())])


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each key the version changed last; of versions changed at one time the one that landed last."""
    return latest_per_key(rows, keys, [AT, BATCH, *[c for c in rows.columns if c not in (*keys, AT, BATCH)]])


def write_changes(stream: DataFrame, folder: str, keys: Sequence[str]):
    """Append each micro-batch's newest version per key, one folder per batch number.

    A replayed batch overwrites its own folder, so a restart after a lost executor or
    driver neither drops nor repeats a change. If a base was published in between, the replay is a change since that
    base: the same versions once more, which win or lose as before.
    """
    def write(batch: DataFrame, number: int) -> None:
        base = commits.last_commit(batch.sparkSession, folder).number
        order = [AT, *[c for c in batch.columns if c not in keys]]
        newest = latest_per_key(_timed(batch), keys, order)
        newest.write.mode("overwrite").parquet(f"{_changes_folder(folder, base)}/{BATCH}={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True).start()
    )


def held(spark: SparkSession, folder: str, schema) -> tuple[DataFrame, DataFrame]:
    """The base and the changes since, all that a run reads of what has landed before."""
    last = commits.last_commit(spark, folder)
    stored = _stored_schema(schema)
    changes = spark.read.schema(stored).parquet(_changes_folder(folder, last.number))
    base = commits.read_version(spark, folder, last.versions[BASE]) if last.versions else changes.limit(0)
    return base.select(stored.names), changes.select(stored.names)


def _merged(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base rows of untouched keys as they are; of a touched key the newest version, which may be the base's where a file
    landed late. The changes are stored first, so their size is known and a small set of them moves no base row."""
    newest = cut_lineage(_newest(changes, keys), "changes")
    touched = newest.select([F.col(k).alias(f"touched_{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"touched_{i}")) for i, k in enumerate(keys)])
    met = _newest(base.join(touched, same, "left_semi").unionByName(newest), keys)
    return base.join(touched, same, "left_anti").unionByName(met)


def compact(spark: SparkSession, folder: str, keys: Sequence[str], schema, share: float = SHARE) -> bool:
    """Take the changes into a new base if they exceed the share; says whether it did. A run that ends before the entry is
    published leaves base and changes as they were. Older bases and change folders are no longer read and may expire."""
    base, changes = held(spark, folder, schema)
    last = commits.last_commit(spark, folder)
    if changes.count() <= share * int(last.marks.get(BASE, {}).get("rows") or 0):
        return False
    layout = _merged(base, changes, keys).repartition(*keys).sortWithinPartitions(*keys)
    version = commits.write_version(layout, folder, BASE)
    rows = commits.read_version(spark, folder, version).count()
    _first_changes(spark, folder, last.number + 1, schema)
    commits.publish(spark, folder, commits.Commit(last.number + 1, {BASE: {"rows": str(rows)}}, {BASE: version}))
    return True


def _first_changes(spark: SparkSession, folder: str, base: int, schema) -> None:
    """An empty batch, so that changes can be read before any has come."""
    empty = _timed(spark.createDataFrame([], schema))
    empty.write.mode("ignore").parquet(f"{_changes_folder(folder, base)}/{BATCH}=-1")


def current_rows(spark: SparkSession, folder: str, keys: Sequence[str], schema) -> DataFrame:
    """The table as of now: for each key the version changed last; of versions changed at one time the one that
    landed last. A file that lands late does not bring an older version back."""
    return _merged(*held(spark, folder, schema), keys).select(schema.names)


def run_available(spark: SparkSession, path: str, schema, folder: str, keys: Sequence[str],
                  shape: Callable[[DataFrame], DataFrame], share: float = SHARE) -> DataFrame:
    """Take in everything that has landed and return the table. ``shape`` turns landed rows
    into rows of the table."""
    layout = shape(spark.createDataFrame([], schema)).schema
    _first_changes(spark, folder, commits.last_commit(spark, folder).number, layout)
    write_changes(shape(landed(spark, path, schema)), folder, keys).awaitTermination()
    compact(spark, folder, keys, layout, share)
    return current_rows(spark, folder, keys, layout)
