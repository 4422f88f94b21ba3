"""A log of runs. One entry says which table versions count and how far the run had read.

Entries are numbered folders below ``<folder>/log``. An entry is written beside them under a name nobody reads, then renamed
to its number: that one step publishes all tables of the run at once. A run that ends before it leaves files that no entry
names, and the next run starts from the last entry. The rename must be atomic and refuse an existing name, as it does
on HDFS; an object store without that needs a committer in front of it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from merchantry.session import RELEASED, STORED, settings


@dataclass(frozen=True)
class Commit:
    """``marks``: source table -> its latest times read, as text in UTC. ``versions``: table -> folder and column layout."""
    number: int = 0
    marks: Mapping[str, Mapping[str, str | None]] = field(default_factory=dict)
    versions: Mapping[str, tuple[str, str]] = field(default_factory=dict)


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    entries = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/log/run=*")
    found = entries.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(entries) or []
    return sorted(int(one.getPath().getName().partition("=")[2]) for one in found)


def last_commit(spark: SparkSession, folder: str) -> Commit:
    """The newest entry; run 0, which knows nothing, before the first."""
    numbers = _numbers(spark, folder)
    if not numbers:
        return Commit()
    entry = json.loads(spark.read.text(f"{folder}/log/run={numbers[-1]}", wholetext=True).first()["value"])
    return Commit(numbers[-1], entry["marks"], {name: tuple(version) for name, version in entry["versions"].items()})


def publish(spark: SparkSession, folder: str, commit: Commit) -> None:
    """Make the entry the newest one. Of two runs that started from the same entry, the second one fails here."""
    draft = f"{folder}/drafts/{os.urandom(8).hex()}"
    text = json.dumps({"marks": commit.marks, "versions": commit.versions}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(draft)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    config = spark.sparkContext._jsc.hadoopConfiguration()
    log, source = hadoop.fs.Path(f"{folder}/log"), hadoop.fs.Path(draft)
    source.getFileSystem(config).mkdirs(log)
    keep_existing = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 0)
    qualified = source.getFileSystem(config).makeQualified(source)
    hadoop.fs.FileContext.getFileContext(qualified.toUri(), config).rename(
        source, hadoop.fs.Path(f"{folder}/log/run={commit.number}"), keep_existing)


def write_version(df: DataFrame, folder: str, name: str, by: Sequence[str] = ()) -> tuple[str, str]:
    """The table in a folder of its own, for an entry to name; with ``by``, one folder in it for each of these columns' values.
    Every task writes what it has of each folder: rows are not exchanged for it, and no task holds a folder's rows alone."""
    place = f"tables/{name}/{os.urandom(8).hex()}"
    with settings(df.sparkSession, RELEASED):
        (df.write.partitionBy(*by) if by else df.write).options(**STORED).parquet(f"{folder}/{place}")
    return place, df.schema.json()


def read_version(spark: SparkSession, folder: str, version: tuple[str, str]) -> DataFrame:
    place, layout = version
    return spark.read.schema(StructType.fromJson(json.loads(layout))).parquet(f"{folder}/{place}")
