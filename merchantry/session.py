"""Session settings the library relies on."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings, safe to change on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is split at run time, also where that costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
#: Bytes of the input for which an exchange has one partition before coalescing, and bytes that partitions are coalesced to.
#: A task sorts and groups about 20 times what it reads of an exchange.
PARTITION_INPUT, PARTITION = 4 << 20, "16m"
#: What is written below the shared folder is read a few times and takes disk until it expires.
STORED = {"compression": "zstd"}
#: A job that ends with a written table leaves no shuffle files behind: nobody reads its frame again.
RELEASED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Rows dealt by some of the columns that they are joined by stay where they are. Only for columns of many values.
TOGETHER = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def sized_for(spark: SparkSession, paths: Iterable[str]) -> SparkSession:
    """Exchanges of as many partitions as the files below ``paths`` ask for, so that what one task holds does not grow with
    the input. Coalescing puts small ones together again."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    config, size = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for one in map(path, paths):
        files = one.getFileSystem(config)
        size += files.getContentSummary(one).getLength() if files.exists(one) else 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PARTITION_INPUT)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(partitions))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", PARTITION)
    return spark


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Settings for the jobs that are planned inside."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def local_session(cores: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """Single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("merchantry")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.autoBroadcastJoinThreshold", "32m")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediates: the one the cluster names, a local one only in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="merchantry-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/merchantry/{label}-{os.urandom(8).hex()}"


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Compute once into a table in the shared folder. Several consumers then read only the
    columns they need, its size is known to the planner, and a lost executor never replays
    what came before. Its shuffle files go as soon as it is written."""
    path = new_folder(df.sparkSession, label)
    with settings(df.sparkSession, RELEASED):
        df.write.options(**STORED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Remove a folder that nobody reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stored_instead(df: DataFrame, stored: DataFrame, label: str = "step") -> DataFrame:
    """``cut_lineage`` of a frame made from ``stored``, whose files are removed then: only for a result of ``cut_lineage`` that
    nobody else holds."""
    spark, folders = df.sparkSession, {file.rpartition("/")[0] for file in stored.inputFiles()}
    result = cut_lineage(df, label)
    for folder in folders:
        forget(spark, folder)
    return result
