"""Report files and table refreshes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def flatten_name(parts: Sequence) -> str:
    """Two-level column names become a_b; an empty second level disappears."""
    return "_".join(str(p).strip() for p in parts if p not in (None, ""))


def write_report(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> str:
    """Export a report with its header, written by all tasks in parallel."""
    writer = df.write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
    return path


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions below path whose writing has ended, in order; the marker file is written last."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(done) or []
    return sorted(int(one.getPath().getParent().getName().partition("=")[2]) for one in found)


def current_version(spark: SparkSession, path: str, schema) -> DataFrame:
    """A refreshed table as of its last complete version."""
    return spark.read.schema(schema).parquet(f"{path}/version={_versions(spark, path)[-1]}")


def full_refresh(df: DataFrame, path: str) -> DataFrame:
    """Replace a table's whole content. The new version is written beside the old one and counts once it is complete:
    a job that fails leaves the old one in place, and readers of the old one are not disturbed."""
    spark = df.sparkSession
    number = max(_versions(spark, path), default=0) + 1
    df.write.mode("overwrite").parquet(f"{path}/version={number}")
    return current_version(spark, path, df.schema)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str], mode: str = "append",
               batch_rows: int = 10_000) -> None:
    """Insert into a database table in batches."""
    df.write.jdbc(url, table, mode, {"batchsize": str(batch_rows), **properties})


def read_report(spark: SparkSession, path: str, schema, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema).format(fmt)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)
