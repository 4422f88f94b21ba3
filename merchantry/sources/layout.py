"""Facts in folders by company and year: a report reads the folders it asks for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PARTS = ["zid", "year"]


def write_facts(facts: DataFrame, path: str, spread: Sequence[str], files: int = 16) -> None:
    """Write ``facts`` below ``path`` by zid and year, replacing what is there.

    The rows of a company and year go to ``files`` tasks at most, by a hash of the ``spread`` columns: a company with a
    third of all rows is written by several tasks, and a folder holds no more than ``files`` files.
    """
    place = F.pmod(F.xxhash64(*spread), F.lit(files))
    facts.repartition(*PARTS, place).write.mode("overwrite").partitionBy(*PARTS).parquet(path)


def read_facts(spark: SparkSession, path: str, schema: StructType, companies: DataFrame | Sequence[int] | None = None,
               years: Sequence[int] | None = None) -> DataFrame:
    """The facts of some companies and years; None means all, an empty list none.

    Lists become filters on folder names when the query is planned. ``companies`` may also be a filtered dimension with
    zid: the folders it leaves over are then found at run time, before the facts are opened.
    """
    facts = spark.read.schema(schema).parquet(path)
    if years is not None:
        facts = facts.filter(F.col("year").isin(list(years)))
    if isinstance(companies, DataFrame):
        facts = facts.join(companies.select("zid"), "zid", "left_semi")
    elif companies is not None:
        facts = facts.filter(F.col("zid").isin(list(companies)))
    return facts.select(schema.fieldNames())
