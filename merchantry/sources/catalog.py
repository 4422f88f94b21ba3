"""Named sources: tables by reader, extracts by name, and the configuration maps."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.sources import extracts
from merchantry.sources.schemas import TABLES, WITHOUT_CHANGE_TIMES, declared_schema, read_declared

EXTRACTS = ["sales", "return", "stock", "stock_value", "purchase", "collection", "payments"]


class Catalog:
    """Extracts by name over whatever reader supplies the tables."""

    def __init__(self, table: Callable[[str], DataFrame]):
        self.table = table

    def extract(self, name: str, zids: Sequence[int] | None = None,
                partners: Mapping[int, Sequence[int]] | None = None) -> DataFrame:
        t = self.table
        if name == "sales":
            return extracts.scan_sales(t("sales"), t("employee"), t("cacus"), t("caitem"), zids)
        if name == "return":
            return extracts.scan_returns(t("return"), t("employee"), t("cacus"), t("caitem"), zids)
        if name == "purchase":
            return extracts.scan_purchase(t("purchase"), t("caitem"), zids, partners)
        if name == "stock":
            return extracts.scan_stock(t("stock"), t("caitem"), zids, partners)
        if name == "stock_value":
            return extracts.scan_stock_value(t("stock_value"), zids)
        if name == "collection":
            return extracts.scan_collections(t("glmst"), t("gldetail"), t("glheader"), zids)
        if name == "payments":
            return extracts.scan_payments(t("glmst"), t("gldetail"), t("glheader"), zids)
        raise KeyError(f"no extract named {name!r}; there are {EXTRACTS}")


def file_tables(spark: SparkSession, root: str, fmt: str = "parquet") -> Callable[[str], DataFrame]:
    """Tables as files below root, one folder each, read with their declared schema."""
    def table(name: str) -> DataFrame:
        return read_declared(spark, f"{root}/{name}", declared_schema(name), fmt)
    return table


def jdbc_predicates(zids: Sequence[int], boundaries: Sequence[str] = (), timed: bool = True) -> list[str]:
    """One WHERE clause per read task: company x span of insert time, nothing twice or left out.

    Time spans split a company that holds a large share of all rows.
    """
    spans = ["1 = 1"]
    if timed and boundaries:
        edges = sorted(boundaries)
        spans = [f"itime < '{edges[0]}' OR itime IS NULL"]
        spans += [f"itime >= '{a}' AND itime < '{b}'" for a, b in zip(edges, edges[1:])]
        spans.append(f"itime >= '{edges[-1]}'")
    return [f"zid = {int(z)} AND ({span})" for z in zids for span in spans]


def jdbc_tables(spark: SparkSession, url: str, properties: Mapping[str, str], zids: Sequence[int],
                boundaries: Sequence[str] = (), fetch_rows: int = 10_000) -> Callable[[str], DataFrame]:
    """Tables in a database, read in parallel."""
    def table(name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        return spark.read.jdbc(
            url, name, predicates=jdbc_predicates(zids, boundaries, name not in WITHOUT_CHANGE_TIMES),
            properties={"fetchsize": str(fetch_rows), **properties},
        )
    return table


def label_dimension(spark: SparkSession, labels: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """{statement: {ac_lv4: line}} as rows. A configuration map, so its size is fixed."""
    rows = [(lv4, statement, line) for statement, m in labels.items() for lv4, line in m.items()]
    return spark.createDataFrame(rows, "ac_lv4 string, statement string, line string")


def labels_from_json(text: str) -> dict[str, dict[str, str]]:
    """The label maps of a JSON configuration with one map per statement."""
    config = json.loads(text)
    return {
        "income": config["income_statement_label"],
        "balance": config["balance_sheet_label"],
    }


def business_projects(config: DataFrame, column: str = "config") -> DataFrame:
    """JSON texts {"businesses": {zid: {"projects": [...]}}} to one row per company and project."""
    parsed = F.from_json(F.col(column), "businesses map<string, struct<zorg string, projects array<string>>>")
    return (
        config.select(F.explode(parsed["businesses"]).alias("zid", "business"))
        .select(F.col("zid").cast("int").alias("zid"), F.explode("business.projects").alias("project"))
    )


def supplier_lists(config: DataFrame, column: str = "config") -> DataFrame:
    """JSON texts {zid: {ac_code: supplier or [suppliers]}} to (zid, ac_code, supplier) rows."""
    entries = F.from_json(F.col(column), "map<string, map<string, string>>")
    flat = config.select(F.explode(entries).alias("zid", "accounts")) \
        .select("zid", F.explode("accounts").alias("ac_code", "suppliers"))
    listed = F.from_json(F.col("suppliers"), "array<string>")
    many = F.when(F.col("suppliers").startswith("["), listed).otherwise(F.array("suppliers"))
    return flat.select(F.col("zid").cast("int").alias("zid"), "ac_code", F.explode(many).alias("supplier"))
