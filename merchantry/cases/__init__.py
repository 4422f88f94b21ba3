"""Registered queries, each with the SQL that must give the same rows.

A case is a function of DriverTables; its SQL refers to the views of ``views.VIEWS``.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from merchantry.cases.views import with_views
from merchantry.session import configure, sized_for
from merchantry.sources.driver_tables import SCHEMAS, DriverTables

MODULES = [
    "extract_cases", "ledger_cases", "prep_cases", "aggregate_cases", "netting_cases", "sales_cases",
    "purchase_cases", "collection_cases", "basket_cases", "statement_cases", "sync_cases",
]


@dataclass
class Case:
    key: str
    build: Callable[[DriverTables], DataFrame]
    sql: str | None


CASES: dict[str, Case] = {}


def case(key: str, sql: str | None = None):
    def register(build: Callable[[DriverTables], DataFrame]):
        if key in CASES:
            raise ValueError(f"{key} is registered twice")
        CASES[key] = Case(key, build, sql)
        return build
    return register


def load() -> dict[str, Case]:
    for module in MODULES:
        importlib.import_module(f"merchantry.cases.{module}")
    return CASES


def runner(one: Case) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, root: str) -> DataFrame:
        sized_for(configure(spark), [f"{root}/{name}.parquet" for name in SCHEMAS])
        return one.build(DriverTables(spark, root))
    return run


def sql_text(one: Case) -> str | None:
    return with_views(one.sql) if one.sql else None
