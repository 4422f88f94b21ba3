"""Declared table layouts and their Spark schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The eleven tables, their columns and SQL types.
# Every table starts with uuid and has zid; all but the two stock tables have itime and utime.
TABLES = {
    "glmst": "ac_code VARCHAR, ac_name VARCHAR, ac_type VARCHAR, ac_lv1 VARCHAR, ac_lv2 VARCHAR, "
             "ac_lv3 VARCHAR, ac_lv4 VARCHAR, usage VARCHAR",
    "gldetail": "ac_code VARCHAR, ac_sub VARCHAR, project VARCHAR, voucher VARCHAR, value NUMERIC",
    "glheader": "voucher VARCHAR, date DATE, year INT, month INT",
    "purchase": "combinedate DATE, povoucher VARCHAR, grnvoucher VARCHAR, itemcode VARCHAR, "
                "shipmentname VARCHAR, quantity NUMERIC, cost NUMERIC, status VARCHAR",
    "sales": "ordernumber VARCHAR, date DATE, sp_id VARCHAR, cusid VARCHAR, itemcode VARCHAR, "
             "quantity NUMERIC, totalsales NUMERIC, cost NUMERIC",
    "return": "revoucher VARCHAR, date DATE, cusid VARCHAR, sp_id VARCHAR, itemcode VARCHAR, "
              "returnqty NUMERIC, treturnamt NUMERIC, returncost NUMERIC",
    "stock": "itemcode VARCHAR, stockqty NUMERIC, stockvalue NUMERIC",
    "stock_value": "year INT, month INT, warehouse VARCHAR, stockvalue NUMERIC",
    "cacus": "cusid VARCHAR, cusname VARCHAR, cusadd VARCHAR, cuscity VARCHAR, cusstate VARCHAR, "
             "cusmobile VARCHAR, cusmobile2 VARCHAR",
    "caitem": "itemcode VARCHAR, itemname VARCHAR, itemgroup VARCHAR, itemgroup2 VARCHAR, packcode VARCHAR",
    "employee": "spid VARCHAR, spname VARCHAR, department VARCHAR, designation VARCHAR",
}
WITHOUT_CHANGE_TIMES = ["stock", "stock_value"]

SQL_TYPES = {
    "VARCHAR": T.StringType(),
    "INT": T.IntegerType(),
    "NUMERIC": T.DecimalType(18, 4),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampNTZType(),
}


def declared_schema(table: str) -> T.StructType:
    """Spark schema of one of the built-in tables."""
    head = [("uuid", "VARCHAR")]
    if table not in WITHOUT_CHANGE_TIMES:
        head += [("itime", "TIMESTAMP"), ("utime", "TIMESTAMP")]
    head.append(("zid", "INT"))
    own = [tuple(column.split()) for column in TABLES[table].split(", ")]
    return T.StructType(
        [T.StructField(name, SQL_TYPES[kind], name != "uuid") for name, kind in head + own]
    )


def schemas_from_spec(text: str) -> dict[str, T.StructType]:
    """Schemas from a JSON spec ``{"database": {"tables": [{"name", "columns": [...]}]}}``."""
    tables = json.loads(text)["database"]["tables"]
    return {
        table["name"]: T.StructType([
            T.StructField(
                column["name"],
                SQL_TYPES[column["type"].upper()],
                "PRIMARY KEY" not in column.get("constraints", []),
            )
            for column in table["columns"]
        ])
        for table in tables
    }


def read_declared(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                  **options: str) -> DataFrame:
    """Read with the declared schema applied: no inference, unknown columns never read."""
    return spark.read.format(fmt).options(**options).schema(schema).load(path)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast and order the columns of df as declared; a missing column becomes null."""
    have = set(df.columns)
    return df.select([
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in declared_schema(table).fields
    ])
