"""Documents that are joined from several landing streams: header, lines and movements, in whatever order they come.

A landed file brings whole documents: all rows that one ERP table holds of each document in it. Of a document's states
in one table the one changed last counts, of states changed at one time the one landed last. What arrives names the touched documents, and
only these are made anew, from the rows of all tables.

The rows taken in and the analytical table are held in buckets of documents. A run rewrites the buckets it touches
and publishes them, of all tables together, with one log entry; how much has landed before does not matter to it. What waited for
the entry is removed after it, as the buckets hold it then.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from merchantry.plans.sync_run import ERP_TIMES, FOLLOWED, stored_documents
from merchantry.session import RELEASED, STORED, cut_lineage, forget, settings
from merchantry.sources import commits

BATCH, AT, FILE, BUCKET = "sync_batch", "sync_changed_at", "sync_file", "sync_bucket"
DOCUMENT = ["sync_zid", "sync_number"]
#: Buckets of a table. More of them make a small run cheaper and a large one write more files.
BUCKETS = 64


def _of(zid: Column, number: Column) -> list[Column]:
    return [zid.alias(DOCUMENT[0]), number.alias(DOCUMENT[1])]


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*DOCUMENT), F.lit(buckets)).cast("int"))


def _take_in(spark: SparkSession, path: str, schema: StructType, number: str, folder: str, table: str, since: int) -> None:
    """Everything new below path, each row with its document and the time its state of the document was last changed. A
    batch that is replayed overwrites its own folder. Rows without company or number belong to no document."""
    times = [F.col(c) for c in ERP_TIMES if c in schema.names]
    changed = F.greatest(*times) if len(times) > 1 else times[0]

    def write(batch: DataFrame, numbered: int) -> None:
        rows = batch.withColumns(dict(zip(DOCUMENT, [F.col("zid"), F.col(number)]))).dropna(subset=DOCUMENT)
        state = [*DOCUMENT, FILE]
        changed_at = rows.groupBy(*state).agg(F.max(changed).alias(AT))
        with settings(batch.sparkSession, RELEASED):
            rows.join(changed_at, state).write.mode("overwrite").options(**STORED).parquet(
                f"{folder}/landed/since={since}/{table}/{BATCH}={numbered}")

    stream = spark.readStream.schema(schema).parquet(path).select("*", F.col("_metadata.file_path").alias(FILE))
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress/{table}").trigger(
        availableNow=True).start().awaitTermination()


def _held_schema(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(DOCUMENT[0], schema["zid"].dataType), StructField(DOCUMENT[1], StringType()),
                       StructField(FILE, StringType()), StructField(AT, schema["ztime"].dataType), StructField(BATCH, LongType())])


def _read(spark: SparkSession, folder: str, versions: Mapping[str, tuple[str, str]], name: str, schema: StructType,
          only: set[int] | None = None) -> DataFrame:
    """Buckets of a table as the log names them: all, or those wanted."""
    places = [f"{folder}/{place}" for key, (place, _) in sorted(versions.items())
              if key.startswith(f"{name}/") and (only is None or int(key.split("/")[1]) in only)]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def _replace(spark: SparkSession, folder: str, versions: Mapping[str, tuple[str, str]], name: str, rows: DataFrame,
             touched: set[int], buckets: int) -> dict[str, tuple[str, str]]:
    """Versions with the touched buckets of a table written anew."""
    others = {key: version for key, version in versions.items()
              if not key.startswith(f"{name}/") or int(key.split("/")[1]) not in touched}
    version = commits.write_version(_bucketed(rows, buckets), folder, name, [BUCKET])
    filled = commits.read_version(spark, folder, version).select(BUCKET).distinct().collect()
    return others | {f"{name}/{r[BUCKET]}": (f"{version[0]}/{BUCKET}={r[BUCKET]}", version[1]) for r in filled}


def run_documents(spark: SparkSession, name: str, landings: Mapping[str, str], schemas: Mapping[str, StructType], folder: str,
                  buckets: int = BUCKETS) -> DataFrame:
    """Take in what has landed and return the analytical table ``name``.

    ``landings`` and ``schemas`` give, for each ERP table that the extract reads, where its files land and their columns. A run that
    ends early is repeated: what had been taken in waits until an entry counts it. ``buckets`` must stay the same for a folder.
    """
    followed = FOLLOWED[name]
    schemas = {table: StructType([c for c in schemas[table] if c.name in followed.columns.get(table, schemas[table].names)])
               for table in followed.reads}
    last = commits.last_commit(spark, folder)
    layouts = {table: _held_schema(schemas[table]) for table in followed.reads}
    arrived = {}
    for table, number in followed.reads.items():
        waiting = f"{folder}/landed/since={last.number}/{table}"
        spark.createDataFrame([], StructType(layouts[table].fields[:-1])).write.mode("ignore").parquet(f"{waiting}/{BATCH}=-1")
        _take_in(spark, landings[table], schemas[table], number, folder, table, last.number)
        arrived[table] = spark.read.schema(layouts[table]).parquet(waiting)
    result = followed.extract(*[spark.createDataFrame([], schemas[table]) for table in followed.reads]).schema
    kept_as = StructType([*result.fields, StructField(DOCUMENT[0], result["zid"].dataType), StructField(DOCUMENT[1], StringType())])

    touched = cut_lineage(_bucketed(reduce(
        lambda a, b: a.unionByName(b), [rows.select(*DOCUMENT) for rows in arrived.values()]).distinct(), buckets), "touched")
    places = {r[BUCKET] for r in touched.select(BUCKET).distinct().collect()}
    documents = touched.drop(BUCKET)
    asked = documents.withColumnRenamed(DOCUMENT[0], "zid")
    if not places:
        return _read(spark, folder, last.versions, name, kept_as).select(result.names)
    versions, parts = dict(last.versions), []
    for table, number in followed.reads.items():
        held = _read(spark, folder, versions, f"rows-{table}", layouts[table], places)
        states = held.unionByName(arrived[table])
        newest = states.groupBy(*DOCUMENT).agg(F.max(F.struct(AT, BATCH, FILE)).alias("newest")).select(*DOCUMENT, "newest.*")
        # A state without any time is older than all others; comparing null-safe keeps it where it is the only one.
        same = reduce(lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}")) for c in (AT, BATCH, FILE)])
        match = reduce(lambda a, b: a & b, [F.col(f"s.{c}") == F.col(f"n.{c}") for c in DOCUMENT])
        rows = states.alias("s").join(newest.alias("n"), match & same, "left_semi").select(layouts[table].names)
        versions = _replace(spark, folder, versions, f"rows-{table}", rows, places, buckets)
        present = _read(spark, folder, versions, f"rows-{table}", layouts[table], places)
        parts.append(present.select(schemas[table].names).join(
            asked.withColumnRenamed(DOCUMENT[1], number), ["zid", number], "left_semi"))
    fresh = stored_documents(followed.extract(*parts)).select("*", *_of(F.col("zid"), F.col(followed.number)))
    kept = _read(spark, folder, versions, name, kept_as, places).join(documents, DOCUMENT, "left_anti")
    versions = _replace(spark, folder, versions, name, kept.select(kept_as.names).unionByName(fresh.select(kept_as.names)), places, buckets)
    commits.publish(spark, folder, commits.Commit(last.number + 1, {}, versions))
    forget(spark, f"{folder}/landed/since={last.number}")
    return _read(spark, folder, versions, name, kept_as).select(result.names)
