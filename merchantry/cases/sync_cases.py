"""Table synchronisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.cases import CASES, case
from merchantry.operators import prep, sync
from merchantry.plans import sync_run
from merchantry.session import RELEASED, STORED, cut_lineage, new_folder, settings
from merchantry.sources import commits, sinks
from merchantry.sources.driver_tables import SCHEMAS, DriverTables
from merchantry.streaming import document_stream, sync_stream

KEYS = ["o_orderkey", "o_custkey"]

_FRESH = """
    SELECT s.* FROM f_source s, (SELECT max(itime) AS i, max(utime) AS u FROM f_target) m
    WHERE s.itime > m.i OR s.utime > m.u"""
_MISSING = "SELECT * FROM f_source WHERE (o_orderkey, o_custkey) NOT IN (SELECT (o_orderkey, o_custkey) FROM f_target)"


@case("sync_watermarks", """
    SELECT 'source' AS table_name, max(itime) AS itime, max(utime) AS utime FROM f_source
    UNION ALL SELECT 'target', max(itime), max(utime) FROM f_target""")
def sync_watermarks(t: DriverTables) -> DataFrame:
    return sync.watermarks({"source": t.sync_source(), "target": t.sync_target(), "stock": t.raw("region")})


@case("incremental_extract", _FRESH)
def incremental_extract(t: DriverTables) -> DataFrame:
    return sync.incremental_extract(t.sync_source(), t.sync_target())


@case("missing_rows", _MISSING)
def missing_rows(t: DriverTables) -> DataFrame:
    return sync.missing_rows(t.sync_source(), t.sync_target(), KEYS)


@case("missing_rows_reconciled", _MISSING)
def missing_rows_reconciled(t: DriverTables) -> DataFrame:
    return sync.reconciled_missing(t.sync_source(), t.sync_target(), KEYS)


@case("serial_key", """
    SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey, o_custkey) AS serial FROM orders""")
def serial_key(t: DriverTables) -> DataFrame:
    return sync.serial_key(t.raw("orders").select(*KEYS), KEYS)


# What the target holds keeps its numbers; rows that come later are numbered on from there.
@case("serial_key_continued", f"""
    SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey, o_custkey) AS serial FROM f_target
    UNION ALL
    SELECT o_orderkey, o_custkey,
           (SELECT count(*) FROM f_target) + row_number() OVER (ORDER BY o_orderkey, o_custkey) FROM ({_MISSING})""")
def serial_key_continued(t: DriverTables) -> DataFrame:
    target = sync.serial_key(t.sync_target().select(*KEYS), KEYS)
    return sync.with_continued_serials(t.sync_source().select(*KEYS), target, KEYS)


@case("sync_append", f"""
    SELECT * FROM f_target UNION ALL
    (SELECT * FROM ({_FRESH}) UNION SELECT * FROM ({_MISSING}))""")
def sync_append(t: DriverTables) -> DataFrame:
    return sync.synchronise(t.sync_source(), t.sync_target(), KEYS, "append")


@case("sync_merge", "SELECT * FROM f_source")
def sync_merge(t: DriverTables) -> DataFrame:
    """All outdated versions are replaced and all missing rows arrive, so merging ends at the source itself."""
    return sync.synchronise(t.sync_source(), t.sync_target(), KEYS, "merge")


@case("sync_merge_twice", "SELECT * FROM f_source")
def sync_merge_twice(t: DriverTables) -> DataFrame:
    source = t.sync_source()
    once = sync.synchronise(source, t.sync_target(), KEYS)
    return sync.synchronise(source, once, KEYS)


@case("surrogate_key", """
    SELECT o_orderkey, o_custkey, sha256(concat_ws(chr(31), CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR))) AS uuid
    FROM orders""")
def surrogate_key(t: DriverTables) -> DataFrame:
    return sync.surrogate_key(t.raw("orders").select(*KEYS), KEYS)


@case("full_refresh", """
    SELECT zid, itemcode, CAST(stockqty AS DOUBLE) AS stockqty, CAST(stockvalue AS DOUBLE) AS stockvalue FROM f_stock""")
def full_refresh(t: DriverTables) -> DataFrame:
    path = new_folder(t.spark, "stock")
    # The first content is replaced as a whole by the second.
    sinks.full_refresh(t.stock_table().withColumn("stockqty", F.lit(0).cast("decimal(38,4)")), path)
    return prep.decimal_to_double(sinks.full_refresh(t.stock_table(), path))


def _whole_run(name: str):
    def run(t: DriverTables) -> DataFrame:
        """The table after a run that found it outdated; totals have no older version that matters."""
        if name in sync_run.REFRESHED:
            return prep.decimal_to_double(sync_run.sync_table(name, t.erp_tables(), t.table(name)))
        tables = t.erp_stored(*sync_run.FOLLOWED[name].reads)
        return prep.decimal_to_double(sync_run.sync_table(name, tables, cut_lineage(t.outdated(name, tables), "target")))
    return run


# Whatever the target held before, a run over all tables ends at what the ERP's tables say now.
for _table, _extract in {
    "glmst": "etl_glmst", "gldetail": "etl_gldetail", "glheader": "etl_glheader", "cacus": "etl_customer",
    "caitem": "etl_item", "employee": "etl_employee", "purchase": "etl_purchase", "stock": "etl_stock",
    "stock_value": "etl_stock_value",
}.items():
    case(f"sync_all_{_table}", CASES[_extract].sql)(_whole_run(_table))
for _table, _extract in {"sales": "etl_sales", "return": "etl_return"}.items():
    case(f"sync_all_{_table}", f"SELECT * FROM ({CASES[_extract].sql}) WHERE zid IS NOT NULL")(_whole_run(_table))


@case("source_marks", """
    SELECT 'opdor' AS table_name, max(ztime) AS itime, max(zutime) AS utime FROM f_opdor
    UNION ALL SELECT 'opddt', max(ztime), max(zutime) FROM f_opddt
    UNION ALL SELECT 'imtrn', max(ztime), max(zutime) FROM f_movement""")
def source_marks(t: DriverTables) -> DataFrame:
    """What the log says after a run: the marks of the ERP tables it read."""
    folder = new_folder(t.spark, "synchronised")
    sync_run.run_logged(t.erp_tables(), folder, ["sales"])
    marks = commits.last_commit(t.spark, folder).marks
    rows = [(table, at["itime"], at["utime"]) for table, at in marks.items()]
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("itime", "utime")]
    return t.spark.createDataFrame(rows, "table_name string, itime string, utime string").select("table_name", *times)


def _second_run(name: str):
    def run(t: DriverTables) -> DataFrame:
        """The table after two logged runs. Between them headers were changed before the newest line known to the first."""
        folder, tables = new_folder(t.spark, "synchronised"), t.erp_stored(*sync_run.FOLLOWED[name].reads)
        sync_run.run_logged(t.erp_tables_on("2000-01-01", "2000-06-01", tables), folder, [name])
        return prep.decimal_to_double(sync_run.run_logged(tables, folder, [name])[name])
    return run


for _table in ("sales", "return", "purchase"):
    case(f"sync_logged_{_table}", CASES[f"sync_all_{_table}"].sql)(_second_run(_table))


@case("sync_stream", "SELECT * FROM f_source")
def streamed(t: DriverTables) -> DataFrame:
    # The pattern matches the one table, be it a single file or a folder of part files.
    return sync_stream.run_available(
        t.spark, f"{t.root}/orders*.parquet", SCHEMAS["orders"], new_folder(t.spark, "stream"), KEYS, t.sync_rows)


@case("sync_stream_compacted", "SELECT * FROM f_source")
def compacted(t: DriverTables) -> DataFrame:
    """The table after three landings: what an old run had, the newest versions of every third voucher, all vouchers;
    the first is the base, the second a change, the third leads to a new base."""
    landing, folder = new_folder(t.spark, "landing"), new_folder(t.spark, "stream")
    source = t.sync_source()
    for rows in (t.sync_target(), source.filter(F.pmod(F.xxhash64("o_orderkey"), F.lit(6)) == 0), source):
        rows.write.mode("append").parquet(landing)
        found = sync_stream.run_available(t.spark, landing, source.schema, folder, KEYS, lambda landed: landed)
    return found


def _streamed_documents(name: str):
    def run(t: DriverTables) -> DataFrame:
        """The table after two landings. Movements come first, then lines and last the headers; the first landing is of an
        earlier day, the second one of today."""
        folder, landing = new_folder(t.spark, "documents"), new_folder(t.spark, "landing")
        reads = dict(reversed(sync_run.FOLLOWED[name].reads.items()))
        now = t.erp_stored(*reads)
        then = t.erp_tables_on("2000-01-01", "2000-06-01", now)
        landings = {table: f"{landing}/{table}" for table in reads}
        for step in (then, now):
            for table, number in reads.items():
                # A document's rows in one file.
                with settings(t.spark, RELEASED):
                    step[table].repartition("zid", number).write.mode("append").options(**STORED).parquet(landings[table])
            schemas = {table: now[table].schema for table in reads}
            found = document_stream.run_documents(t.spark, name, landings, schemas, folder, buckets=8)
        return prep.decimal_to_double(found)
    return run


for _table in ("sales", "purchase"):
    case(f"sync_streamed_{_table}", CASES[f"sync_all_{_table}"].sql)(_streamed_documents(_table))
