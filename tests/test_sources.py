from __future__ import annotations

import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchantry.operators import sync
from merchantry.sources import catalog, erp, extracts, schemas, sinks
from merchantry.streaming import sync_stream


def test_declared_schemas_cover_all_tables():
    assert sum(len(schemas.declared_schema(t).fields) for t in schemas.TABLES) == 104
    sales = schemas.declared_schema("sales")
    assert sales.fieldNames()[:4] == ["uuid", "itime", "utime", "zid"]
    assert sales["totalsales"].dataType == T.DecimalType(18, 4) and not sales["uuid"].nullable
    assert "itime" not in schemas.declared_schema("stock").fieldNames()


def test_schema_from_json_spec():
    spec = {"database": {"tables": [{"name": "t", "columns": [
        {"name": "uuid", "type": "VARCHAR", "constraints": ["PRIMARY KEY"]},
        {"name": "n", "type": "INT", "constraints": []}, {"name": "at", "type": "TIMESTAMP"}]}]}}
    schema = schemas.schemas_from_spec(json.dumps(spec))["t"]
    assert schema.simpleString() == "struct<uuid:string,n:int,at:timestamp_ntz>" and not schema["uuid"].nullable


def test_jdbc_predicates_split_without_gap_or_overlap():
    predicates = catalog.jdbc_predicates([7], ["2001-01-01", "2000-01-01"])
    assert predicates == [
        "zid = 7 AND (itime < '2000-01-01' OR itime IS NULL)",
        "zid = 7 AND (itime >= '2000-01-01' AND itime < '2001-01-01')",
        "zid = 7 AND (itime >= '2001-01-01')"]
    assert catalog.jdbc_predicates([1, 2], ["2000-01-01"], timed=False) == ["zid = 1 AND (1 = 1)", "zid = 2 AND (1 = 1)"]


def test_file_tables_and_catalog(spark, tmp_path):
    rows = spark.createDataFrame([("u", 5, 2000, 1, "W", 2.5)],
                                 "uuid string, zid int, year int, month int, warehouse string, stockvalue double")
    schemas.conform(rows, "stock_value").write.parquet(f"{tmp_path}/stock_value")
    source = catalog.Catalog(catalog.file_tables(spark, str(tmp_path)))
    assert source.extract("stock_value", [5]).count() == 1 and source.extract("stock_value", [6]).count() == 0
    with pytest.raises(KeyError):
        source.extract("nothing")


def test_configuration_maps(spark):
    text = json.dumps({"businesses": {"1": {"zorg": "A", "projects": ["p", "q"]}, "2": {"zorg": "B", "projects": []}}})
    config = spark.createDataFrame([(text,)], "config string")
    assert {tuple(r) for r in catalog.business_projects(config).collect()} == {(1, "p"), (1, "q")}
    lists = spark.createDataFrame([(json.dumps({"1": {"a": "s1", "b": ["s2", "s3"]}}),)], "config string")
    assert {tuple(r) for r in catalog.supplier_lists(lists).collect()} == {(1, "a", "s1"), (1, "b", "s2"), (1, "b", "s3")}
    labels = catalog.labels_from_json('{"income_statement_label": {"x": "l"}, "balance_sheet_label": {}}')
    assert [tuple(r) for r in catalog.label_dimension(spark, labels).collect()] == [("x", "income", "l")]


def test_accounts_without_type_stay(spark):
    rows = [(1, "a", "n", None, "", "", "", ""), (1, "b", "n", "Asset", "", "", "", ""), (1, "c", "n", "Income", "", "", "", "")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c == 'zid' else 'string'}" for c in extracts.ACCOUNT_COLUMNS))
    assert {r["ac_code"] for r in extracts.gl_accounts(df, ["Income"]).collect()} == {"a", "b"}


def test_ap_split_ignores_lines_without_supplier(spark):
    accounts = spark.createDataFrame([(1, "x")], "zid int, ac_code string")
    details = spark.createDataFrame(
        [(1, "x", "s1", "P", "v", 1.0), (1, "x", "s2", "P", "v", 4.0), (1, "x", None, "P", "v", 9.0)],
        "zid int, ac_code string, ac_sub string, project string, voucher string, value double")
    headers = spark.createDataFrame([(1, "v", 2000, 1)], "zid int, voucher string, year int, month int")
    got = {r["source"]: r["total"] for r in extracts.gl_ap_split(accounts, details, headers, ["x"], ["s1"], 12).collect()}
    assert got == {"INTERNAL": 1.0, "EXTERNAL": 4.0}


def test_sales_extract_keeps_headers_without_lines(spark):
    heads = spark.createDataFrame([(1, "d1", "2000-01-01", "s", "c", None, None), (1, "d2", "2000-01-01", "s", "c", None, None)],
                                  "zid int, xdornum string, xdate string, xsp string, xcus string, ztime timestamp_ntz, zutime timestamp_ntz")
    lines = spark.createDataFrame([(1, "d1", "i", 2.0, 20.0, None, None)],
                                  "zid int, xdornum string, xitem string, xqty double, xlineamt double, ztime timestamp_ntz, zutime timestamp_ntz")
    moves = spark.createDataFrame([(1, "d1", "i", 5.0, None, None), (1, "d1", "i", 6.0, None, None)],
                                  "zid int, xdocnum string, xitem string, xval double, ztime timestamp_ntz, zutime timestamp_ntz")
    rows = {r["ordernumber"]: r for r in erp.etl_sales(heads, lines, moves).collect()}
    assert rows["d2"]["itemcode"] is None and rows["d2"]["zid"] is None
    assert rows["d1"]["quantity"] == 4.0 and rows["d1"]["cost"] == 11.0


def test_report_file_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "area string, y2000_1 double")
    path = sinks.write_report(df, f"{tmp_path}/r")
    assert sinks.read_report(spark, path, df.schema).collect() == df.collect()
    assert sinks.flatten_name(("2000", "January ")) == "2000_January"


SYNC = "k int, j int, v string, itime timestamp_ntz, utime timestamp_ntz"


def sync_rows(spark, rows):
    import datetime as dt
    at = lambda n: None if n is None else dt.datetime(2000, 1, 1) + dt.timedelta(days=n)
    return spark.createDataFrame([(k, 0, v, at(i), at(u)) for k, v, i, u in rows], SYNC)


def test_sync_merge_replaces_and_repeats_without_effect(spark):
    target = sync_rows(spark, [(1, "a", 1, None), (3, "c", 5, 6)])
    source = sync_rows(spark, [(1, "A", 1, 9), (2, "late", 2, None), (3, "c", 5, 6), (4, "d", 8, None)])
    once = sync.synchronise(source, target, ["k", "j"])
    assert {(r["k"], r["v"]) for r in once.collect()} == {(1, "A"), (2, "late"), (3, "c"), (4, "d")}
    twice = sync.synchronise(source, once, ["k", "j"])
    assert sorted(map(repr, twice.collect())) == sorted(map(repr, once.collect()))
    appended = sync.synchronise(source, target, ["k", "j"], "append")
    assert sorted((r["k"], r["v"]) for r in appended.collect()) == [(1, "A"), (1, "a"), (2, "late"), (3, "c"), (4, "d")]


def test_first_sync_takes_everything(spark):
    source = sync_rows(spark, [(1, "a", 1, None), (2, "b", None, None)])
    assert sync.incremental_extract(source, source.limit(0)).count() == 2


def test_surrogate_key_is_stable_and_tells_rows_apart(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "x"), ("", "x")], "p string, q string")
    keys = [r["uuid"] for r in sync.surrogate_key(df, ["p", "q"]).collect()]
    assert len(set(keys)) == 4 and keys == [r["uuid"] for r in sync.surrogate_key(df, ["p", "q"]).collect()]


def test_stream_takes_in_new_files_and_survives_a_restart(spark, tmp_path):
    landing, folder = f"{tmp_path}/landing", f"{tmp_path}/state"
    first = sync_rows(spark, [(1, "a", 1, None), (1, "a2", 1, 3), (2, "b", 2, None)])
    first.coalesce(1).write.mode("append").parquet(landing)
    run = lambda: {(r["k"], r["v"]) for r in sync_stream.run_available(
        spark, landing, first.schema, folder, ["k", "j"], lambda df: df).collect()}
    assert run() == {(1, "a2"), (2, "b")}
    assert run() == {(1, "a2"), (2, "b")}
    sync_rows(spark, [(2, "b2", 2, 9), (3, "c", 9, None)]).coalesce(1).write.mode("append").parquet(landing)
    assert run() == {(1, "a2"), (2, "b2"), (3, "c")}


def test_a_late_file_does_not_bring_an_older_version_back(spark, tmp_path):
    landing, folder = f"{tmp_path}/landing", f"{tmp_path}/state"
    rows = sync_rows(spark, [(1, "new", 1, 9)])
    run = lambda: {(r["k"], r["v"]) for r in sync_stream.run_available(
        spark, landing, rows.schema, folder, ["k", "j"], lambda df: df).collect()}
    rows.limit(0).write.parquet(landing)
    assert run() == set()
    rows.coalesce(1).write.mode("append").parquet(landing)
    assert run() == {(1, "new")}
    sync_rows(spark, [(1, "old", 1, 3), (2, "b", 2, None)]).coalesce(1).write.mode("append").parquet(landing)
    assert run() == {(1, "new"), (2, "b")}


def test_merge_takes_changes_at_the_watermark(spark):
    target = sync_rows(spark, [(1, "a", 1, 5), (2, "b", 1, 5)])
    source = sync_rows(spark, [(1, "a", 1, 5), (2, "b2", 1, 5)])
    assert {(r["k"], r["v"]) for r in sync.synchronise(source, target, ["k", "j"]).collect()} == {(1, "a"), (2, "b2")}


def test_every_company_of_the_region_table_has_all_items(spark, tmp_path):
    from merchantry.sources.driver_tables import SCHEMAS, DriverTables
    for name in ("region", "part"):
        spark.read.schema(SCHEMAS[name]).parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([(7, "x"), (9, "y")], SCHEMAS["region"]).write.mode("append").parquet(f"{tmp_path}/region.parquet")
    t = DriverTables(spark, str(tmp_path))
    parts = t.raw("part").count()
    assert {r["zid"]: r["count"] for r in t.items().groupBy("zid").count().collect()} == {z: parts for z in [*range(100000, 100005), 100007, 100009]}


def erp_sales(spark, heads, lines, moves):
    """Tables of sales documents of one company; times are days, the second one of a change."""
    import datetime as dt
    at = lambda n: None if n is None else dt.datetime(2000, 1, 1) + dt.timedelta(days=n)
    timed = lambda rows: [(1, *row[:-2], at(row[-2]), at(row[-1])) for row in rows]
    times = "ztime timestamp_ntz, zutime timestamp_ntz"
    day = dt.date(2000, 1, 1)
    return {
        "opdor": spark.createDataFrame(timed([(n, day, sp, "c", i, u) for n, sp, i, u in heads]), f"zid int, xdornum string, xdate date, xsp string, xcus string, {times}"),
        "opddt": spark.createDataFrame(timed([(n, item, D(q), D(q), i, u) for n, item, q, i, u in lines]), f"zid int, xdornum string, xitem string, xqty decimal(18,4), xlineamt decimal(18,4), {times}"),
        "imtrn": spark.createDataFrame(timed([(n, item, D(v), i, u) for n, item, v, i, u in moves]), f"zid int, xdocnum string, xitem string, xval decimal(18,4), {times}"),
    }


def test_sync_run_finds_changes_in_header_line_and_movement(spark):
    from merchantry.plans import sync_run
    heads = [("a", "s", 1, None), ("b", "s", 1, None), ("c", "s", 1, None), ("lost", "s", 1, None), ("d", "s", 1, None), ("empty", "s", 1, None)]
    lines = [(n, "i", 1, 2, 2) for n in "abcd"] + [("lost", "i", 1, 2, None)]
    moves = [(n, "i", 5, 2, None) for n in "abcd"]
    before = erp_sales(spark, heads, lines + [("d", "gone", 1, 1, None)], moves)
    first = sync_run.sync_table("sales", before, sync_run.FOLLOWED["sales"].extract(
        *[before[n] for n in ("opdor", "opddt", "imtrn")]).limit(0))
    assert first.count() == 6 and first.filter("zid IS NULL").count() == 0
    target = first.filter("ordernumber <> 'lost'").cache()
    heads[0] = ("a", "other", 1, 7)
    lines[1] = ("b", "i", 3, 2, 7)
    moves[2] = ("c", "i", 9, 2, 7)
    heads[4] = ("d", "s", 1, 7)
    heads.append(("new", "s", 8, None))
    after = erp_sales(spark, heads, lines + [("new", "i", 1, 8, None)], moves)
    found = sync_run.documents_to_fetch(sync_run.FOLLOWED["sales"], after, target)
    assert {r["number"] for r in found.collect()} >= {"a", "b", "c", "d", "lost", "new"}
    once = sync_run.sync_table("sales", after, target).cache()
    read = lambda df: sorted((r["ordernumber"], r["itemcode"], r["sp_id"], float(r["quantity"]), float(r["cost"] or 0)) for r in df.collect())
    assert read(once) == [("a", "i", "other", 1, 5), ("b", "i", "s", 3, 5), ("c", "i", "s", 1, 9), ("d", "i", "s", 1, 5), ("lost", "i", "s", 1, 0), ("new", "i", "s", 1, 0)]
    assert read(sync_run.sync_table("sales", after, once)) == read(once)


def test_sync_run_counts_every_update_where_none_was_seen(spark):
    from merchantry.plans import sync_run
    tables = erp_sales(spark, [("a", "s", 1, 2), ("b", "s", 9, None)], [("a", "i", 1, 1, None), ("b", "i", 1, 9, None)], [("a", "i", 1, 1, None)])
    target = sync_run.FOLLOWED["sales"].extract(tables["opdor"].withColumn("xsp", F.lit("old")), tables["opddt"], tables["imtrn"])
    assert {r["sp_id"] for r in sync_run.sync_table("sales", tables, target).collect()} == {"s"}


def test_failed_refresh_leaves_the_old_content(spark, tmp_path):
    path = f"{tmp_path}/table"
    df = spark.range(3).toDF("n")
    assert sinks.full_refresh(df, path).count() == 3
    with pytest.raises(Exception, match="broken"):
        sinks.full_refresh(df.select(F.when(F.col("n") > 1, F.raise_error(F.lit("broken"))).otherwise(F.col("n")).cast("long").alias("n")), path)
    assert sinks.current_version(spark, path, df.schema).count() == 3
    assert sinks.full_refresh(df.filter("n > 0"), path).count() == 2


def test_refresh_of_a_table_from_itself(spark, tmp_path):
    """Content read from a table can be written back to it, as the new version lies beside the old."""
    path = f"{tmp_path}/table"
    old = sinks.full_refresh(spark.range(3).toDF("n"), path)
    assert sinks.full_refresh(old.unionByName(spark.range(3, 5).toDF("n")), path).count() == 5


def test_facts_in_folders_open_only_what_is_asked_for(spark, tmp_path):
    from merchantry.sources import layout
    rows = [(z, y, f"v{n}", n) for n, (z, y) in enumerate((z, y) for z in (1, 2, None) for y in (2000, 2001, 2002) for _ in range(20))]
    facts = spark.createDataFrame(rows, "zid int, year int, voucher string, n int").select("voucher", "zid", "n", "year")
    path, dimension = f"{tmp_path}/facts", f"{tmp_path}/companies"
    layout.write_facts(facts, path, ["voucher"], files=3)
    layout.write_facts(facts, path, ["voucher"], files=3)
    spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "zid int, name string").write.parquet(dimension)
    one = spark.read.parquet(dimension).filter("name = 'one'")
    got = layout.read_facts(spark, path, facts.schema, one, [2000, 2002])
    want = sorted((v, z, n, y) for z, y, v, n in rows if z == 1 and y != 2001)
    assert got.columns == facts.columns and sorted(tuple(r) for r in got.collect()) == want
    scan = next(line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "facts" in line)
    assert "PartitionFilters" in scan and "dynamicpruning" in scan and "year#" in scan.split("PartitionFilters")[1]
    assert all(len(list(folder.glob("*.parquet"))) <= 3 for folder in tmp_path.glob("facts/zid=*/year=*"))
    listed = lambda **kw: layout.read_facts(spark, path, facts.schema, **kw).count()
    assert (listed(), listed(companies=[2]), listed(years=[]), listed(companies=[1, 2], years=[2001])) == (180, 60, 0, 40)
