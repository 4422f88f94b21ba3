"""What is exchanged, stored and held by a task."""

from __future__ import annotations

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from merchantry import cases, session
from merchantry.operators import netting
from merchantry.plans import baskets, statements, sync_run
from merchantry.sources import commits, erp, extracts
from merchantry.sources.driver_tables import DriverTables

TIMES = "ztime timestamp_ntz, zutime timestamp_ntz"


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition")


@pytest.fixture
def shuffled(spark):
    """Joins as large tables get them."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def documents(spark):
    heads = spark.createDataFrame(
        [(1, "d1", None, "s", "c", None, None), (1, "d1", None, "s", "c", None, None), (1, "d2", None, "s", "c", None, None),
         (None, "d3", None, "s", "c", None, None), (1, None, None, "s", "c", None, None)],
        f"zid int, xdornum string, xdate date, xsp string, xcus string, {TIMES}")
    lines = spark.createDataFrame(
        [(1, "d1", "i", D(2), D(20), None, None), (1, "d1", "i", D(3), D(30), None, None), (1, "d1", None, D(1), D(1), None, None),
         (1, "d9", "i", D(1), D(1), None, None), (None, "d3", "i", D(1), D(1), None, None)],
        f"zid int, xdornum string, xitem string, xqty decimal(18,4), xlineamt decimal(18,4), {TIMES}")
    moves = spark.createDataFrame(
        [(1, "d1", "i", D(5), None, None), (1, "d1", "i", D(6), None, None), (1, "d1", None, D(7), None, None)],
        f"zid int, xdocnum string, xitem string, xval decimal(18,4), {TIMES}")
    return heads, lines, moves


def test_documents_are_exchanged_four_times_and_keep_their_rows(shuffled):
    """Lines, movements, heads, and the rows where the first two met."""
    rows = erp.etl_sales(*documents(shuffled))
    assert exchanges(rows) <= 4
    found = sorted([(r["zid"], r["ordernumber"], r["itemcode"], r["quantity"], r["cost"]) for r in rows.collect()], key=str)
    # Two heads, two movements: 5 * 2 * 2; cost 11 for two lines and two heads. A null item meets no movement.
    assert found == sorted([
        (1, "d1", "i", D(20), D(44)), (1, "d1", None, D(2), None), (None, "d2", None, None, None),
        (None, "d3", None, None, None), (None, None, None, None, None)], key=str)


def test_an_exchange_has_partitions_for_its_input(spark, tmp_path):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    (tmp_path / "t.parquet").write_bytes(b"0" * (session.PARTITION_INPUT * 60))
    try:
        session.sized_for(spark, [f"{tmp_path}/t.parquet", f"{tmp_path}/absent.parquet"])
        assert int(spark.conf.get(name)) == 60
        session.sized_for(spark, [])
        assert spark.conf.get(name) == spark.conf.get("spark.sql.shuffle.partitions")
    finally:
        spark.conf.unset(name)
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_periods_are_spread_after_the_account_met_its_figures(shuffled):
    accounts = shuffled.createDataFrame(
        [(1, "A1", "a", "Income", "T", "G", "H", "K00"), (1, "A2", "b", "Income", "T", "G", "H", "K99")],
        "zid int, ac_code string, ac_name string, ac_type string, ac_lv1 string, ac_lv2 string, ac_lv3 string, ac_lv4 string")
    rollup = shuffled.createDataFrame(
        [(1, "P", "A1", 2000, 3, D("1.25")), (1, "P", "A1", 2000, 4, None), (1, "Q", "A1", 2001, 1, D("2.5"))],
        "zid int, project string, ac_code string, year int, month int, value decimal(18,4)")
    projects = rollup.select("zid", "project").distinct()
    found = statements.statement_monthly(accounts, rollup, projects, {"K00": "line"}, 2001, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode([2000-01") < plan.index("Join LeftOuter")
    assert found.count() == 2 * 2 * 14
    assert {(r["project"], r["ac_code"], r["period"], r["value"]) for r in found.filter("value != 0").collect()} == {
        ("P", "A1", "2000-03", D("1.2000")), ("Q", "A1", "2001-01", D("2.5000"))}


def test_equal_rows_are_told_by_their_numbers(spark):
    rows = lambda *values: spark.createDataFrame([(v, None) for v in values], "a int, b string")
    assert sync_run._same_rows(rows(1, 1, None), rows(None, 1, 1))
    assert not sync_run._same_rows(rows(1, 1, 2), rows(1, 2, 2))
    assert not sync_run._same_rows(rows(1), rows(1, 1))


def test_a_run_reads_stored_tables(spark, tmp_path, monkeypatch):
    """Each ERP table that a run reads is derived once."""
    seen = []

    class Tables:
        def erp_stored(self, *names):
            seen.append(names)
            return dict.fromkeys(names, spark.range(1))

        def outdated(self, name, tables):
            return spark.range(1)

    run = cases.load()["sync_all_sales"].build
    monkeypatch.setattr(sync_run, "sync_table", lambda name, tables, target: target)
    run(Tables()).collect()
    assert seen == [("opdor", "opddt", "imtrn")]


def test_pairs_of_a_basket_matrix_are_counted_once(spark, monkeypatch):
    sales = spark.createDataFrame(
        [(1, v, i, D(1)) for v, items in (("a", "xy"), ("b", "xyz"), ("c", "xz")) for i in items],
        "zid int, voucher string, itemcode string, quantity decimal(18,4)")
    labels, keep = [], baskets.cut_lineage
    monkeypatch.setattr(baskets, "cut_lineage", lambda df, label="step": (labels.append(label), keep(df, label))[1])
    found = baskets.basket_matrix(sales)
    assert "cells" in labels
    assert {(r["itemcode"], r["other"], r["support"]) for r in found.collect()} >= {("x", "y", 0.6667), ("y", "x", 1.0)}


def test_a_folder_is_written_by_all_tasks(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 4).withColumn("part", F.col("id") % 2)
    place, _ = commits.write_version(rows, str(tmp_path), "t", ["part"])
    assert all(len(list((tmp_path / place / f"part={k}").glob("*.parquet"))) == 4 for k in (0, 1))
    assert commits.read_version(spark, str(tmp_path), (place, rows.schema.json())).count() == 4000


def test_rows_per_company_are_no_small_dimension(spark, tmp_path):
    """Their estimated size counts them for each company, so that they are not broadcast."""
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    spark.range(5).selectExpr("int(id) r_regionkey", "'r' r_name").write.parquet(f"{tmp_path}/region.parquet")
    spark.range(1000).selectExpr("id p_partkey", "'n' p_name", "'b' p_brand", "'t' p_type", "1 p_size", "1d p_retailprice").write.parquet(
        f"{tmp_path}/part.parquet")
    tables = DriverTables(spark, str(tmp_path))
    part = tables.raw("part").select("p_partkey")
    assert size(tables.accounts().select("zid", "ac_code")) >= 5 * size(part)
    assert tables.accounts().count() == 5000


def shuffle_files(spark) -> int:
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()


def test_a_stored_step_leaves_no_shuffle_files(shuffled):
    name = next(iter(session.RELEASED))
    before, setting = shuffle_files(shuffled), shuffled.conf.get(name)
    rows = shuffled.range(1000).withColumn("k", F.col("id") % 7)
    stored = session.cut_lineage(rows.join(rows.groupBy("k").count(), "k"))
    assert shuffle_files(shuffled) <= before
    assert stored.count() == 1000 and shuffled.conf.get(name) == setting


def test_fetched_documents_are_exchanged_once(shuffled):
    """Rows of three tables, and the wanted documents beside each; the same rows as dealt by document and item."""
    heads, lines, moves = documents(shuffled)
    sources = {"opdor": heads, "opddt": lines, "imtrn": moves}
    wanted = shuffled.createDataFrame([(1, "d1"), (1, "d2"), (1, "d9")], "zid int, number string")
    followed = sync_run.FOLLOWED["sales"]
    fresh = sync_run._extracted(followed, sources, wanted)
    with session.settings(shuffled, session.TOGETHER):
        assert exchanges(fresh) <= 6
    plain = lambda rows: sorted(map(str, rows.collect()))
    assert plain(sync_run.stored_documents(fresh)) == plain(erp.etl_sales(
        heads, lines, moves).filter("ordernumber = 'd1' and zid = 1").drop(*erp.TRAILING_TIMES))


def test_what_waited_is_removed_after_the_entry(spark, tmp_path):
    path = tmp_path / "landed" / "since=0"
    path.mkdir(parents=True)
    (path / "part").write_text("x")
    session.forget(spark, f"{tmp_path}/landed/since=0")
    session.forget(spark, f"{tmp_path}/landed/since=0")
    assert not path.exists() and (tmp_path / "landed").exists()


def test_a_star_in_steps_keeps_its_rows(shuffled, monkeypatch):
    make = shuffled.createDataFrame
    sales = make([(1, f"v{n % 5}", None, f"s{n % 3}", f"c{n % 2}", f"i{n % 4}", D(n), D(n), None) for n in range(40)],
                 "zid int, ordernumber string, date date, sp_id string, cusid string, itemcode string, quantity decimal(18,4), "
                 "totalsales decimal(18,4), cost decimal(18,4)")
    people = make([(1, "s0", "a"), (1, "s0", "a"), (1, "s1", None)], "zid int, spid string, spname string")
    buyers = make([(1, "c0", "b", "x"), (1, "c1", "c", None)], "zid int, cusid string, cusname string, cuscity string")
    goods = make([(1, "i1", "d", "g"), (1, "i2", "e", "g"), (1, None, "f", "g")], "zid int, itemcode string, itemname string, itemgroup2 string")
    plain = lambda rows: sorted(map(str, rows.collect()))
    whole, before = plain(extracts.scan_sales(sales, people, buyers, goods)), shuffle_files(shuffled)
    stepped = extracts.scan_sales(sales, people, buyers, goods, steps=True)
    assert shuffle_files(shuffled) <= before and exchanges(stepped) == 2
    assert len(whole) > 10 and plain(stepped) == whole


def net_facts(spark, value):
    rows = [(n % 2, f"s{n % 3}", "n", f"a{n % 2}", f"c{n % 5}", "m", f"i{n % 4}", "o", None if n % 7 == 0 else f"g{n % 2}", D(n)) for n in range(60)]
    return spark.createDataFrame(rows, "zid int, spid string, spname string, area string, cusid string, cusname string, "
                                       f"itemcode string, itemname string, itemgroup string, {value} decimal(18,4)")


def test_cross_relations_in_steps_keep_one_exchange_at_a_time(shuffled, monkeypatch):
    labels, keep = [], netting.cut_lineage
    monkeypatch.setattr(netting, "cut_lineage", lambda df, label="step": (labels.append(label), keep(df, label))[1])
    sales, returns = net_facts(shuffled, "totalsales"), net_facts(shuffled, "treturnamt").filter("itemcode = 'i1'")
    plain = lambda rows: sorted(map(str, rows.collect()))
    stepped = netting.cross_relations(sales, returns, steps=True)
    assert labels.count("cells") == 10 and exchanges(stepped) == 0
    assert plain(stepped) == plain(netting.cross_relations(sales, returns))


def test_a_stored_frame_takes_the_place_of_another(spark):
    first = session.cut_lineage(spark.range(10).withColumn("b", F.lit(1)))
    second = session.stored_instead(first.filter("id > 3"), first)
    assert second.count() == 6
    gone = spark._jvm.org.apache.hadoop.fs.Path(first.inputFiles()[0].rpartition("/")[0])
    assert not gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(gone)


def test_pairs_of_a_basket_are_gone_before_its_report(shuffled):
    """The report joins stored companions and exchanges no pair again."""
    rows = shuffled.createDataFrame([(1, v, i, True) for v in "abc" for i in "wxyz" if (v, i) != ("a", "z")],
                                    "zid int, voucher string, itemcode string, present boolean")
    best = baskets.top_associates(rows)
    assert exchanges(best) == 0 and best.filter("itemcode = 'w' and rank = 1").first()["other"] == "x"
