"""Logged synchronisation runs: marks per ERP table, one publishing step, runs that end early."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from merchantry.plans import sync_run
from merchantry.sources import commits
from tests.test_sources import erp_sales


def read(df):
    return sorted((r["ordernumber"], r["itemcode"], r["sp_id"], float(r["quantity"]), float(r["cost"] or 0)) for r in df.collect())


def first_day(spark):
    heads = [("a", "s", 1, None), ("b", "s", 1, None)]
    # The line of b came on day 9, long after the headers.
    return heads, [("a", "i", 1, 2, None), ("b", "i", 1, 9, None)], [("a", "i", 5, 2, None)]


def test_header_changed_before_the_newest_line_arrives(spark, tmp_path):
    folder = f"{tmp_path}/s"
    heads, lines, moves = first_day(spark)
    first = sync_run.run_logged(erp_sales(spark, heads, lines, moves), folder, ["sales"])["sales"]
    assert read(first) == [("a", "i", "s", 1, 5), ("b", "i", "s", 1, 0)]
    heads[0] = ("a", "other", 1, 5)
    later = erp_sales(spark, heads, lines, moves)
    # By the target's own watermark, day 9, the change of day 5 is not seen ...
    own = first.withColumn("utime", F.col("itime"))
    assert ("a", "i", "other", 1, 5) not in read(sync_run.sync_table("sales", later, own))
    # ... but the log knows that headers were read up to day 1.
    assert read(sync_run.run_logged(later, folder, ["sales"])["sales"]) == [("a", "i", "other", 1, 5), ("b", "i", "s", 1, 0)]


def test_a_run_without_changes_keeps_the_version(spark, tmp_path):
    folder = f"{tmp_path}/s"
    tables = erp_sales(spark, *first_day(spark))
    sync_run.run_logged(tables, folder, ["sales"])
    one = commits.last_commit(spark, folder)
    sync_run.run_logged(tables, folder, ["sales"])
    two = commits.last_commit(spark, folder)
    assert (one.number, two.number) == (1, 2) and one.versions == two.versions and one.marks == two.marks


@pytest.mark.parametrize("broken", ["publish", "write_version"])
def test_a_run_that_ends_early_is_repeated_without_loss_or_doubling(spark, tmp_path, monkeypatch, broken):
    folder = f"{tmp_path}/s"
    heads, lines, moves = first_day(spark)
    sync_run.run_logged(erp_sales(spark, heads, lines, moves), folder, ["sales"])
    before = commits.last_commit(spark, folder)
    heads.append(("c", "s", 3, None))
    heads[1] = ("b", "new", 1, 4)
    tables = erp_sales(spark, heads, lines + [("c", "i", 2, 3, None)], moves)
    write = commits.write_version

    def ends(*args):
        if broken == "write_version":
            write(*args)
        raise RuntimeError("killed")
    with monkeypatch.context() as patched:
        patched.setattr(commits, broken, ends)
        with pytest.raises(RuntimeError, match="killed"):
            sync_run.run_logged(tables, folder, ["sales"])
    assert commits.last_commit(spark, folder) == before
    want = [("a", "i", "s", 1, 5), ("b", "i", "new", 1, 0), ("c", "i", "s", 2, 0)]
    assert read(sync_run.run_logged(tables, folder, ["sales"])["sales"]) == want
    assert commits.last_commit(spark, folder).number == 2


def test_two_runs_from_one_entry_cannot_both_count(spark, tmp_path):
    folder = f"{tmp_path}/s"
    commits.publish(spark, folder, commits.Commit(1, {"opdor": {"itime": "2000-01-01 00:00:00", "utime": None}}, {}))
    with pytest.raises(Exception, match="exists"):
        commits.publish(spark, folder, commits.Commit(1, {}, {}))
    kept = commits.last_commit(spark, folder)
    assert kept.number == 1 and kept.marks == {"opdor": {"itime": "2000-01-01 00:00:00", "utime": None}}


def test_empty_tables_then_rows(spark, tmp_path):
    folder = f"{tmp_path}/s"
    tables = erp_sales(spark, *first_day(spark))
    empty = {name: rows.limit(0) for name, rows in tables.items()}
    assert sync_run.run_logged(empty, folder, ["sales"])["sales"].count() == 0
    assert commits.last_commit(spark, folder).marks["opdor"] == {"itime": None, "utime": None}
    assert len(read(sync_run.run_logged(tables, folder, ["sales"])["sales"])) == 2


def test_existing_table_is_adopted(spark, tmp_path):
    tables = erp_sales(spark, *first_day(spark))
    old = sync_run.FOLLOWED["sales"].extract(tables["opdor"], tables["opddt"], tables["imtrn"]).filter("ordernumber = 'a'")
    got = sync_run.run_logged(tables, f"{tmp_path}/s", ["sales"], adopt={"sales": old})["sales"]
    assert read(got) == [("a", "i", "s", 1, 5), ("b", "i", "s", 1, 0)]


def test_leaving_out_a_table_of_the_log_is_an_error(spark, tmp_path):
    folder = f"{tmp_path}/s"
    commits.publish(spark, folder, commits.Commit(1, {}, {"return": ("tables/return/x", "{}")}))
    with pytest.raises(ValueError, match="return"):
        sync_run.run_logged(erp_sales(spark, *first_day(spark)), folder, ["sales"])
