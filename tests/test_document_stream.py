"""Documents joined from several landing streams, in any order and after restarts."""

from __future__ import annotations

import pytest

from merchantry.sources import commits
from merchantry.streaming import document_stream
from tests.test_sources import erp_sales
from tests.test_sync_log import read

TABLES = ["opdor", "opddt", "imtrn"]


@pytest.fixture
def sales(spark, tmp_path):
    folder = f"{tmp_path}/store"
    landings = {table: f"{tmp_path}/landing/{table}" for table in TABLES}
    schemas = {table: rows.schema for table, rows in erp_sales(spark, [], [], []).items()}
    for table in TABLES:
        (tmp_path / "landing" / table).mkdir(parents=True)

    def land(tables, *names):
        for name in names or TABLES:
            tables[name].coalesce(1).write.mode("append").parquet(landings[name])

    def run():
        return document_stream.run_documents(spark, "sales", landings, schemas, folder, buckets=4)
    return land, run, folder


HEADS = [("a", "s", 1, None), ("b", "s", 1, None)]
LINES = [("a", "i", 1, 2, None), ("a", "k", 2, 2, None), ("b", "i", 1, 2, None)]
MOVES = [("a", "i", 5, 2, None)]
WHOLE = [("a", "i", "s", 1, 5), ("a", "k", "s", 2, 0), ("b", "i", "s", 1, 0)]


@pytest.mark.parametrize("order", [TABLES[::-1], ["opddt", "opdor", "imtrn"]])
def test_tables_may_come_in_any_order(spark, sales, order):
    land, run, _ = sales
    for table in order:
        land(erp_sales(spark, HEADS, LINES, MOVES), table)
        got = run()
    assert read(got) == WHOLE


def test_changes_late_files_and_restarts(spark, sales, monkeypatch):
    land, run, folder = sales
    land(erp_sales(spark, HEADS, LINES, MOVES))
    assert read(run()) == WHOLE
    entry = commits.last_commit(spark, folder)
    assert read(run()) == WHOLE and commits.last_commit(spark, folder) == entry
    # The header changes, one line is gone, a header without a time comes; then a run that is killed before its entry.
    land(erp_sales(spark, [("a", "t", 1, 7), ("c", "s", None, None)], [("a", "k", 4, 2, 8), ("c", "i", 1, None, None)], MOVES), "opdor", "opddt")

    def ends(*args):
        raise RuntimeError("killed")
    with monkeypatch.context() as patched:
        patched.setattr(commits, "publish", ends)
        with pytest.raises(RuntimeError, match="killed"):
            run()
    assert commits.last_commit(spark, folder) == entry
    want = [("a", "k", "t", 4, 0), ("b", "i", "s", 1, 0), ("c", "i", "s", 1, 0)]
    assert read(run()) == want
    # An older state of a's header lands late; rows without a number belong to no document.
    land(erp_sales(spark, [("a", "s", 1, None), (None, "s", 1, None)], [], []), "opdor")
    assert read(run()) == want


def test_only_touched_buckets_are_written(spark, sales):
    land, run, folder = sales
    land(erp_sales(spark, [(str(n), "s", 1, None) for n in range(40)], [(str(n), "i", 1, 2, None) for n in range(40)], []))
    assert run().count() == 40
    before = commits.last_commit(spark, folder).versions
    land(erp_sales(spark, [("7", "other", 1, 5)], [], []), "opdor")
    assert {r["sp_id"] for r in run().filter("ordernumber = '7'").collect()} == {"other"}
    after = commits.last_commit(spark, folder).versions
    changed = {key for key in after if after[key] != before.get(key)}
    assert before.keys() == after.keys() and len({key.split("/")[1] for key in changed}) == 1


def test_nothing_landed(sales):
    _, run, _ = sales
    assert run().count() == 0
