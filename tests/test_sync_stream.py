"""The compacted change store behind the synchronisation stream."""

from __future__ import annotations

import pytest

from merchantry.sources import commits
from merchantry.streaming import sync_stream
from tests.test_sources import sync_rows


@pytest.fixture
def store(spark, tmp_path):
    landing, folder = f"{tmp_path}/landing", f"{tmp_path}/store"
    schema = sync_rows(spark, [(1, "a", 1, None)]).schema

    def land(rows, **options):
        sync_rows(spark, rows).coalesce(1).write.mode("append").parquet(landing)
        return run(**options)

    def run(**options):
        table = sync_stream.run_available(spark, landing, schema, folder, ["k", "j"], lambda df: df, **options)
        return {(r["k"], r["v"]) for r in table.collect()}
    return land, run, folder, schema


def test_rows_read_do_not_grow_with_the_history(spark, store):
    land, _, folder, schema = store
    keys, read = range(40), []
    for step in range(6):
        got = land([(k, f"v{step}", 1, 2 + step) for k in keys[:20]] + ([(k, "first", 1, None) for k in keys[20:]] if step == 0 else []))
        base, changes = sync_stream.held(spark, folder, schema)
        read.append(base.count() + changes.count())
        assert got == {(k, f"v{step}") for k in keys[:20]} | {(k, "first") for k in keys[20:]}
    assert max(read) <= 40 * (1 + sync_stream.SHARE) and read[-1] == read[0]


def test_small_changes_leave_the_base(spark, store):
    land, _, folder, schema = store
    land([(k, "a", 1, None) for k in range(40)])
    before = commits.last_commit(spark, folder)
    assert (0, "b") in land([(0, "b", 1, 5)])
    base, changes = sync_stream.held(spark, folder, schema)
    assert commits.last_commit(spark, folder) == before and base.count() == 40 and changes.count() == 1


@pytest.mark.parametrize("share", [0.0, 100.0])
def test_late_files_and_ties_with_and_without_compaction(store, share):
    land, run, _, _ = store
    land([(1, "new", 1, 9), (2, "x", 1, 5)], share=share)
    # Older than what is held; the same time, landed later; a row without any time.
    got = land([(1, "old", 1, 3), (2, "y", 1, 5), (3, "z", None, None)], share=share)
    assert got == {(1, "new"), (2, "y"), (3, "z")} == run(share=share)


def test_a_compaction_that_ends_early_changes_nothing(spark, store, monkeypatch):
    land, run, folder, _ = store
    land([(1, "a", 1, None), (2, "b", 1, None)])
    before = commits.last_commit(spark, folder)

    def ends(*args):
        raise RuntimeError("killed")
    with monkeypatch.context() as patched:
        patched.setattr(commits, "publish", ends)
        with pytest.raises(RuntimeError, match="killed"):
            land([(1, "c", 1, 7), (3, "d", 1, None)])
    assert commits.last_commit(spark, folder) == before
    assert run() == {(1, "c"), (2, "b"), (3, "d")}
    assert commits.last_commit(spark, folder).number == before.number + 1


def test_null_keys_are_one_key(store):
    land, _, _, _ = store
    land([(None, "a", 1, None), (1, "b", 1, None)])
    assert land([(None, "c", 1, 4)], share=100.0) == {(None, "c"), (1, "b")}


def test_nothing_landed(spark, tmp_path):
    (tmp_path / "landing").mkdir()
    schema = sync_rows(spark, [(1, "a", 1, None)]).schema
    table = sync_stream.run_available(spark, f"{tmp_path}/landing", schema, f"{tmp_path}/store", ["k", "j"], lambda df: df)
    assert table.count() == 0 and table.schema.names == schema.names
