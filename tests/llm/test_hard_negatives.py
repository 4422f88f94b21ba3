"""Hard negatives against plain loops and SQL."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from merchantry.llm import hard_negatives as hn
from merchantry.llm.hard_negatives import Best, Block
from tests.llm.conftest import rows_of
from tests.oracle import compare

SCHEMA = "vec_id long, embedding array<float>, label int, id long, vector string, block long, uid long, score double, `rank` int"


def vectors(session, rows, parts=3):
    return session.createDataFrame([(i, v, y, 4, "v", None, 1, 0.5, 1) for i, v, y in rows], SCHEMA).repartition(parts)


def odd_rows(seed, n=260, dims=12):
    rng = np.random.default_rng(seed)
    rows = [(i, (np.round(rng.normal(size=dims), 1) * 0.3).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    rows += [(50, rows[50][1], rows[50][2]), (50, rows[51][1], 1), (None, rows[3][1], 2), (None, None, 1), (300, None, 1), (301, rows[1][1], None),
             (350, [float("nan")] * dims, 1), (351, [float("inf")] * dims, 1), (352, [None] * dims, 1), (400, [0.0] * dims, 1), (-50, rows[7][1], 3), (-49, rows[7][1], -3)]
    return rows + [(1000 + i, rows[9][1], 1) for i in range(80)]  # ties


def in_duckdb(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings(vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    return con


@pytest.mark.parametrize(("seed", "anchor_bytes"), [(1, 8_000_000), (2, 400)])
def test_matches_sql(session, monkeypatch, tmp_path, seed, anchor_bytes):
    monkeypatch.setattr(hn, "ANCHOR_BYTES", anchor_bytes)  # several scans
    rows = odd_rows(seed)
    folder = str(tmp_path / "embeddings.parquet")
    vectors(session, rows).write.parquet(folder)
    problem, n = compare(hn.op11_hard_negatives(session, str(tmp_path)), in_duckdb(rows), hn.SQL)
    assert problem is None and n > 10, problem


def block_of(matrix, labels):
    at = np.arange(matrix.shape[1])
    return Block(5, at * 3, np.zeros(len(at), bool), labels, matrix, matrix.min(axis=1), matrix.max(axis=1))


def test_a_scan_finds_what_a_full_one_does_and_reads_less():
    rng = np.random.default_rng(0)
    spread = np.linspace(1, 0.02, 64)  # most of a vector in a few dimensions, as the order of magnitudes wants
    matrix = np.floor(256 * rng.normal(size=(64, 3000)) * spread[:, None]).astype(np.int64)
    block = block_of(matrix, np.zeros(3000, np.int64))
    cells = 0
    for a in range(40):
        query = matrix[:, a]
        scores = query @ matrix
        lows = [np.iinfo(np.int64).min, int(np.quantile(scores, 0.6)), 10 ** 9]
        highs = [np.iinfo(np.int64).max, int(np.quantile(scores, 0.9)), 2 * 10 ** 9]
        windows = [Best(low, high, 3) for low, high in zip(lows, highs, strict=True)]
        wanted = rng.random(3000) > 0.2
        cells += hn.scan(block, matrix.astype(hn.exact_type(block, int(np.abs(query).max()))), query, wanted, windows)
        for w in windows:
            want = sorted((-int(scores[i]), int(block.ids[i]), int(block.uid(i))) for i in np.flatnonzero(wanted & (scores >= w.low) & (scores <= w.high)))[:3]
            assert w.rows == want
    assert cells < 0.8 * 40 * 64 * 2400


def test_exact_types():
    block = block_of(np.array([[1 << 20, -5], [3, 1 << 20]]), np.zeros(2))
    assert hn.exact_type(block, 1) is np.float32 and hn.exact_type(block, 1 << 20) is np.float64 and hn.exact_type(block, 1 << 40) is np.int64
    with pytest.raises(ArithmeticError):
        hn.exact_type(block, 1 << 50)


def test_vectors_of_several_lengths_and_nothing(session):
    schema = "id long, label long, vector array<long>, block int"
    rows = [(50, 1, [2, 3], 0), (1, 1, [5], 0), (2, 2, [3], 0), (3, 2, [], 0), (4, 2, [0, 0, 9], 0)]
    got = rows_of(hn.hard_negatives(session.createDataFrame(rows, schema)))
    assert got == [(50, 1, 1, 2, 10, 6)]
    assert hn.hard_negatives(session.createDataFrame([], schema)).collect() == []
    assert hn.hard_negatives(session.createDataFrame([(1, 1, [1], 0)], schema)).collect() == []
