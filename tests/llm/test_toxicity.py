"""Toxicity: held-out accuracy, and what only a product of terms can tell."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from merchantry.llm import toxicity as tox

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(session):
    got = tox.op12_toxicity(session, SF).join(session.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert got and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    caught = [r.predicted for r in got if r.toxic]
    clean = [r.predicted for r in got if not r.toxic]
    assert sum(caught) / len(caught) > 0.85 and sum(clean) / len(clean) < 0.01
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_pairs_count_where_single_words_do_not(documents, session):
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(2000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice(["one", "two", "three", "four"]) for _ in range(6)] + ["clown"] * insult + ["neighbours"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        marks.append((i, int(insult and group)))
    labels = session.createDataFrame(marks, "doc_id long, toxic int")
    got = {r.doc_id: r for r in tox.toxicity(documents(rows), labels, F.col("doc_id") % 4 == 0).collect()}
    wrong = [d for d, y in marks if got[d].held_out and got[d].predicted != y]
    assert len(wrong) <= 2


def test_the_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    weights, at, values, row = rng.normal(size=(4, 3)), np.array([0, 1, 2, 1, 3]), rng.random(5), np.array([0, 0, 0, 1, 1])
    log_odds, sums, scaled = tox.raised(weights, 0.1, at, values, row, 2)
    plain = [0.1 + sum(weights[at[i], 0] * values[i] for i in range(5) if row[i] == r) + sum(
        values[i] * values[j] * weights[at[i], 1:] @ weights[at[j], 1:] for i in range(5) for j in range(i) if row[i] == row[j] == r) for r in range(2)]
    assert np.allclose(log_odds, plain)


def test_odd_rows_and_labels(documents, session):
    rows = [(i, "clown idiot" if i % 2 else "fine words here") for i in range(200)] + [(None, "idiot"), (500, None), (501, ""), (502, "word " * 200_000 + "clown"), (1, "clown idiot"), (503, "1234 !!")]
    labels = session.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, 0), (7, None), (500, 1), (501, 0)], "doc_id long, toxic int")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = tox.toxicity(documents(rows), labels, held_out).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].predicted == 1 and not by_id[None].held_out and by_id[502].score > by_id[500].score == by_id[501].score == by_id[503].score
    assert len({r.score for r in got if r.doc_id == 1}) == 1


@pytest.mark.parametrize("marks", [[], [(1, 0), (2, 0)], [(2, None)]])
def test_labels_that_teach_nothing(documents, session, marks):
    labels = session.createDataFrame(marks, "doc_id long, toxic int")
    got = tox.toxicity(documents([(1, "a"), (2, "b"), (3, None)]), labels, F.lit(False)).collect()
    assert len(got) == 3 and len({r.score for r in got}) == 1 and {r.predicted for r in got} == {0}
    assert tox.toxicity(documents([]), labels, F.lit(False)).collect() == []


def test_words_found_again_are_the_same():
    for text in ("Ein GROẞES Maß, l'Été İstanbul ΟΔΟΣ ΣΑΣ.", "a_b 1a2 don’t ẋy ǅ ﬁ", "", None, "日本語 テスト 한국"):
        words = tox.words_of(text)
        assert tox.words_of(" ".join(sorted(words))) == words
