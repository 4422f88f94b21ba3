"""Conversation repair against all edit sequences, and against SQL."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest

from merchantry.llm import repair
from tests.llm.conftest import rows_of
from tests.oracle import compare

SCHEMA = "conv_id long, turn long, role string, text string, part int, at long, fault string, digest string, paths string"


def table(session, rows, parts=3):
    return session.createDataFrame([(*r, 1, 2, "x", "y", None) for r in rows], SCHEMA).repartition(parts)


def plain_faults(rows):
    """Rows (role, text) in order with the first fault of each."""
    seen, out = set(), []
    for role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]+", "", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def every_repair(rows):
    """(cost, audit, lines) of all edit sequences with at most two insertions in a row."""
    def go(i, state, cost, audit, lines, inserted):
        if i == len(rows) and state in repair.COMPLETE:
            yield cost, audit, lines
        given = repair.GIVEN[state]
        if inserted < 2:
            yield from go(i, repair.STEPS[state, given[0]], cost + 2, audit + "I", (*lines, f"{given}:"), inserted + 1)
        if i == len(rows):
            return
        role, text, fault = rows[i]
        yield from go(i + 1, state, cost + 3, audit + "D", lines, 0)
        if fault in ("", "truncated"):
            extra = fault == "truncated"
            if (state, role[:1]) in repair.STEPS:
                yield from go(i + 1, repair.STEPS[state, role[0]], cost + extra, audit + "K", (*lines, f"{role}:{text}"), 0)
            yield from go(i + 1, repair.STEPS[state, given[0]], cost + 2 + extra, audit + "R", (*lines, f"{given}:{text}"), 0)
    return go(0, 0, 0, "", (), 0)


def plain_repair(conv, rows):
    """rows: (turn, role, text) of one conversation."""
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in rows))
    marked = plain_faults([(r, x) for *_, r, x in rows])
    turns = {t for known, t, *_ in rows if known}
    count = lambda f: sum(m[2] == f for m in marked)
    cost, audit, lines = min(every_repair(marked), key=lambda c: c[:2])
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def odd_rows(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for _ in range(rng.randint(1, 5)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 4, 9]), rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None, "usher"]),
                         rng.choice(["Yes.", "No", "", " \n\t", None, "Why? ", "a ", "x. ", "é!", "Well.\n"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_lightest_repairs(session, seed):
    rows = odd_rows(seed)
    frame = table(session, rows).selectExpr("*", "true AS present")
    want = [plain_repair(c, [r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}]
    assert rows_of(repair.repaired(frame)) == sorted(want, key=repr)


def test_damaged_conversations_match_sql(session):
    rows = odd_rows(3, 300) + [(7, 1, "user", "the same."), (7, 1, "user", "the same.")] * 3 + [(400, 2, "user", "long " * 100_000), (401, -(1 << 40), "user", "a."), (401, 1 << 40, "assistant", "b.")]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    problem, n = compare(repair.repaired(repair.damaged(table(session, rows))), con, repair.SQL)
    assert problem is None and n > 300, problem


def test_one_long_conversation_over_several_tasks_and_segments(session):
    rng = random.Random(5)
    rows = [(1, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", f"own {i}.", f"cut {i}", ""])) for i in range(4000)] + [(2, 1, "user", "a."), (2, 1, "user", "a.")]
    got = {r.conv_id: r for r in repair.repaired(table(session, rows, 4).selectExpr("*", "true AS present")).collect()}
    ordered = sorted(r[1:] for r in rows if r[0] == 1)
    marked = plain_faults([r[1:] for r in ordered])
    cost, audit = min((v for s, v in repair.derivations([(r, f) for r, _, f in marked], 0).items() if s in repair.COMPLETE))
    lines = repair.edited([(r, x) for r, x, _ in marked], audit, 0)
    assert (got[1].cost, got[1].audit, got[1].repaired_sha256) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    assert (got[2].duplicate, got[2].audit, got[2].cost) == (1, "DKI"[1:2] + "DI", 5)


def test_segments_of_any_size_join_up_to_the_same():
    rng = random.Random(9)
    for _ in range(60):
        rows = plain_faults([(rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "c!", ""])) for _ in range(rng.randint(0, 9))])
        results = set()
        for size in (1, 2, 3, 20):
            whole = repair.Whole()
            for at in range(0, max(len(rows), 1), size):
                one = repair.Segment(at == 0)
                for k, (role, text, fault) in enumerate(rows[at:at + size]):
                    one.add((at + k) // 2, role, text, fault)
                whole.add(one.summary(1, 0, at))
            results.add(whole.result(1))
        assert len(results) == 1


def test_nothing_left_and_nothing_given(session):
    gone = [(c, t, "user", "x.") for c in range(60) for t in range(1)]
    got = rows_of(repair.repaired(repair.damaged(table(session, gone))))
    assert len(got) == 60 and (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in {r[1:] for r in got}
    assert repair.repaired(repair.damaged(table(session, []))).collect() == []
