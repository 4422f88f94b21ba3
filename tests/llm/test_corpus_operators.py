"""N-gram join, repeats, lines, licences and quotations against plain loops and SQL."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from merchantry.llm import components, licenses, line_dedup, ngram_join, quotes, repeats, rolling
from tests.llm.conftest import rows_of
from tests.oracle import compare


def words(rng, n):
    return [rng.choice("ab cd ef gh Ij kl mn op qr st uv wx yz à é".split()) + str(rng.randint(0, 40)) for _ in range(n)]


def in_duckdb(rows, table="documents"):
    con = duckdb.connect()
    if table == "documents":
        con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [(r[0], r[1], "en", r[3] if len(r) > 3 else "src0") for r in rows])
    else:
        con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return con


# ---- n-gram join ---------------------------------------------------------------------------------

def plain_components(rows):
    sets = []
    for d, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append((d, frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))))
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    real = [(d, s) for d, s in sets if d is not None and s]
    for i, (d, s) in enumerate(real):
        for e, q in real[:i]:
            both = len(s & q)
            if 100 * both >= 80 * (len(s) + len(q) - both) and root(d) != root(e):
                a, b = sorted((root(d), root(e)))
                up[b] = a
    return sorted(((d, len(s), None if d is None else root(d) if s else d) for d, s in sets), key=repr)


def near_copies():
    rng = random.Random(1)
    line, bases, rows = words(rng, 30), [words(rng, rng.choice([6, 20, 60, 200])) for _ in range(12)], []
    for i in range(200):
        own = list(rng.choice(bases)) if i % 3 else words(rng, rng.randint(0, 80))
        for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
            if own:
                own[rng.randrange(len(own))] = words(rng, 1)[0]
        rows.append((i, " ".join(own + line * (i % 4 == 0))))
    return rows + [(None, rows[3][1]), (1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A  b"), (1005, "a b c"), (3, rows[3][1]), (1006, rows[5][1]), (1006, "totally other text with more words here"), (1007, "long " * 20_000)]


@pytest.mark.parametrize("common", [64, 3])
def test_ngram_components(documents, monkeypatch, common):
    monkeypatch.setattr(ngram_join, "COMMON", common)
    rows = near_copies()
    got = ngram_join.jaccard_components(documents(rows)).select("doc_id", "n_shingles", "component_id")
    assert rows_of(got) == plain_components(rows)


def test_one_of_each_group_stays(documents):
    rows = near_copies()[:80] + [(None, "no id"), (500, "")]
    want = [c for d, n, c in plain_components(rows) if d is not None and d == c]
    kept = ngram_join.keep_one(documents(rows))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want)) and kept.columns == documents(rows).columns


def test_ngram_join_of_nothing(documents):
    assert ngram_join.jaccard_components(documents([])).collect() == []


def test_trie_finds_the_similar_sets():
    for seed in range(150):
        rng = np.random.default_rng(seed)
        base = np.unique(rng.integers(0, 10 ** 6, 60).astype(np.uint64))
        sets = [np.unique(np.concatenate([base[rng.random(len(base)) > rng.choice([0, .05, .2])], rng.integers(0, 10 ** 6, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(12)] + [base[:5], base[:6], base, base]
        probe = base if seed % 2 else sets[0]
        want = [(i, len(np.intersect1d(s, probe))) for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= 80 * len(np.union1d(s, probe))]
        assert sorted(ngram_join.Trie(sets).overlaps(probe)) == want


def test_sketches_never_hide_a_link():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 2 ** 63, n // 12).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
            assert ngram_join.may_link(len(a), len(b), ngram_join.sketch(a), ngram_join.sketch(b))


def test_large_shingles_are_compared_in_cells(session, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 8)
    # (h, sig, n, root): one large component beside small ones; many single sets; two components of a size; one component alone.
    rows = [(1, i, 100 + i % 40, 0 if i >= 3 else i + 900) for i in range(200)] + [(2, 1000 + i, 50 + i % 9, 1000 + i) for i in range(30)]
    rows += [(3, 2000 + i, 80, i % 2) for i in range(40)] + [(4, 3000 + i, 80, 7) for i in range(50)] + [(5, 4000 + i, 80 + i, i % 3) for i in range(6)]
    placed = session.createDataFrame(rows, "h long, sig long, n long, root long")
    cells = ngram_join.in_cells(placed.join(ngram_join.component_counts(placed), "h")).withColumn("sketch", F.lit(bytes(8)).cast("binary")).repartition(3, "h", "p", "q").cache()
    assert max(r["count"] for r in cells.groupBy("h", "p", "q").count().collect()) < 40
    assert {r.h for r in cells.collect()} == {1, 2, 3, 5}
    got = {tuple(r) for r in cells.sortWithinPartitions("h", "p", "q", "n", "sig").mapInArrow(ngram_join._across(None), "x long, y long").collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[3] != b[3] and 100 * min(a[2], b[2]) >= 80 * max(a[2], b[2])}


@pytest.mark.parametrize("cell", [1, 3])
def test_cells_lose_no_link(documents, monkeypatch, cell):
    base, rng = words(random.Random(31), 120), random.Random(32)
    rows = []
    for i in range(40):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(base[:60] + words(rng, 60))) for i in range(6)]
    monkeypatch.setattr(ngram_join, "CELL", cell)
    df = ngram_join.jaccard_components(documents(rows)).select("doc_id", "n_shingles", "component_id")
    assert compare(df, in_duckdb(rows), ngram_join.SQL)[0] is None


def test_links_are_called_what_they_are(documents):
    assert ngram_join.jaccard_components(documents([])).columns == ["doc_id", "n_shingles", "component_id", "n_verified", "set_id"]


def test_components_of_a_chain(session):
    links = session.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "x long, y long")
    got = dict(tuple(r) for r in components.components(links).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90}


def test_long_rows_have_the_same_words(monkeypatch):
    text = (" ".join(words(random.Random(2), 900)) + "\n" + "x" * 700).encode()
    data, offsets = np.frombuffer(text * 2, np.uint8), np.array([0, len(text), 2 * len(text)])
    want = [h.tolist() for _, h in rolling.words_by_row(data, offsets)]
    monkeypatch.setattr(rolling, "SLICE", 300)
    assert [h.tolist() for _, h in rolling.words_by_row(data, offsets)] == want and len(want[0]) == 901


# ---- repeats -------------------------------------------------------------------------------------

def plain_repeats(rows):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(b[i:i + 400] for _, b in texts for i in range(len(b) - 399))
    out = []
    for d, b in texts:
        edge = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - 399):
            if count[b[i:i + 400]] > 1:
                edge[i] += 1
                edge[i + 400] -= 1
        gone = np.cumsum(edge)[:len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("crowd", [5000, 0])
def test_repeats(documents, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rng, rows = random.Random(4), []
    text = lambda n: " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(n))
    passages, short = [text(150) for _ in range(4)], text(60)
    for i in range(90):
        own = text(rng.randint(0, 200))
        own = {0: text(40) + passages[0][:rng.randint(300, len(passages[0]))] + text(50), 1: text(30) + passages[1] + text(30) + passages[1][50:] + text(5), 2: text(50) + short + text(100),
               3: passages[2][rng.randint(0, 200):] + passages[3], 4: "ab" * rng.randint(100, 700)}.get(i % 8, own)
        if i % 8 == 5:
            own = rows[rng.randrange(len(rows))][1]
            at = rng.randrange(len(own) + 1)
            own = own[:at] + "X" + own[at:]
        rows.append((i, own))
    rows += [(None, passages[0]), (7, None), (8, ""), (3, rows[3][1]), (3, rows[3][1]), (500, passages[3][:399]), (501, passages[3][:400]), (502, "z" * 399), (503, "q" * 400), (504, "y" * 401), (505, "w" * 30_000)]
    got = repeats.without_repeats(documents(rows))
    assert rows_of(got.drop("kept", "text")) == plain_repeats(rows)
    texts = sorted(t or "" for _, t in rows)
    for r in got.collect():
        assert r.text == r.kept.decode("utf-8", "replace") if r.n_removed else r.text in texts and r.kept is None


@pytest.mark.parametrize("crowd", [5000, 0])
def test_bearers_of_a_passage_do_not_meet(documents, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "MEETING", 5)
    one = repeats._repeated_windows

    def few(group):
        if group.groupby("route").size().max() > 5:
            raise ValueError("a task holds all bearers of a passage")
        return one(group)

    monkeypatch.setattr(repeats, "_repeated_windows", few)
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choices("abcde", k=rng.randint(1, 6))) for _ in range(n))
    passage, other = text(130), text(130)
    rows = [(i, text(80) + passage + text(80)) for i in range(30)] + [(100 + i, text(80) + other + text(80)) for i in range(2)]
    rows += [(200, passage + passage), (201, text(200)), (3, rows[3][1])]
    assert rows_of(repeats.without_repeats(documents(rows)).drop("kept", "text")) == plain_repeats(rows)


def test_repeats_of_nothing(documents):
    assert repeats.without_repeats(documents([])).collect() == []


def test_slices_hold_each_window_once(monkeypatch):
    rng = np.random.default_rng(3)
    lengths = [0, 399, 400, 401, 5000, 20_000, 10]
    data, offsets = rng.integers(97, 99, sum(lengths)).astype(np.uint8), np.concatenate([[0], np.cumsum(lengths)])
    for size in (1 << 20, 1500):
        monkeypatch.setattr(repeats, "SLICE", size)
        monkeypatch.setattr(rolling, "SLICE", size)
        seen = Counter()
        for found, begins in repeats.contexts_of(data, offsets):
            for row, lo, hi, begin in zip(found["row"], found["lo"], found["hi"], begins, strict=True):
                assert begin == offsets[row] + lo
                seen.update((int(row), w) for w in range(lo, hi + 1))
        assert seen == Counter((r, w) for r, n in enumerate(lengths) for w in range(n - 399))


def test_merged_transforms_order_all_windows():
    rng = np.random.default_rng(7)
    shards = [rng.integers(0, 3, (4, n)).astype(np.uint64) for n in (5, 0, 40, 17)]
    order, interval = repeats.merge([repeats.Shard(b) for b in shards])
    rows = np.concatenate(shards, axis=1)[::-1].T[order].tolist()  # the last round adds the first block
    assert rows == sorted(rows) and sorted(order) == list(range(62))
    assert [a == b for a, b in zip(rows, rows[1:])] == [a == b for a, b in zip(interval.tolist(), interval.tolist()[1:])]


# ---- lines, licences, quotations -----------------------------------------------------------------

def test_lines_of_many_sites_go(documents):
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choice(["wide", " wide\t", "narrow", "", "  ", f"own {i}", "edge8", "edge9"]) for _ in range(rng.randint(1, 9))), "en", f"s{i % 20}") for i in range(200)]
    rows = [(d, "\n".join(x for x in t.split("\n") if (x != "edge8" or d % 20 < 8) and (x != "edge9" or d % 20 < 9)), n, s) for d, t, n, s in rows]
    rows += [(900, None, "en", None), (901, "", "en", "s1"), (902, "wide\n" * 3000, "en", None), (3, *rows[3][1:]), (None, "wide\nx", "en", "s2")]
    df = line_dedup.line_dedup(documents(rows))
    sites = {}
    for _, t, _, s in rows:
        for line in (t or "").split("\n"):
            sites.setdefault(line.strip(" \t\r\v\f"), set()).add(s or "")
    want = []
    for d, t, _, _ in rows:
        lines = (t or "").split("\n")
        bad = [bool(x.strip(" \t\r\v\f")) and len(sites[x.strip(" \t\r\v\f")]) > 8 for x in lines]
        want.append((d, sum(bool(x.strip(" \t\r\v\f")) for x in lines), sum(bad), "\n".join(x for x, b in zip(lines, bad, strict=True) if not b)))
    assert rows_of(df) == sorted(want, key=repr) and len(sites["edge9"]) == 9 and len(sites["edge8"]) == 8
    assert line_dedup.line_dedup(documents([])).collect() == []


def test_licences(documents):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of it.\nThe above copyright notice and this permission notice shall be included. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted.\nRedistributions of source code must retain the above copyright notice.\nRedistributions in binary form must reproduce the above copyright notice."
    rows = [(1, "Text. Licensed under the Apache License, Version 2.0."), (2, mit), (3, "The software is provided as is without warranty of any kind.\n" + mit.split("\n")[0]), (4, bsd), (5, bsd + "\nNeither the name of X nor others may be used to endorse or promote products."),
            (6, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (7, "A licence nobody knows."), (8, None), (9, ""), (10, "word " * 30_000 + ". This work is licensed under the GNU General Public License, version 3."), (None, "All rights reserved."), (1, "Text. Licensed under the Apache License, Version 2.0.")]
    df = licenses.licenses(documents(rows))
    got = {r.doc_id: r.licenses for r in df.collect()}
    assert got == {1: "Apache-2.0", 2: "MIT", 3: "", 4: "BSD-2-Clause", 5: "BSD-3-Clause", 6: "MIT,CC-BY-NC-4.0", 7: "", 8: "", 9: "", 10: "GPL-3.0", None: ""}
    assert compare(df, in_duckdb(rows), licenses.sql())[0] is None
    assert licenses.licenses(documents([])).collect() == []


def test_wrapped_licences(documents):
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above
   copyright notice, this list of conditions and the following disclaimer.
"""
    name = "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one."
    apache = "you may not use this file except in\ncompliance with the License.\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS."
    rows = [(1, bsd + name), (2, bsd), (3, gpl), (4, mpl), (5, apache), (6, "Under the Mozilla Public License, v. 2.0."), (7, "Released under the MIT\nLicense\nLicensed under the Apache\nLicense, Version 2.0"),
            (8, "Released under the MIT License\nLicensed under the Apache License, Version 2.0"), (9, "under the terms of the GNU\n\nGeneral Public License")]
    rows += [(10 * d + k, "\n".join(mark + line for line in t.split("\n"))) for d, t in rows[:4] for k, mark in ((1, " * "), (2, "# "), (3, "// "), (4, "-- "))]
    got = {r.doc_id: r.licenses for r in licenses.licenses(documents(rows)).collect()}
    want = {1: "BSD-3-Clause", 2: "BSD-2-Clause", 3: "GPL-3.0", 4: "MPL-2.0", 5: "Apache-2.0", 6: "MPL-2.0", 7: "Apache-2.0,MIT", 8: "Apache-2.0,MIT", 9: ""}
    assert got == want | {10 * d + k: want[d] for d in range(1, 5) for k in range(1, 5)}


def test_quotations(session):
    rows = [(1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "> How are you?\nFine."), (1, 2, "user", "> Hello there. How are you?\nAgain"), (1, 3, "assistant", ">> how ARE  you?\n> Fine.\nOk"), (1, 4, "user", "> nothing known\nx"),
            (1, 5, "user", "> ok\n> Again\nx"), (2, 0, "user", None), (2, 1, "user", "> Fine."), (2, 2, "user", ""), (3, 5000, "u", "> a"), (3, 1, "u", "a"), (3, 4500, "u", "a"), (3, 9000, "u", "> a\n> b"), (3, 9001, "v", "b"), (3, 9001, "v", "b"), (4, 7, "u", "y " * 30_000)]
    rows += [(5, i, "u", f"> line {i - 1}\nline {i}") for i in range(40)]
    df = quotes.linked_conversations(session.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert compare(df, in_duckdb(rows, "conversations"), quotes.SQL)[0] is None
    got = {(r.conv_id, r.turn): r for r in df.collect()}
    assert got[(1, 3)].reply_to == 1 and got[(1, 3)].depth == 2 and got[(1, 5)].reply_to == 2 and got[(3, 9000)].reply_to == 4500 and got[(5, 39)].depth == 39
    odd = session.createDataFrame([(None, 1, "u", "a"), (None, 2, "u", "> a"), (1, None, None, "> b")], "conv_id long, turn long, role string, text string")
    assert all(r.reply_to is None for r in quotes.linked_conversations(odd).collect())
    assert quotes.linked_conversations(session.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
