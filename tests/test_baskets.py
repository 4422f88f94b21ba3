"""Companions against counting every pair by hand."""

from __future__ import annotations

import random
from collections import Counter
from itertools import permutations

import pytest

from merchantry.plans import baskets


def frame(spark, rows):
    return spark.createDataFrame(
        [(1, v, i, f"name {i}", float(q), 10.0 * q) for v, i, q in rows],
        "zid int, voucher string, itemcode string, itemname string, quantity double, totalsales double")


def by_hand(rows, top=5):
    quantity = Counter()
    for voucher, item, q in rows:
        quantity[voucher, item] += q
    items = sorted({i for _, i in quantity})
    holding = {i: {v for (v, j), q in quantity.items() if j == i and q >= 1} for i in items}
    best = {}
    for item in items:
        if holding[item]:
            others = sorted((-len(holding[item] & holding[j]), j) for j in items if j != item)
            best[item] = [(j, -n) for n, j in others[:top]]
    return best, holding


def found(presence, block):
    got = {}
    for r in sorted(baskets.top_associates(presence, block).collect(), key=lambda r: (r["itemcode"], r["rank"])):
        got.setdefault(r["itemcode"], []).append((r["other"], r["shared"]))
    return got


def hot_voucher_rows():
    """One voucher holds a third of the lines and nearly all items; the rest are small."""
    rng = random.Random(5)
    rows = [("hot", f"i{k:02d}", rng.choice([0.4, 1, 2])) for k in range(40) for _ in range(3)]
    for v in range(60):
        for _ in range(rng.randrange(1, 6)):
            rows.append((f"v{v}", f"i{rng.randrange(44):02d}", rng.choice([0.5, 1, 3])))
    return rows


@pytest.mark.parametrize("block", [1, 3, 256])
def test_every_block_size_gives_the_exact_companions(spark, block):
    rows = hot_voucher_rows()
    presence = baskets.item_presence(baskets.voucher_items(frame(spark, rows), "voucher"))
    assert found(presence, block) == by_hand(rows)[0]


def test_hot_voucher_is_not_paired_out(spark):
    rows = [("hot", f"i{k:05d}", 1.0) for k in range(20_000)] + [("v", "i00000", 1.0), ("v", "i00001", 1.0)]
    # A voucher of its own for each, some with a neighbour: no two items are in the same vouchers.
    rows += [(f"own{k}", f"i{m:05d}", 1.0) for k in range(20_000) for m in ({k, k + 1} if k % 10 == 0 else {k})]
    present = baskets.item_presence(baskets.voucher_items(frame(spark, rows), "voucher")).filter("present").drop("present")
    assert baskets.met_pairs(present, baskets.skipped_vouchers(present)).count() < 10_000
    got = found(present.selectExpr("*", "true AS present"), 256)
    assert len(got) == 20_000
    assert got["i00000"] == [("i00001", 3), *[(f"i0000{k}", 1) for k in range(2, 6)]]
    assert got["i00003"] == [(f"i0000{k}", 1) for k in (0, 1, 2, 4, 5)]
    assert got["i00030"] == [("i00031", 2), *[(f"i0000{k}", 1) for k in range(4)]]


def test_several_large_vouchers_of_the_same_items(spark):
    """Three vouchers hold 2,000 items, a fourth half of them; counting their pairs would take millions of rows."""
    rows = [(f"hot{v}", f"i{k:04d}", 1.0) for v in range(3) for k in range(2000)] + [("half", f"i{k:04d}", 1.0) for k in range(0, 2000, 2)]
    rows += [(f"own{k}", f"i{m:04d}", 1.0) for k in range(2000) for m in {k, (k * 7 + 1) % 2000}]
    present = baskets.item_presence(baskets.voucher_items(frame(spark, rows), "voucher")).filter("present").drop("present")
    assert baskets.met_pairs(present, baskets.skipped_vouchers(present)).count() < 20_000
    got = found(present.selectExpr("*", "true AS present"), 256)
    few = sorted(random.Random(2).sample(range(2000), 40))
    holding = {}
    for v, i, _ in rows:
        holding.setdefault(i, set()).add(v)
    for k in few:
        item = f"i{k:04d}"
        want = sorted((-len(holding[item] & holding[j]), j) for j in holding if j != item)[:5]
        assert got[item] == [(j, -n) for n, j in want]


@pytest.mark.parametrize(("depth", "seed"), [(1, 1), (2, 2), (4, 3), (4, 4)])
def test_companions_at_random(spark, depth, seed):
    rng = random.Random(seed)
    rows = [(f"v{v}", f"i{rng.randrange(30):02d}", 1.0) for v in range(40) for _ in range(rng.choice([1, 2, 5, 25]))]
    rows += [(f"w{v}", f"i{k:02d}", 1.0) for v in range(4) for k in range(v, 28)]
    presence = baskets.item_presence(baskets.voucher_items(frame(spark, rows), "voucher"))
    got = {}
    for r in sorted(baskets.top_associates(presence, 4, depth=depth).collect(), key=lambda r: (r["itemcode"], r["rank"])):
        got.setdefault(r["itemcode"], []).append((r["other"], r["shared"]))
    assert got == by_hand(rows)[0]


@pytest.mark.parametrize("large", [0, 1, 4, 20, 64])
def test_companions_whatever_counts_as_a_large_voucher(spark, large):
    rng = random.Random(large)
    rows = hot_voucher_rows() + [(f"w{v}", f"i{k:02d}", 1.0) for v in range(4) for k in range(v, 28)]
    rows += [(f"u{v}", f"i{rng.randrange(30):02d}", 1.0) for v in range(20) for _ in range(rng.choice([1, 5, 25]))]
    presence = baskets.item_presence(baskets.voucher_items(frame(spark, rows), "voucher"))
    got = {}
    for r in sorted(baskets.top_associates(presence, 4, large=large).collect(), key=lambda r: (r["itemcode"], r["rank"])):
        got.setdefault(r["itemcode"], []).append((r["other"], r["shared"]))
    assert got == by_hand(rows)[0]


def test_ordinary_vouchers_are_not_skipped(spark):
    rows = [(f"v{v}", f"i{(v * 3 + k) % 50:02d}", 1.0) for v in range(60) for k in range(7)]
    present = baskets.item_presence(baskets.voucher_items(frame(spark, rows), "voucher")).filter("present").drop("present")
    assert baskets.skipped_vouchers(present).count() == 0
    assert baskets.listed_pairs(present).count() == 60 * 21


def test_large_voucher_of_different_items_in_blocks(spark):
    """Every item is also in a voucher of its own, or in two or three: no two are alike, all pairs are counted."""
    rows = [("hot", f"i{k:03d}", 1.0) for k in range(300)] + [
        (f"v{k}-{j}", f"i{m:03d}", 1.0) for k in range(300) for j in range(k % 3 + 1) for m in {k, (k * 7 + j) % 300}]
    presence = baskets.item_presence(baskets.voucher_items(frame(spark, rows), "voucher"))
    assert found(presence, 40) == by_hand(rows)[0]


def test_padding_and_items_below_one_unit(spark):
    rows = [("v1", "a", 1.0), ("v1", "b", 1.0), ("v2", "c", 0.5), ("v3", "d", 2.0), ("v4", "e", 1.0), ("v5", "f", 1.0),
            ("v6", "g", 1.0)]
    report = {r["itemcode"]: r for r in baskets.purchase_basket(
        frame(spark, rows).withColumnRenamed("voucher", "grnvoucher")).collect()}
    assert [report["a"][f"item_{k}"] for k in range(1, 6)] == ["b", "c", "d", "e", "f"]
    assert [report["a"][f"support_{k}"] for k in range(1, 6)] == [1.0, 0.0, 0.0, 0.0, 0.0]
    assert report["c"]["purchase_count"] == 0 and report["c"]["item_1"] is None


def test_sales_basket_totals(spark):
    rows = [("v1", "a", 1.0), ("v1", "b", 2.0), ("v2", "a", 1.0)]
    stock = spark.createDataFrame([(1, "a", 5.0)], "zid int, itemcode string, stockqty double")
    report = {r["itemcode"]: r for r in baskets.sales_basket(frame(spark, rows), stock).collect()}
    assert report["a"]["item_1"] == "b" and report["a"]["support_1"] == 0.5
    assert report["a"]["total_sales_all_items"] == 40.0 and report["a"]["stockqty"] == 5.0
    assert report["b"]["item_1_name"] == "name a" and report["b"]["support_1"] == 1.0 and report["b"]["stockqty"] is None
    best, holding = by_hand(rows)
    for item in best:
        for other, n in best[item]:
            assert 0 <= n / len(holding[item]) <= 1


def test_matrix_keeps_strongest_rows(spark):
    rows = [("v1", "a", 1.0), ("v1", "b", 1.0), ("v2", "c", 1.0), ("v2", "d", 1.0), ("v3", "c", 1.0)]
    cells = {(r["itemcode"], r["other"]): r["support"] for r in baskets.basket_matrix(frame(spark, rows), rows=2).collect()}
    assert cells == {("a", "b"): 1.0, ("b", "a"): 1.0}
