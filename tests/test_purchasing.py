"""Cohorts against a loop over lines, and the stock fold on worked numbers."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from merchantry.plans import purchasing

DAY = dt.date(2000, 1, 1)
SALES = "zid int, itemcode string, date date, year int, month int, quantity decimal(18,4), totalsales decimal(18,4)"
LINES = "zid int, itemcode string, itemname string, povoucher string, shipmentname string, combinedate date, " \
        "quantity decimal(18,4), cost decimal(18,4), uuid string"


def frames(spark, sales, lines):
    from decimal import Decimal
    day = lambda n: DAY + dt.timedelta(days=n)
    s = [(1, i, day(d), day(d).year, day(d).month, Decimal(q), Decimal(a)) for i, d, q, a in sales]
    p = [(1, i, f"name {i}", po, "S", day(d), Decimal(q), Decimal(3), f"u{n}")
         for n, (i, po, d, q) in enumerate(lines)]
    return spark.createDataFrame(s, SALES), spark.createDataFrame(p, LINES)


def by_hand(sales, lines):
    rows = {}
    previous = {}
    ordered = sorted(enumerate(lines), key=lambda e: (e[1][0], e[1][2], e[1][1], f"u{e[0]}"))
    for n, (item, po, day, quantity) in ordered:
        weeks, amount = [0] * 12, 0
        for other, d, q, a in sales:
            if other == item and 0 <= d - day < 84:
                weeks[(d - day) // 7] += q
                amount += a
        gap = day - previous[item] if item in previous else 0
        previous[item] = day
        left = quantity * 30.5 / sum(weeks[:4]) if sum(weeks[:4]) else 0.0
        rows[f"u{n}"] = (weeks, amount / sum(weeks) if sum(weeks) else 0.0, gap, left)
    return rows


def test_cohort_against_a_loop_with_a_hot_item(spark):
    rng = random.Random(2)
    pick = lambda: "hot" if rng.random() < 0.4 else f"i{rng.randrange(6)}"
    sales = [(pick(), rng.randrange(400), rng.randrange(1, 9), rng.randrange(1, 90)) for _ in range(900)]
    lines = [(pick(), f"IP--{rng.randrange(40)}", rng.randrange(400), rng.randrange(1, 50)) for _ in range(150)]
    want = by_hand(sales, lines)
    got = purchasing.purchase_cohort(*frames(spark, sales, lines), digits=None).collect()
    assert len(got) == len(lines)
    for r in got:
        weeks, price, gap, left = want[r["uuid"]]
        assert [r[c] for c in purchasing.WEEK_COLUMNS] == weeks
        assert r["average_sales_price"] == pytest.approx(price)
        assert r["days_since_last_purchase"] == gap
        assert r["days_of_product_left"] == pytest.approx(left) or (left == 0 and r["days_of_product_left"] is None)


def test_lines_of_one_day_share_the_gap_once(spark):
    lines = [("a", "IP--2", 10, 1), ("a", "IP--1", 10, 1), ("a", "IP--0", 4, 1)]
    got = {r["povoucher"]: r["days_since_last_purchase"]
           for r in purchasing.purchase_cohort(*frames(spark, [("a", 0, 1, 1)], lines)).collect()}
    assert got == {"IP--0": 0, "IP--1": 6, "IP--2": 0}


def test_cohort_plan_joins_no_pairs(spark):
    sales, lines = frames(spark, [("a", 0, 1, 1)], [("a", "IP--1", 0, 1)])
    plan = purchasing.purchase_cohort(sales, lines)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def base(spark, stock, mean, shipments, on_order):
    rows = [(1, "a", float(stock), float(mean), [{"arrival": a, "shipmentname": n} for a, n in shipments], on_order)]
    return spark.createDataFrame(
        rows, "zid int, itemcode string, stockqty double, n_mean double, "
              "shipments array<struct<arrival:string,shipmentname:string>>, on_order map<string,double>")


def test_stock_fold(spark):
    # Half a month to the first shipment of 10, a month more to the second of 5.
    shipments = [("2001-01-16", "MDKF-1,2001-01-16"), ("2001-02-15", "MDKF-2,2001-02-15")]
    df = base(spark, 20, 8, shipments, {"MDKF-1,2001-01-16": 10.0, "MDKF-2,2001-02-15": 5.0})
    row = purchasing.project_stock(df, "2001-01-01").first()
    assert [s["stock_before"] for s in row["steps"]] == [16.0, 18.0]
    assert row["final_stock"] == 15.0


def test_stock_never_falls_below_zero(spark):
    shipments = [("2001-03-01", "MDKF-1,2001-03-01"), ("2001-03-31", "MDKF-2,2001-03-31")]
    row = purchasing.project_stock(base(spark, 5, 30, shipments, {"MDKF-1,2001-03-01": 40.0}), "2001-01-30").first()
    assert [s["stock_before"] for s in row["steps"]] == [0.0, 10.0]
    assert row["final_stock"] == 0.0


@pytest.mark.parametrize("text", ["soon", "2001-13-45", None])
def test_unreadable_arrival_is_an_error_that_names_the_shipment(spark, text):
    shipments = [("2001-01-16", "MDKF-1,2001-01-16"), (text, f"MDKF-2,{text}")]
    with pytest.raises(Exception, match=f"no readable arrival date in shipment MDKF-2,{text}"):
        purchasing.project_stock(base(spark, 100, 3, shipments, {}), "2001-01-01").collect()


def test_no_shipments(spark):
    row = purchasing.project_stock(base(spark, 9, 2, [], {}), "2001-01-01").first()
    assert row["steps"] == [] and row["final_stock"] == 7.0


def test_requisition_lists_items_without_history(spark):
    sales, lines = frames(spark, [("a", 3, 4, 40), ("a", 40, 10, 90)], [("a", "IP--1", 0, 12)])
    orders = spark.createDataFrame(
        [(1, "a", "MDKF-1,2001-01-16", 7.0), (1, "z", "MDKF-2,2001-02-15", 1.0)],
        "zid int, itemcode string, shipmentname string, quantity double")
    stock = spark.createDataFrame(
        [(1, "a", "name a", "Hardware", 20.0), (1, "b", "name b", "Hardware", 3.0), (1, "c", "name c", "Paper", 1.0)],
        "zid int, itemcode string, itemname string, itemgroup string, stockqty double")
    cohort = purchasing.purchase_cohort(sales, lines)
    result = purchasing.purchase_requisition(cohort, orders, stock, sales, "2001-01-01")
    rows = {r["itemcode"]: r for r in result.collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"]["has_shipments"] and not rows["b"]["has_shipments"]
    assert rows["b"]["combinedate"] is None and rows["b"]["final_stock"] == 3.0
    assert rows["a"]["week_1"] == 4.0 and rows["a"]["n_mean"] == 7.0 and rows["a"]["shipments"] == 2
    wide = purchasing.requisition_wide(result, ["MDKF-1,2001-01-16", "MDKF-2,2001-02-15"])
    line = wide.filter("itemcode = 'a'").first()
    assert line["MDKF-1,2001-01-16"] == 7.0 and line["stock_before_MDKF-1,2001-01-16"] == 16.0


def test_seasonal_mean_drops_weak_months(spark):
    from merchantry.operators.ordered import seasonal_mean
    rows = [("a", 1, 100.0), ("a", 2, 100.0), ("a", 3, 13.0), ("a", 4, 14.3), ("b", 1, 0.0)]
    df = spark.createDataFrame([(1, i, 2000, m, q) for i, m, q in rows],
                               "zid int, itemcode string, year int, month int, quantity double")
    df = df.withColumn("quantity", F.col("quantity").cast("decimal(18,4)"))
    got = {r["itemcode"]: r["n_mean"] for r in seasonal_mean(df).collect()}
    # The plain mean is 56.825, so months below 11.365 would go; none does here.
    assert got["a"] == pytest.approx(227.3 / 4) and got["b"] == 0.0
    weak = df.filter("itemcode = 'a'").withColumn(
        "quantity", F.when(F.col("month") == 3, F.lit(1)).otherwise(F.col("quantity")).cast("decimal(18,4)"))
    assert seasonal_mean(weak).first()["n_mean"] == pytest.approx(214.3 / 3)


def test_walk_equals_the_fold_on_random_items(spark):
    rng = random.Random(11)
    day = dt.date(2001, 1, 1)
    names = {zid: [f"MDKF-{k},{day + dt.timedelta(days=rng.randrange(-20, 300))}" for k in range(9)] for zid in (1, 2)}
    items, ordered, want = [], [], {}
    for n in range(150):
        zid, code = 1 + n % 2, f"i{n}"
        stock, mean = float(rng.randrange(-20, 120)), rng.choice([0.0, 1.0, 7.25, rng.random() * 60])
        items.append((zid, code, stock, mean))
        quantities = {s: float(rng.randrange(1, 90)) for s in names[zid] if rng.random() < 0.4}
        ordered += [(zid, code, s, q) for s, q in quantities.items()]
        last = day
        for s in sorted(names[zid], key=lambda s: (s.split(",")[1], s)):
            arrives = dt.date.fromisoformat(s.split(",")[1])
            stock = max(stock - (arrives - last).days / 30.0 * mean, 0.0)
            want[code, s] = stock
            stock, last = stock + quantities.get(s, 0.0), arrives
    orders = spark.createDataFrame([(z, s) for z in names for s in names[z]], "zid int, shipmentname string")
    walk = purchasing.stock_walk(
        spark.createDataFrame(items, "zid int, itemcode string, stockqty double, n_mean double"),
        purchasing.arrivals(orders, "2001-01-01"),
        spark.createDataFrame(ordered, "zid int, itemcode string, shipmentname string, quantity double"))
    got = {(r["itemcode"], r["shipmentname"]): r["stock_before"] for r in walk.collect()}
    assert got.keys() == want.keys() and sum(v == 0.0 for v in want.values()) > 50
    for key, stock in want.items():
        assert got[key] == pytest.approx(stock, abs=1e-9), key


@pytest.mark.parametrize("text", ["soon", "2001-13-45"])
def test_arrivals_name_the_shipment_without_a_readable_date(spark, text):
    orders = spark.createDataFrame([(1, "MDKF-1,2001-01-16"), (1, f"MDKF-2,{text}")], "zid int, shipmentname string")
    with pytest.raises(Exception, match=f"no readable arrival date in shipment MDKF-2,{text}"):
        purchasing.arrivals(orders, "2001-01-01").collect()


def test_walk_holds_no_arrays_and_exchanges_items_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        items = spark.range(9).selectExpr("1 as zid", "string(id) as itemcode", "5.0D as stockqty", "1.0D as n_mean")
        orders = spark.createDataFrame([(1, "MDKF-1,2001-01-16")], "zid int, shipmentname string")
        on_order = items.selectExpr("zid", "itemcode", "'MDKF-1,2001-01-16' as shipmentname", "2.0D as quantity")
        walk = purchasing.stock_walk(items, purchasing.arrivals(orders, "2001-01-01"), on_order)
        plan = walk._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "collect_list" not in plan and plan.count("hashpartitioning(zid#") <= 5
    assert len([line for line in plan.splitlines() if "Window [" in line]) >= 3


def test_cohort_of_the_last_receipts_is_the_last_cohort_row(spark):
    rng = random.Random(5)
    sales = [(f"i{rng.randrange(5)}", rng.randrange(300), rng.randrange(1, 9), rng.randrange(1, 90)) for _ in range(300)]
    lines = [(f"i{rng.randrange(5)}", f"IP--{rng.randrange(9)}", rng.randrange(20), rng.randrange(1, 50)) for _ in range(60)]
    sold, received = frames(spark, sales, lines)
    last = lambda receipts: sorted(tuple(r) for r in purchasing.latest_cohort(purchasing.purchase_cohort(sold, receipts)).collect())
    assert last(received) == last(purchasing.latest_receipts(received))
