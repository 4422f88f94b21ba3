"""The window formulation against a row-by-row scan."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

from merchantry.plans import collections

DAY = dt.date(2000, 1, 1)
SALES = "zid int, cusid string, cusname string, date date, totalsales decimal(18,4)"
RETURNS = "zid int, cusid string, date date, treturnamt decimal(18,4)"
PAID = "zid int, cusid string, date date, value decimal(18,4)"


def frames(spark, sales, returns, paid):
    day = lambda n: DAY + dt.timedelta(days=n)
    return (
        spark.createDataFrame([(1, c, f"name {c}", day(d), Decimal(v)) for c, d, v in sales], SALES),
        spark.createDataFrame([(1, c, day(d), Decimal(v)) for c, d, v in returns], RETURNS),
        spark.createDataFrame([(1, c, day(d), Decimal(v)) for c, d, v in paid], PAID),
    )


def scan(sales, returns, paid):
    """Days of every countable collection per customer, event by event."""
    events = [(c, d, 0, v) for c, d, v in sales] + [(c, d, 1, v) for c, d, v in returns] \
        + [(c, d, 2, v) for c, d, v in paid]
    state, hits = {}, {}
    for customer, day, kind, value in sorted(events, key=lambda e: e[:3]):
        last, owed = state.get(customer, (None, 0))
        if kind == 0:
            last, owed = day, owed + value
        elif kind == 1 and last is not None:
            owed -= value
        elif kind == 2 and last is not None and owed > 0:
            hits.setdefault(customer, []).append(day - last)
        state[customer] = (last, owed)
    return {c: sum(days) / len(days) for c, days in hits.items()}


def days(df):
    return {r["cusid"]: r["average_days_to_collection"] for r in df.collect()}


def test_against_row_scan_with_one_customer_holding_a_third(spark):
    rng = random.Random(11)
    pick = lambda: "hot" if rng.random() < 0.34 else f"c{rng.randrange(12)}"
    make = lambda n, high: [(pick(), rng.randrange(60), rng.randrange(0, high)) for _ in range(n)]
    data = make(300, 40), make(260, 60), make(300, 50)
    assert days(collections.collection_days(*frames(spark, *data))) == scan(*data)


def test_ties_on_one_date(spark):
    # Sale before return before collection; a return before the first sale does not count.
    data = ([("a", 5, 10), ("b", 5, 10), ("c", 5, 10)],
            [("a", 5, 10), ("b", 1, 50), ("c", 6, 4)],
            [("a", 5, 1), ("b", 5, 1), ("c", 4, 1), ("c", 9, 1), ("c", 9, 2)])
    assert days(collections.collection_days(*frames(spark, *data))) == {"b": 0.0, "c": 4.0} == scan(*data)


def test_collections_without_sale_are_left_out(spark):
    sales, returns, paid = frames(spark, [("a", 0, 5)], [("a", 9, 1)], [("a", 3, 1), ("x", 4, 1), ("x", 8, 1)])
    assert days(collections.collection_days(sales, returns, paid)) == {"a": 3.0}
    assert [r["cusid"] for r in collections.collection_gap(sales, paid).collect()] == ["a"]


def test_gap_is_the_mean_of_consecutive_gaps(spark):
    sales, _, paid = frames(spark, [("a", 0, 5), ("b", 0, 5)], [("a", 0, 0)],
                            [("a", 1, 10), ("a", 4, 20), ("a", 4, 30), ("a", 11, 40), ("b", 3, 7)])
    rows = {r["cusid"]: r for r in collections.collection_gap(sales, paid).collect()}
    assert rows["a"]["average_days_between"] == (3 + 0 + 7) / 3 and rows["a"]["average_collection"] == 25.0
    assert rows["b"]["average_days_between"] is None


def test_segments_list_every_range(spark):
    rows = [(1, f"c{i}", float(v), 1.0, 0.0, 2.0) for i, v in enumerate([0, 2, 2.5, 100, 101])]
    df = spark.createDataFrame(
        rows, "zid int, cusid string, average_days_to_collection double, total_sale double, "
              "total_return double, total_collection double")
    got = {r["range_of_average_days"]: r["count"] for r in collections.collection_segments(df).collect()}
    assert got == {"0-2 days": 1, "3-5 days": 1, "6-10 days": 0, "11-20 days": 0, "21-30 days": 0,
                   "31-50 days": 0, "51-100 days": 1}


def test_pivot_mean_of_nonzero_months(spark):
    data = [("a", 0, 50), ("a", 40, 50)], [("z", 0, 0)], [("a", 0, 1), ("a", 10, 1), ("a", 45, 1)]
    wide = collections.collection_days_pivot(*frames(spark, *data), [(2000, 1), (2000, 2)])
    row = wide.first()
    assert (row["2000_01"], row["2000_02"], row["average"], row["total_sale"]) == (5.0, 5.0, 5.0, 100.0)
