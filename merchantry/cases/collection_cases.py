"""Collection days and cash flows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from merchantry.cases import case
from merchantry.operators import ordered, prep
from merchantry.plans import collections
from merchantry.sources import extracts
from merchantry.sources.driver_tables import DriverTables


def streams(t: DriverTables) -> tuple[DataFrame, DataFrame, DataFrame]:
    return t.sales(False, False), t.returns(False, False), extracts.scan_collections(
        t.accounts(), t.gl_details(), t.gl_headers())


def all_streams(t: DriverTables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return *streams(t), extracts.scan_payments(t.accounts(), t.gl_details(), t.gl_headers())


# Event by event in (date, type) order, as a row scan would see them.
_EVENTS = """
    events AS (
        SELECT zid, cusid, date, 0 AS kind, sum(totalsales) AS amount, 1 AS n FROM f_sales GROUP BY zid, cusid, date
        UNION ALL
        SELECT zid, cusid, date, 1, sum(treturnamt), 1 FROM f_return GROUP BY zid, cusid, date
        UNION ALL
        SELECT zid, cusid, date, 2, value, 1 FROM f_collection),
    scan AS (
        SELECT *, max(CASE WHEN kind = 0 THEN date END) OVER w AS last_sale,
               min(CASE WHEN kind = 0 THEN date END) OVER w AS first_sale,
               row_number() OVER (PARTITION BY zid, cusid ORDER BY date, kind) AS seq
        FROM events WINDOW w AS (PARTITION BY zid, cusid ORDER BY date, kind ROWS UNBOUNDED PRECEDING)),
    state AS (
        SELECT *, sum(CASE WHEN kind = 0 THEN amount WHEN kind = 1 AND first_sale IS NOT NULL THEN -amount ELSE 0 END)
                  OVER (PARTITION BY zid, cusid ORDER BY seq ROWS UNBOUNDED PRECEDING) AS receivable
        FROM scan),
    hits AS (
        SELECT zid, cusid, date, date_diff('day', last_sale, date) AS days FROM state
        WHERE kind = 2 AND last_sale IS NOT NULL AND receivable > 0),
    names AS (SELECT zid, cusid, min(cusname) AS cusname FROM f_sales GROUP BY zid, cusid),
    sold AS (SELECT zid, cusid, sum(totalsales) AS v FROM f_sales GROUP BY zid, cusid),
    back AS (SELECT zid, cusid, sum(treturnamt) AS v FROM f_return GROUP BY zid, cusid),
    paid AS (SELECT zid, cusid, sum(value) AS v FROM f_collection GROUP BY zid, cusid),
    totals AS (
        SELECT n.zid, n.cusid, n.cusname, CAST(COALESCE(s.v, 0) AS DOUBLE) AS total_sale,
               CAST(COALESCE(b.v, 0) AS DOUBLE) AS total_return, CAST(COALESCE(p.v, 0) AS DOUBLE) AS total_collection
        FROM names n LEFT JOIN sold s ON s.zid = n.zid AND s.cusid = n.cusid
             LEFT JOIN back b ON b.zid = n.zid AND b.cusid = n.cusid
             LEFT JOIN paid p ON p.zid = n.zid AND p.cusid = n.cusid),
    average AS (
        SELECT t.*, h.average_days_to_collection FROM totals t
        JOIN (SELECT zid, cusid, CAST(sum(days) AS DOUBLE) / count(*) AS average_days_to_collection FROM hits GROUP BY zid, cusid) h
          ON h.zid = t.zid AND h.cusid = t.cusid)"""


@case("collection_days", f"""
    WITH {_EVENTS}
    SELECT zid, cusid, cusname, average_days_to_collection, total_sale, total_return, total_collection FROM average""")
def collection_days(t: DriverTables) -> DataFrame:
    return collections.collection_days(*streams(t), t.customers())


_MONTHS = [(y, m) for y in range(1995, 2002) for m in range(1, 13)]
_MONTHLY = f"""
    WITH {_EVENTS},
    monthly AS (
        SELECT zid, cusid, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
               CAST(sum(days) AS DOUBLE) / count(*) AS d FROM hits GROUP BY ALL),
    mean AS (SELECT zid, cusid, sum(CASE WHEN d <> 0 THEN d END) / nullif(count(CASE WHEN d <> 0 THEN d END), 0) AS average
             FROM monthly GROUP BY zid, cusid)"""


@case("collection_days_pivot", _MONTHLY + f"""
    SELECT t.zid, t.cusid, t.cusname, t.total_sale, t.total_return, t.total_collection, COALESCE(a.average, 0) AS average,
           {", ".join(f'COALESCE(sum(CASE WHEN year = {y} AND month = {m} THEN d END), 0) AS "{y}_{m:02d}"' for y, m in _MONTHS)}
    FROM monthly h JOIN totals t ON t.zid = h.zid AND t.cusid = h.cusid JOIN mean a ON a.zid = h.zid AND a.cusid = h.cusid
    GROUP BY t.zid, t.cusid, t.cusname, t.total_sale, t.total_return, t.total_collection, a.average""")
def collection_days_pivot(t: DriverTables) -> DataFrame:
    return collections.collection_days_pivot(*streams(t), [(y, m) for y in t.years for m in range(1, 13)], t.customers())


@case("collection_days_by_month", _MONTHLY + " SELECT zid, cusid, year, month, d AS collection_days FROM monthly")
def collection_days_by_month(t: DriverTables) -> DataFrame:
    return collections.collection_days_by_month(*streams(t))


@case("running_receivable", f"""
    WITH {_EVENTS}
    SELECT zid, cusid, date, last_sale, CAST(receivable AS DOUBLE) AS receivable FROM state
    QUALIFY row_number() OVER (PARTITION BY zid, cusid, date ORDER BY seq DESC) = 1""")
def running_receivable(t: DriverTables) -> DataFrame:
    timeline = ordered.receivable_timeline(*streams(t))
    return prep.decimal_to_double(timeline.select("zid", "cusid", "date", "last_sale", "receivable"))


@case("last_sale_before", f"""
    WITH {_EVENTS}
    SELECT DISTINCT zid, cusid, date, last_sale FROM state WHERE kind = 2""")
def last_sale_before(t: DriverTables) -> DataFrame:
    timeline = ordered.receivable_timeline(*streams(t))
    return timeline.filter("collections > 0").select("zid", "cusid", "date", "last_sale")


_GAPS = """
    WITH gaps AS (
        SELECT zid, cusid, value, date_diff('day', lag(date) OVER (PARTITION BY zid, cusid ORDER BY date), date) AS gap
        FROM f_collection),
    names AS (SELECT zid, cusid, min(cusname) AS cusname FROM f_sales GROUP BY zid, cusid)
    SELECT g.zid, g.cusid, n.cusname, CAST(sum(gap) AS DOUBLE) / nullif(count(gap), 0) AS average_days_between,
           CAST(sum(value) AS DOUBLE) / count(value) AS average_collection
    FROM gaps g JOIN names n ON n.zid = g.zid AND n.cusid = g.cusid GROUP BY g.zid, g.cusid, n.cusname"""


@case("collection_gap", _GAPS)
def collection_gap(t: DriverTables) -> DataFrame:
    sales, _, received = streams(t)
    return collections.collection_gap(sales, received)


@case("days_between_collections", f"SELECT zid, cusid, average_days_between FROM ({_GAPS}) WHERE average_days_between IS NOT NULL")
def days_between_collections(t: DriverTables) -> DataFrame:
    sales, _, received = streams(t)
    gaps = collections.collection_gap(sales, received).select("zid", "cusid", "average_days_between")
    return gaps.dropna(subset=["average_days_between"])


@case("collection_segments", f"""
    WITH {_EVENTS},
    seg(name, low, high) AS (VALUES ('0-2 days', 0, 2), ('3-5 days', 2, 5), ('6-10 days', 5, 10), ('11-20 days', 10, 20),
                                    ('21-30 days', 20, 30), ('31-50 days', 30, 50), ('51-100 days', 50, 100))
    SELECT c.zid, s.name AS range_of_average_days, count(a.cusid) AS count,
           COALESCE(CAST(sum(CAST(a.total_sale AS DECIMAL(18,4))) AS DOUBLE), 0) AS total_sales,
           COALESCE(CAST(sum(CAST(a.total_return AS DECIMAL(18,4))) AS DOUBLE), 0) AS total_return,
           COALESCE(CAST(sum(CAST(a.total_collection AS DECIMAL(18,4))) AS DOUBLE), 0) AS total_collection
    FROM (SELECT DISTINCT zid FROM average) c CROSS JOIN seg s
    LEFT JOIN average a ON a.zid = c.zid AND a.average_days_to_collection > s.low AND a.average_days_to_collection <= s.high
    GROUP BY c.zid, s.name""")
def collection_segments(t: DriverTables) -> DataFrame:
    return collections.collection_segments(collections.collection_days(*streams(t)))


def flow_sql(bucket: str, name: str) -> str:
    def one(view: str, value: str) -> str:
        return f'(SELECT zid, {bucket} AS "{name}", sum({value}) AS v FROM {view} GROUP BY ALL)'
    return f"""
    SELECT zid, "{name}", CAST(COALESCE(s.v, 0) AS DOUBLE) AS totalsales, CAST(COALESCE(r.v, 0) AS DOUBLE) AS treturnamt,
           CAST(COALESCE(c.v, 0) AS DOUBLE) AS value_collection, CAST(COALESCE(p.v, 0) AS DOUBLE) AS value_payment
    FROM {one("f_sales", "totalsales")} s FULL JOIN {one("f_return", "treturnamt")} r USING (zid, "{name}")
    FULL JOIN {one("f_collection", "abs(value)")} c USING (zid, "{name}") FULL JOIN {one("f_payment", "value")} p USING (zid, "{name}")"""


_MONTH = flow_sql("strftime(date_trunc('month', date), '%Y-%m-%d')", "timeframe")
for _key, _frame, _unit in [("flow_by_timeframe", "Monthly", "month"), ("flow_weekly", "Weekly", "week"),
                            ("flow_daily", "Daily", "day"), ("flow_yearly", "Yearly", "year")]:
    case(_key, flow_sql(f"strftime(date_trunc('{_unit}', date), '%Y-%m-%d')", "timeframe"))(
        lambda t, frame=_frame: collections.flow_by_timeframe(*all_streams(t), frame))


@case("flow_by_dom", flow_sql("CAST(day(date) AS INTEGER)", "DOM"))
def flow_by_dom(t: DriverTables) -> DataFrame:
    return collections.flow_by_dom(*all_streams(t))


@case("flow_by_dow", flow_sql("dayname(date)", "DOW"))
def flow_by_dow(t: DriverTables) -> DataFrame:
    return collections.flow_by_dow(*all_streams(t))


@case("flow_long", f"""
    WITH m AS ({_MONTH})
    SELECT zid, timeframe, 'totalsales' AS category, totalsales AS value FROM m
    UNION ALL SELECT zid, timeframe, 'treturnamt', treturnamt FROM m
    UNION ALL SELECT zid, timeframe, 'value_collection', value_collection FROM m
    UNION ALL SELECT zid, timeframe, 'value_payment', value_payment FROM m""")
def flow_long(t: DriverTables) -> DataFrame:
    return collections.flow_long(collections.flow_by_timeframe(*all_streams(t)), "timeframe")
