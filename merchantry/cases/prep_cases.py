"""Filters, coercions and derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.cases import case
from merchantry.functions import calendar, numeric
from merchantry.operators import prep
from merchantry.sources import extracts
from merchantry.sources.driver_tables import DriverTables

AREAS = ["NATION_1", "NATION_6", "NATION_12", "NATION_18"]


@case("filter_in", """
    SELECT zid, voucher, itemcode, area FROM f_sales WHERE area IN ('NATION_1', 'NATION_6', 'NATION_12', 'NATION_18')""")
def filter_in(t: DriverTables) -> DataFrame:
    chosen = prep.filter_in(t.sales(False, False), "area", AREAS)
    return prep.filter_in(chosen, "zid", []).select("zid", "voucher", "itemcode", "area")


@case("cascading_filters", """
    SELECT 'sale' AS kind, zid, voucher, itemcode, CAST(totalsales AS DOUBLE) AS amount FROM f_sales
    WHERE year IN (1999, 2000) AND month IN (1, 2, 3) AND area IN ('NATION_1', 'NATION_6', 'NATION_12', 'NATION_18')
      AND itemgroup IN ('ECONOMY', 'SMALL')
    UNION ALL
    SELECT 'return', zid, revoucher, itemcode, CAST(treturnamt AS DOUBLE) FROM f_return
    WHERE year IN (1999, 2000) AND month IN (1, 2, 3) AND area IN ('NATION_1', 'NATION_6', 'NATION_12', 'NATION_18')
      AND itemgroup IN ('ECONOMY', 'SMALL')""")
def cascading_filters(t: DriverTables) -> DataFrame:
    sales, returns = prep.cascading_filters(t.sales(True, False), t.returns(True, False), {
        "year": [1999, 2000], "month": [1, 2, 3], "area": AREAS, "itemgroup": ["ECONOMY", "SMALL"]})
    sold = sales.select(F.lit("sale").alias("kind"), "zid", "voucher", "itemcode",
                        F.col("totalsales").cast("double").alias("amount"))
    back = returns.select(F.lit("return").alias("kind"), "zid", F.col("revoucher").alias("voucher"), "itemcode",
                          F.col("treturnamt").cast("double").alias("amount"))
    return sold.unionByName(back)


@case("default_years", """
    SELECT s.zid, s.year, s.voucher, s.itemcode FROM f_sales s
    JOIN (SELECT zid, max(year) AS last_year FROM f_sales GROUP BY zid) m ON s.zid = m.zid
    WHERE s.year IN (m.last_year - 1, m.last_year)""")
def default_years(t: DriverTables) -> DataFrame:
    return prep.latest_years(t.sales(False, False)).select("zid", "year", "voucher", "itemcode")


@case("filter_options", """
    SELECT DISTINCT zid, 'area' AS kind, area AS option FROM f_sales
    UNION ALL SELECT DISTINCT zid, 'customer', cusid || ' - ' || cusname FROM f_sales""")
def filter_options(t: DriverTables) -> DataFrame:
    sales = t.sales(False, False)
    single = prep.filter_options(sales, "area").select("zid", F.lit("area").alias("kind"), F.col("area").alias("option"))
    pairs = prep.pair_options(sales, "cusid", "cusname").withColumn("kind", F.lit("customer"))
    return single.unionByName(pairs)


@case("collection_filters", """
    WITH buyers AS (SELECT DISTINCT zid, cusid FROM f_sales WHERE spid IN ('3', '14', '15', '92'))
    SELECT 'sales' AS frame, zid, count(*) AS n, CAST(sum(totalsales) AS DOUBLE) AS amount FROM f_sales
    WHERE year IN (1998, 1999) AND month IN (4, 5, 6, 7) AND spid IN ('3', '14', '15', '92') GROUP BY zid
    UNION ALL
    SELECT 'returns', zid, count(*), CAST(sum(treturnamt) AS DOUBLE) FROM f_return
    WHERE year IN (1998, 1999) AND month IN (4, 5, 6, 7) AND spid IN ('3', '14', '15', '92') GROUP BY zid
    UNION ALL
    SELECT 'collections', c.zid, count(*), CAST(sum(value) AS DOUBLE) FROM f_collection c
    JOIN buyers b ON c.zid = b.zid AND c.cusid = b.cusid
    WHERE year IN (1998, 1999) AND month IN (4, 5, 6, 7) GROUP BY c.zid
    UNION ALL
    SELECT 'payments', zid, count(*), CAST(sum(value) AS DOUBLE) FROM f_payment
    WHERE year IN (1998, 1999) AND month IN (4, 5, 6, 7) GROUP BY zid""")
def collection_filters(t: DriverTables) -> DataFrame:
    accounts, details, headers = t.accounts(), t.gl_details(), t.gl_headers()
    frames = prep.collection_filters(
        t.sales(False, False), t.returns(False, False),
        extracts.scan_collections(accounts, details, headers), extracts.scan_payments(accounts, details, headers),
        years=[1998, 1999], months=[4, 5, 6, 7], salespeople=["3", "14", "15", "92"])
    values = ["totalsales", "treturnamt", "value", "value"]
    parts = [
        df.groupBy("zid").agg(F.count("*").alias("n"), F.sum(value).cast("double").alias("amount"))
        .withColumn("frame", F.lit(name))
        for df, value, name in zip(frames, values, ["sales", "returns", "collections", "payments"])
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@case("trailing_window_filter", """
    SELECT 'sale' AS kind, zid, voucher, itemcode, date FROM f_recent_sales
    UNION ALL SELECT 'receipt', zid, grnvoucher, itemcode, combinedate FROM f_received""")
def trailing_window_filter(t: DriverTables) -> DataFrame:
    sales, received, _ = prep.trailing_window(t.sales(False, False), t.purchases(), years=2)
    return sales.select(F.lit("sale").alias("kind"), "zid", "voucher", "itemcode", "date").unionByName(
        received.select(F.lit("receipt").alias("kind"), "zid", F.col("grnvoucher").alias("voucher"), "itemcode",
                        F.col("combinedate").alias("date")))


@case("open_orders", """
    SELECT zid, povoucher, itemcode, shipmentname, combinedate, CAST(quantity AS DOUBLE) AS quantity FROM f_open""")
def open_orders(t: DriverTables) -> DataFrame:
    purchases = t.purchases()
    _, _, cutoff = prep.trailing_window(t.sales(False, False), purchases, years=2)
    return prep.decimal_to_double(prep.open_orders(purchases, cutoff).select(
        "zid", "povoucher", "itemcode", "shipmentname", "combinedate", "quantity"))


@case("item_group_filter", """
    SELECT zid, itemcode, itemname, itemgroup, CAST(stockqty AS DOUBLE) AS stockqty FROM f_scan_stock
    WHERE itemgroup IN ('ECONOMY', 'SMALL', 'PROMO')""")
def item_group_filter(t: DriverTables) -> DataFrame:
    stock = extracts.scan_stock(t.stock_table(), t.items()).select(
        "zid", "itemcode", "itemname", "itemgroup", "stockqty")
    return prep.decimal_to_double(prep.item_group_filter(stock, ["ECONOMY", "SMALL", "PROMO"]))


@case("coerce_numeric", """
    SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' WHEN o_orderkey % 3 = 1 THEN CAST(o_custkey AS VARCHAR)
           ELSE '' END AS DOUBLE) AS amount FROM orders""")
def coerce_numeric(t: DriverTables) -> DataFrame:
    key = F.col("o_orderkey")
    dirty = F.when(key % 3 == 0, F.lit("n/a")).when(key % 3 == 1, F.col("o_custkey").cast("string")).otherwise("")
    return prep.coerce_numeric(t.raw("orders").select(key, dirty.alias("amount")), ["o_orderkey"])


@case("coerce_dates", """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderkey % 4 <> 0""")
def coerce_dates(t: DriverTables) -> DataFrame:
    key = F.col("o_orderkey")
    dirty = F.when(key % 4 == 0, F.when(key % 8 == 0, F.lit("not a date"))).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return prep.coerce_dates(t.raw("orders").select(key, dirty.alias("date")))


@case("derive_margin", """
    SELECT uuid, CAST(totalsales - cost AS DOUBLE) AS gross_margin,
           CASE WHEN quantity <> 0 THEN CAST(totalsales AS DOUBLE) / CAST(quantity AS DOUBLE) END AS rate FROM f_sales""")
def derive_margin(t: DriverTables) -> DataFrame:
    return prep.decimal_to_double(
        prep.derive_margin(t.sales(True, False)).select("uuid", "gross_margin", "rate"))


@case("derive_calendar", """
    SELECT zid, voucher, CAST(day(date) AS INTEGER) AS "DOM", dayname(date) AS "DOW", monthname(date) AS month,
           count(*) AS lines
    FROM f_sales GROUP BY zid, voucher, date""")
def derive_calendar(t: DriverTables) -> DataFrame:
    dated = prep.derive_calendar(t.sales(False, False))
    return dated.groupBy("zid", "voucher", "DOM", "DOW", "month").agg(F.count("*").alias("lines"))


@case("sanitize_numbers", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE WHEN l_linenumber = 1 THEN 0.0 ELSE round_even(l_extendedprice / (l_linenumber - 1), 0) END AS figure,
           CASE WHEN l_discount = 0 THEN 0.0 ELSE round_even(l_quantity / 2, 0) END AS half
    FROM lineitem""")
def sanitize_numbers(t: DriverTables) -> DataFrame:
    step = F.col("l_linenumber") - 1
    infinite = F.when(step == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("l_extendedprice"), step))
    half = F.when(F.col("l_discount") != 0, F.col("l_quantity") / 2)
    raw = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                   infinite.alias("figure"), half.alias("half"))
    return prep.sanitize_numbers(raw, ["figure", "half"])


@case("decimal_to_double", """
    SELECT uuid, CAST(quantity AS DOUBLE) AS quantity, CAST(totalsales AS DOUBLE) AS totalsales,
           CAST(cost AS DOUBLE) AS cost FROM f_sales""")
def decimal_to_double(t: DriverTables) -> DataFrame:
    return prep.decimal_to_double(t.sales(True, False).select("uuid", "quantity", "totalsales", "cost"))


@case("month_number", """
    SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS from_long, CAST(month(o_orderdate) AS INTEGER) AS from_short,
           CAST(month(o_orderdate) AS INTEGER) AS from_number FROM orders""")
def month_number(t: DriverTables) -> DataFrame:
    date = F.col("o_orderdate")
    return t.raw("orders").select(
        "o_orderkey", calendar.month_number(F.date_format(date, "MMMM")).alias("from_long"),
        calendar.month_number(F.lower(F.date_format(date, "MMM"))).alias("from_short"),
        calendar.month_number(F.month(date)).alias("from_number"))


@case("relative_week", """
    SELECT uuid, CASE WHEN d >= 0 AND d < 84 THEN CAST(floor(d / 7.0) + 1 AS INTEGER) END AS week
    FROM (SELECT uuid, date_diff('day', order_date, CAST(l_shipdate AS DATE)) - 30 AS d FROM f_lines)""")
def relative_week(t: DriverTables) -> DataFrame:
    from merchantry.sources.driver_tables import line_uuid
    start = F.date_add("order_date", 30)
    return t.lines(False, False).select(
        line_uuid().alias("uuid"), calendar.relative_week(start, F.col("l_shipdate").cast("date")).alias("week"))


@case("zero_guard", """
    SELECT zid, CAST(sum(totalsales) AS DOUBLE) / CASE WHEN count(*) FILTER (itemgroup = 'none') = 0 THEN 1
           ELSE count(*) FILTER (itemgroup = 'none') END AS per_unit FROM f_sales GROUP BY zid""")
def zero_guard(t: DriverTables) -> DataFrame:
    counted = F.count(F.when(F.col("itemgroup") == "none", 1))
    return t.sales(True, False).groupBy("zid").agg(
        (F.sum("totalsales").cast("double") / numeric.zero_as_one(counted)).alias("per_unit"))
