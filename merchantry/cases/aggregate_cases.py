"""Grouped figures and order-dependent figures on their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.cases import case
from merchantry.functions import calendar, numeric
from merchantry.operators import aggregate, distinct, ordered, prep
from merchantry.sources.driver_tables import DriverTables

YEARS = list(range(1995, 2002))


@case("sum_by", """
    SELECT zid, itemgroup, year, CAST(sum(totalsales) AS DOUBLE) AS totalsales FROM f_sales GROUP BY zid, itemgroup, year""")
def sum_by(t: DriverTables) -> DataFrame:
    return aggregate.sum_by(t.sales(True, False), ["zid", "itemgroup", "year"], "totalsales")


@case("nunique_by", """
    SELECT zid, itemgroup, count(DISTINCT cusid) AS cusid FROM f_sales GROUP BY zid, itemgroup""")
def nunique_by(t: DriverTables) -> DataFrame:
    return aggregate.nunique_by(t.sales(True, False), ["zid", "itemgroup"], "cusid")


@case("mean_by", """
    SELECT zid, cusid, CAST(sum(totalsales) AS DOUBLE) / count(totalsales) AS totalsales FROM f_sales GROUP BY zid, cusid""")
def mean_by(t: DriverTables) -> DataFrame:
    return aggregate.mean_by(t.sales(False, False), ["zid", "cusid"], "totalsales")


@case("median_by", """
    SELECT zid, itemgroup, median(CAST(totalsales AS DOUBLE)) AS totalsales FROM f_sales GROUP BY zid, itemgroup""")
def median_by(t: DriverTables) -> DataFrame:
    return aggregate.median_by(t.sales(True, False), ["zid", "itemgroup"], "totalsales")


_QUARTILES = {"q1": 0.25, "q3": 0.75, "p99": 0.99}


@case("quantiles_by", "SELECT zid, " + ", ".join(
    f"round_even(quantile_cont(CAST(totalsales AS DOUBLE), {q}), 6) AS {name}" for name, q in _QUARTILES.items())
    + " FROM f_sales GROUP BY zid")
def quantiles_by(t: DriverTables) -> DataFrame:
    exact = aggregate.quantiles_by(t.sales(False, False), ["zid"], "totalsales", _QUARTILES, accuracy=1000)
    return exact.select("zid", *[numeric.half_even(F.col(n), 6).alias(n) for n in _QUARTILES])


@case("spread_stats", """
    WITH daily AS (SELECT zid, date, CAST(sum(quantity) AS DOUBLE) AS quantity FROM f_sales GROUP BY zid, date)
    SELECT zid, round_even(var_samp(quantity), 2) AS variance, round_even(stddev_samp(quantity), 2) AS std_dev,
           min(quantity) AS minimum, max(quantity) AS maximum,
           round_even(quantile_cont(quantity, 0.75) - quantile_cont(quantity, 0.25), 2) AS iqr,
           round_even(skewness(quantity), 2) AS skew, round_even(kurtosis(quantity), 2) AS kurt
    FROM daily GROUP BY zid""")
def spread_stats(t: DriverTables) -> DataFrame:
    daily = aggregate.sum_by(t.sales(False, False), ["zid", "date"], "quantity")
    return aggregate.spread_stats(daily, ["zid"], "quantity")


@case("value_counts", "SELECT zid, itemcode, count(*) AS count FROM f_sales GROUP BY zid, itemcode")
def value_counts(t: DriverTables) -> DataFrame:
    return aggregate.value_counts(t.sales(False, False), "itemcode")


@case("rows_by_period", """
    SELECT COALESCE(s.zid, r.zid) AS zid, COALESCE(s.year, r.year) AS year, COALESCE(s.month, r.month) AS month,
           s.n AS number_of_orders, r.n AS number_of_returns
    FROM (SELECT zid, year, month, count(*) AS n FROM f_sales GROUP BY ALL) s
    FULL JOIN (SELECT zid, year, month, count(*) AS n FROM f_return GROUP BY ALL) r
      ON s.zid = r.zid AND s.year = r.year AND s.month = r.month""")
def rows_by_period(t: DriverTables) -> DataFrame:
    orders = aggregate.rows_by_period(t.sales(False, False), "number_of_orders")
    returns = aggregate.rows_by_period(t.returns(False, False), "number_of_returns")
    return orders.join(returns, ["zid", "year", "month"], "full")


@case("distinct_by_period", """
    SELECT zid, year, month, 'customers' AS figure, count(DISTINCT cusid) AS n FROM f_sales GROUP BY ALL
    UNION ALL SELECT zid, year, month, 'customer_returns', count(DISTINCT cusid) FROM f_return GROUP BY ALL
    UNION ALL SELECT zid, year, month, 'products', count(DISTINCT itemcode) FROM f_sales GROUP BY ALL
    UNION ALL SELECT zid, year, month, 'product_returns', count(DISTINCT itemcode) FROM f_return GROUP BY ALL""")
def distinct_by_period(t: DriverTables) -> DataFrame:
    sold = aggregate.distinct_by_period(t.sales(False, False), {"customers": "cusid", "products": "itemcode"})
    return sold.unionByName(aggregate.distinct_by_period(
        t.returns(False, False), {"customer_returns": "cusid", "product_returns": "itemcode"}))


_SOLD = {"orders": "voucher", "customers": "cusid", "products": "itemcode"}
_BACK = {"returns": "revoucher", "customer_returns": "cusid", "product_returns": "itemcode"}


@case("distinct_rollup", " UNION ALL ".join(
    f"SELECT zid, year, month, '{name}' AS figure, count(DISTINCT {column}) AS n FROM {facts} "
    "GROUP BY GROUPING SETS ((zid, year, month), (zid, year), (zid))"
    for facts, figures in (("f_sales", _SOLD), ("f_return", _BACK)) for name, column in figures.items()))
def distinct_rollup(t: DriverTables) -> DataFrame:
    sold = distinct.month_bitmaps(t.sales(False, False), _SOLD)
    return distinct.distinct_rollup(sold.unionByName(distinct.month_bitmaps(t.returns(False, False), _BACK)))


@case("multi_agg", """
    SELECT zid, itemgroup, count(voucher) AS count, CAST(sum(quantity) AS DOUBLE) AS total_quantity,
           CAST(sum(totalsales) AS DOUBLE) AS total_totalsales, CAST(sum(cost) AS DOUBLE) AS total_cost
    FROM f_sales GROUP BY zid, itemgroup""")
def multi_agg(t: DriverTables) -> DataFrame:
    return aggregate.multi_agg(
        t.sales(True, False), ["zid", "itemgroup"], "voucher", ["quantity", "totalsales", "cost"])


@case("signed_sum", """
    SELECT zid, xwh, CAST(sum(xqty * xsign) AS DOUBLE) AS qty FROM f_movement GROUP BY zid, xwh""")
def signed_sum(t: DriverTables) -> DataFrame:
    return prep.decimal_to_double(aggregate.signed_sum(t.movements(), ["zid", "xwh"], {"qty": "xqty"}, "xsign"))


_YEAR_SUMS = ", ".join(
    f"COALESCE(CAST(sum(CASE WHEN year = {y} THEN totalsales END) AS DOUBLE), 0) AS \"{y}\"" for y in YEARS)


@case("pivot_sum", f"SELECT zid, itemgroup, {_YEAR_SUMS} FROM f_sales GROUP BY zid, itemgroup")
def pivot_sum(t: DriverTables) -> DataFrame:
    return aggregate.pivot_sum(t.sales(True, False), ["zid", "itemgroup"], F.col("year").cast("string"),
                               [str(y) for y in t.years], "totalsales")


_YEAR_MEANS = ", ".join(
    f"COALESCE(CAST(sum(CASE WHEN year = {y} THEN quantity END) AS DOUBLE) / count(CASE WHEN year = {y} THEN quantity END), 0) "
    f"AS \"{y}\"" for y in YEARS)


@case("pivot_mean", f"SELECT zid, cusid, {_YEAR_MEANS} FROM f_sales GROUP BY zid, cusid")
def pivot_mean(t: DriverTables) -> DataFrame:
    return aggregate.pivot_mean(t.sales(False, False), ["zid", "cusid"], F.col("year").cast("string"),
                                [str(y) for y in t.years], "quantity")


@case("row_total", """
    SELECT zid, area, CAST(sum(totalsales) AS DOUBLE) AS grand_total FROM f_sales GROUP BY zid, area""")
def row_total(t: DriverTables) -> DataFrame:
    cells = t.sales(False, False).groupBy("zid", "area", "year", "month").agg(F.sum("totalsales").alias("cell"))
    return aggregate.row_total(cells, ["zid", "area"], "cell")


@case("row_mean_nonzero", """
    WITH cells AS (SELECT zid, area, year, sum(CASE WHEN month <= 6 THEN returnqty ELSE 0 END) AS cell FROM f_return GROUP BY ALL)
    SELECT zid, area, CAST(sum(cell) FILTER (cell <> 0) AS DOUBLE) / count(cell) FILTER (cell <> 0) AS average
    FROM cells GROUP BY zid, area""")
def row_mean_nonzero(t: DriverTables) -> DataFrame:
    half = F.when(F.col("month") <= 6, F.col("returnqty")).otherwise(0)
    cells = t.returns(False, False).groupBy("zid", "area", "year").agg(F.sum(half).alias("cell"))
    return aggregate.row_mean_nonzero(cells, ["zid", "area"], "cell")


@case("column_total", """
    WITH cells AS (SELECT zid, year, itemgroup AS line, CAST(sum(totalsales) AS DOUBLE) AS value FROM f_sales GROUP BY ALL)
    SELECT * FROM cells
    UNION ALL SELECT zid, year, 'Total', CAST(sum(totalsales) AS DOUBLE) FROM f_sales GROUP BY zid, year""")
def column_total(t: DriverTables) -> DataFrame:
    cells = t.sales(True, False).groupBy("zid", "year", F.col("itemgroup").alias("line")).agg(
        F.sum("totalsales").alias("value"))
    return prep.decimal_to_double(aggregate.column_total(cells, ["zid", "year"], "line", "Total", "value"))


@case("days_since_last_purchase", """
    SELECT uuid, COALESCE(date_diff('day', lag(combinedate) OVER w, combinedate), 0) AS days_since_last_purchase
    FROM f_purchase WINDOW w AS (PARTITION BY zid, itemcode ORDER BY combinedate, povoucher, uuid)""")
def days_since_last_purchase(t: DriverTables) -> DataFrame:
    return ordered.days_since_previous(
        t.purchases(), ["zid", "itemcode"], "combinedate", ["povoucher", "uuid"], "days_since_last_purchase",
    ).select("uuid", "days_since_last_purchase")


@case("seasonal_outlier_filter", """
    WITH monthly AS (SELECT zid, itemcode, year, month, sum(quantity) AS q FROM f_sales GROUP BY ALL),
         kept AS (SELECT *, avg(q) OVER (PARTITION BY zid, itemcode) AS m FROM monthly)
    SELECT zid, itemcode, CAST(sum(q) AS DOUBLE) / count(q) AS n_mean FROM kept
    WHERE CAST(q AS DOUBLE) * 5 >= m GROUP BY zid, itemcode""")
def seasonal_outlier_filter(t: DriverTables) -> DataFrame:
    return ordered.seasonal_mean(t.sales(False, False))


@case("latest_per_item", """
    SELECT zid, itemcode, povoucher, combinedate, CAST(quantity AS DOUBLE) AS quantity FROM f_purchase
    QUALIFY row_number() OVER (PARTITION BY zid, itemcode ORDER BY combinedate DESC, povoucher DESC, uuid DESC) = 1""")
def latest_per_item(t: DriverTables) -> DataFrame:
    rows = ordered.latest_per_key(t.purchases(), ["zid", "itemcode"], ["combinedate", "povoucher", "uuid"])
    return prep.decimal_to_double(rows.select("zid", "itemcode", "povoucher", "combinedate", "quantity"))


@case("first_per_item", """
    SELECT zid, itemcode, povoucher, combinedate, CAST(quantity AS DOUBLE) AS quantity FROM f_purchase
    QUALIFY row_number() OVER (PARTITION BY zid, itemcode ORDER BY combinedate, povoucher, uuid) = 1""")
def first_per_item(t: DriverTables) -> DataFrame:
    rows = ordered.first_per_key(t.purchases(), ["zid", "itemcode"], ["combinedate", "povoucher", "uuid"])
    return prep.decimal_to_double(rows.select("zid", "itemcode", "povoucher", "combinedate", "quantity"))


@case("top_k_per_group", """
    WITH sold AS (SELECT zid, itemgroup, itemcode, CAST(sum(totalsales) AS DOUBLE) AS sold FROM f_sales GROUP BY ALL)
    SELECT zid, itemgroup, itemcode, sold,
           CAST(row_number() OVER (PARTITION BY zid, itemgroup ORDER BY sold DESC, itemcode) AS INTEGER) AS rank
    FROM sold QUALIFY rank <= 5""")
def top_k_per_group(t: DriverTables) -> DataFrame:
    sold = aggregate.sum_by(t.sales(True, False), ["zid", "itemgroup", "itemcode"], "totalsales", "sold")
    return ordered.top_k_per_group(sold, ["zid", "itemgroup"], [F.desc("sold"), F.asc("itemcode")], 5)


@case("period_diff", """
    WITH monthly AS (SELECT zid, area, year, month, sum(totalsales) AS v FROM f_sales GROUP BY ALL)
    SELECT zid, area, year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS period,
           CAST(COALESCE(v - lag(v) OVER (PARTITION BY zid, area ORDER BY year, month), 0) AS DOUBLE) AS change
    FROM monthly""")
def period_diff(t: DriverTables) -> DataFrame:
    period = calendar.period_label(F.col("year"), F.col("month")).alias("period")
    monthly = t.sales(False, False).groupBy("zid", "area", period).agg(F.sum("totalsales").alias("v"))
    return prep.decimal_to_double(ordered.period_diff(monthly, ["zid", "area"], "period", "v")).drop("v")


@case("opening_value", """
    WITH monthly AS (SELECT zid, area, year, month, sum(totalsales) AS v FROM f_sales GROUP BY ALL)
    SELECT zid, area, year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS period,
           CAST(lag(v) OVER (PARTITION BY zid, area ORDER BY year, month) AS DOUBLE) AS opening
    FROM monthly""")
def opening_value(t: DriverTables) -> DataFrame:
    period = calendar.period_label(F.col("year"), F.col("month")).alias("period")
    monthly = t.sales(False, False).groupBy("zid", "area", period).agg(F.sum("totalsales").alias("v"))
    return prep.decimal_to_double(ordered.previous_value(monthly, ["zid", "area"], "period", "v", "opening")).drop("v")
