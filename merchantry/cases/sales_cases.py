"""Summaries, ratios, statistics, distributions and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.cases import case
from merchantry.operators import prep
from merchantry.plans import sales_reports
from merchantry.sources.driver_tables import DriverTables


def with_calendar(t: DriverTables, items: bool = False) -> DataFrame:
    sales = t.sales(items, False)
    return prep.derive_calendar(prep.derive_margin(sales) if items else sales)


@case("sales_summary", """
    SELECT s.zid, round_even(CAST(ts AS DOUBLE), 2) AS total_sales, round_even(CAST(tr AS DOUBLE), 2) AS total_returns,
           CAST(ts - CAST(round_even(CAST(tr AS DOUBLE), 2) AS DECIMAL(28,4)) AS DOUBLE) AS net_sales,
           number_of_orders, number_of_returns, number_of_customers, number_of_customers_returned,
           number_of_products, number_of_products_returned
    FROM (SELECT zid, sum(totalsales) AS ts, count(DISTINCT voucher) AS number_of_orders,
                 count(DISTINCT cusid) AS number_of_customers, count(DISTINCT itemcode) AS number_of_products
          FROM f_sales GROUP BY zid) s
    JOIN (SELECT zid, sum(treturnamt) AS tr, count(DISTINCT revoucher) AS number_of_returns,
                 count(DISTINCT cusid) AS number_of_customers_returned,
                 count(DISTINCT itemcode) AS number_of_products_returned
          FROM f_return GROUP BY zid) r ON s.zid = r.zid""")
def sales_summary(t: DriverTables) -> DataFrame:
    return sales_reports.sales_summary(t.sales(False, False), t.returns(False, False))


@case("margin_summary", """
    SELECT s.zid, CAST(ts AS DOUBLE) AS total_sales, CAST(tr AS DOUBLE) AS total_returns,
           CAST(rc AS DOUBLE) AS total_return_cost, CAST(ts - tr AS DOUBLE) AS net_sales,
           CAST(gm + rc - tr AS DOUBLE) AS total_gross_margin
    FROM (SELECT zid, sum(totalsales) AS ts, sum(gross_margin) AS gm FROM f_sales GROUP BY zid) s
    JOIN (SELECT zid, sum(treturnamt) AS tr, sum(returncost) AS rc FROM f_return GROUP BY zid) r ON s.zid = r.zid""")
def margin_summary(t: DriverTables) -> DataFrame:
    return sales_reports.margin_summary(prep.derive_margin(t.sales(True, False)), t.returns(True, False))


_RATIO_SQL = """
    WITH s AS (SELECT zid, year, month, count(*) AS orders, count(DISTINCT cusid) AS customers, sum(totalsales) AS v
               FROM f_sales GROUP BY ALL),
         r AS (SELECT zid, year, month, count(*) AS returns, count(DISTINCT cusid) AS customer_returns, sum(treturnamt) AS w
               FROM f_return GROUP BY ALL),
         m AS (SELECT zid, year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS period, COALESCE(orders, 0) AS orders,
                      COALESCE(customers, 0) AS customers, COALESCE(returns, 0) AS returns,
                      COALESCE(customer_returns, 0) AS customer_returns,
                      CAST(CASE WHEN v IS NULL THEN 0 ELSE v - COALESCE(w, 0) END AS DOUBLE) AS net
               FROM s FULL JOIN r USING (zid, year, month)),
         d AS (SELECT *, CASE WHEN orders = 0 THEN 1 ELSE orders END AS o1, CASE WHEN customers = 0 THEN 1 ELSE customers END AS c1,
                      CASE WHEN returns = 0 THEN 1 ELSE returns END AS r1 FROM m)
    SELECT zid, period, 'Net Sales per Order' AS ratio, round_even(net / o1, 2) AS value FROM d
    UNION ALL SELECT zid, period, 'Net Sales per Customer', round_even(net / c1, 2) FROM d
    UNION ALL SELECT zid, period, 'Orders per Customer', round_even(orders / c1, 2) FROM d
    UNION ALL SELECT zid, period, 'Returns per Customer Return', round_even(customer_returns / r1, 2) FROM d
    UNION ALL SELECT zid, period, 'Orders to Returns Ratio', round_even(returns / o1, 2) FROM d
    UNION ALL SELECT zid, period, 'Customers to Customer Returns Ratio', round_even(customer_returns / c1, 2) FROM d"""


@case("sales_ratios", _RATIO_SQL)
def sales_ratios(t: DriverTables) -> DataFrame:
    return sales_reports.sales_ratios(t.sales(False, False), t.returns(False, False))


_PERIODS = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13)]


@case("pivot_first", "SELECT zid, ratio, " + ", ".join(
    f"min(CASE WHEN period = '{p}' THEN value END) AS \"{p}\"" for p in _PERIODS)
    + f" FROM ({_RATIO_SQL}) GROUP BY zid, ratio")
def pivot_first(t: DriverTables) -> DataFrame:
    ratios = sales_reports.sales_ratios(t.sales(False, False), t.returns(False, False))
    return sales_reports.ratios_wide(ratios, [f"{y}-{m:02d}" for y in t.years for m in range(1, 13)])


_GRAINS = """
    SELECT *, CAST(day(date) AS INTEGER) AS "DOM", dayname(date) AS "DOW", monthname(date) AS mname FROM f_sales"""


def _columns(timing: str) -> list[str]:
    names = {"month": "mname AS month"}
    return [names.get(c, f'"{c}"') for c in sales_reports.TIMINGS[timing]]


def stats_sql(metric: str, timing: str, perspective: str, statistic: str) -> str:
    fine = ", ".join(["zid", *_columns(timing)])
    fine_group = ", ".join(["zid", *[c.split(" AS ")[0] for c in _columns(timing)]])
    coarse = ", ".join(["zid", *[f'"{c}"' for c in sales_reports.TIMINGS[perspective]]])
    column = sales_reports.METRICS[metric]
    if metric in sales_reports.MONEY_METRICS:
        grouped = f"SELECT {fine}, sum({column}) AS value FROM ({_GRAINS}) GROUP BY {fine_group}"
    else:
        grouped = (f"SELECT {coarse}, CAST(sum(n) AS BIGINT) AS value FROM (SELECT {fine}, count(DISTINCT {column}) AS n "
                   f"FROM ({_GRAINS}) GROUP BY {fine_group}) GROUP BY {coarse}")
    if statistic == "Spread":
        return (f"SELECT zid, round_even(var_samp(value), 2) AS variance, round_even(stddev_samp(value), 2) AS std_dev, "
                f"round_even(min(value), 2) AS minimum, round_even(max(value), 2) AS maximum, "
                f"round_even(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 2) AS iqr, "
                f"round_even(skewness(value), 2) AS skew, round_even(kurtosis(value), 2) AS kurt "
                f"FROM (SELECT zid, CAST(value AS DOUBLE) AS value FROM ({grouped})) GROUP BY zid")
    if statistic == "Total":
        return f"SELECT * REPLACE (CAST(value AS DOUBLE) AS value) FROM ({grouped})"
    figure = "CAST(sum(value) AS DOUBLE) / count(value)" if statistic == "Mean" else "median(CAST(value AS DOUBLE))"
    return f"SELECT {coarse}, {figure} AS value FROM ({grouped}) GROUP BY {coarse}"


STATS = [
    ("descriptive_stats", "Sales", "Year/Month/Date", "Year/Month", "Median"),
    ("descriptive_stats_mean", "Margins", "Year/Month", "Month", "Mean"),
    ("descriptive_stats_total", "Sales", "Year/Day", "Year", "Total"),
    ("descriptive_stats_customers", "Customers", "Year/Month/Day", "Day", "Mean"),
    ("descriptive_stats_orders", "Orders", "Month/Date", "Date", "Median"),
    ("descriptive_stats_products", "Products", "Year/Date", "Year", "Total"),
]
for _key, _metric, _timing, _perspective, _statistic in STATS:
    def _stats(t: DriverTables, metric: str = _metric, timing: str = _timing, perspective: str = _perspective,
               statistic: str = _statistic) -> DataFrame:
        return sales_reports.descriptive_stats(
            with_calendar(t, metric == "Margins"), metric, timing, perspective, statistic)
    case(_key, stats_sql(_metric, _timing, _perspective, _statistic))(_stats)


@case("descriptive_stats_return", """
    WITH monthly AS (SELECT zid, year, month, sum(treturnamt) AS v FROM f_return GROUP BY ALL)
    SELECT zid, year, CAST(sum(v) AS DOUBLE) / count(v) AS value FROM monthly GROUP BY zid, year""")
def descriptive_stats_return(t: DriverTables) -> DataFrame:
    returns = prep.derive_calendar(t.returns(False, False))
    return sales_reports.descriptive_stats(returns, "Return", "Year/Month", "Year", "Mean")


@case("descriptive_spread", stats_sql("Customers", "Year/Month/Date", "Year/Month", "Spread"))
def descriptive_spread(t: DriverTables) -> DataFrame:
    return sales_reports.descriptive_spread(with_calendar(t), "Customers", "Year/Month/Date", "Year/Month")


@case("descriptive_spread_sales", stats_sql("Sales", "Year/Month", "Month", "Spread"))
def descriptive_spread_sales(t: DriverTables) -> DataFrame:
    return sales_reports.descriptive_spread(with_calendar(t), "Sales", "Year/Month", "Month")


def distribution_of(t: DriverTables, column: str, metric: str) -> DataFrame:
    return sales_reports.distribution(
        prep.derive_margin(t.sales(True, False)), t.returns(True, False), column, metric)


def _entity(view: str, entity: str, value: str) -> str:
    return f"SELECT zid, {entity} AS entity, CAST({value} AS DOUBLE) AS value FROM {view} GROUP BY zid, {entity}"


DISTRIBUTION_CASES = {
    "distribution": ("Customer", "Sales", _entity("f_sales", "cusid", "sum(totalsales)")),
    "distribution_customer_vouchers": (
        "Customer", "Voucher Count", _entity("f_sales", "cusid", "count(DISTINCT voucher)")),
    "distribution_customer_returns": ("Customer", "Returns", _entity("f_return", "cusid", "sum(treturnamt)")),
    "distribution_product_counts": ("Products", "Counts", _entity("f_sales", "itemcode", "count(*)")),
    "distribution_product_margin": ("Products", "Margin", _entity("f_sales", "itemcode", "sum(gross_margin)")),
    "distribution_voucher_sales": ("Sales", "Voucher", _entity("f_sales", "voucher", "sum(totalsales)")),
    "distribution_voucher_returns": ("Returns", "Voucher", _entity("f_return", "revoucher", "sum(treturnamt)")),
    "distribution_quantity_counts": (
        "Quantity", "Counts", _entity("f_sales", "CAST(quantity AS DOUBLE)", "count(*)")),
}
_AMOUNTS = {"Sales": "totalsales", "Returns": "treturnamt", "Margin": "gross_margin", "Cost": "cost", "Quantity": "quantity"}


def _further_distributions() -> dict[str, tuple[str, str, str]]:
    """The pairs of column and metric that are not listed above."""
    listed = {(c, m) for c, m, _ in DISTRIBUTION_CASES.values()}
    out = {}
    for column, metrics in sales_reports.DISTRIBUTIONS.items():
        for metric in metrics:
            view = "f_return" if "Returns" in (column, metric) else "f_sales"
            entity = {"Customer": "cusid", "Products": "itemcode"}.get(column)
            if entity:
                sql = _entity(view, entity, f"sum({_AMOUNTS.get(metric)})")
            elif metric == "Counts":
                sql = _entity(view, f"CAST({_AMOUNTS[column]} AS DOUBLE)", "count(*)")
            else:
                sql = _entity(view, "revoucher" if view == "f_return" else "voucher", f"sum({_AMOUNTS[column]})")
            if (column, metric) not in listed:
                out[f"distribution_{column}_{metric}".lower()] = (column, metric, sql)
    return out


for _key, (_column, _metric, _sql) in (DISTRIBUTION_CASES | _further_distributions()).items():
    case(_key, _sql)(lambda t, column=_column, metric=_metric: distribution_of(t, column, metric))


def histogram_sql(values: str, outliers: bool = False) -> str:
    inside = f"""
    WITH vals AS ({values}),
         edge AS (SELECT zid, CAST(trunc(greatest((max(value) - min(value)) / 100, 1)) AS BIGINT) AS width,
                         CAST(trunc(max(value)) AS BIGINT) AS top FROM vals GROUP BY zid),
         bins AS (SELECT zid, width, (top + width - 1) // width AS n FROM edge),
         grid AS (SELECT zid, width, unnest(range(n)) AS bin FROM bins WHERE n > 0)
    SELECT g.zid, CAST(g.bin * g.width AS DOUBLE) AS bin_start, CAST((g.bin + 1) * g.width AS DOUBLE) AS bin_end,
           count(v.value) AS count
    FROM grid g LEFT JOIN vals v ON v.zid = g.zid AND v.value >= g.bin * g.width AND v.value < (g.bin + 1) * g.width
    GROUP BY g.zid, g.bin, g.width"""
    if not outliers:
        return inside
    return inside + """
    UNION ALL
    SELECT v.zid, NULL, 0.0, count(*) FROM vals v WHERE value < 0 GROUP BY v.zid
    UNION ALL
    SELECT v.zid, CAST(n * width AS DOUBLE), NULL, count(*) FROM vals v JOIN bins b ON v.zid = b.zid
    WHERE value >= n * width GROUP BY v.zid, n, width"""


@case("histogram_bins", histogram_sql(_entity("f_sales", "cusid", "sum(totalsales)")))
def histogram_bins(t: DriverTables) -> DataFrame:
    return sales_reports.histogram_bins(distribution_of(t, "Customer", "Sales"))


@case("histogram_bins_outliers", histogram_sql(_entity("f_sales", "itemcode", "sum(gross_margin)"), True))
def histogram_bins_outliers(t: DriverTables) -> DataFrame:
    return sales_reports.histogram_bins(distribution_of(t, "Products", "Margin"), include_outliers=True)


@case("histogram_small_range", histogram_sql(_entity("f_sales", "voucher", "count(*)")))
def histogram_small_range(t: DriverTables) -> DataFrame:
    lines = t.sales(False, False).groupBy("zid", "voucher").agg(F.count("*").cast("double").alias("value"))
    return sales_reports.histogram_bins(lines)
