"""Purchase cohorts and the requisition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.cases import case
from merchantry.operators import prep
from merchantry.plans import purchasing
from merchantry.session import cut_lineage
from merchantry.sources import extracts
from merchantry.sources.driver_tables import AS_OF, DriverTables

GROUPS = ["ECONOMY", "SMALL", "PROMO"]
WEEKS = range(1, 13)

_WEEK_SUMS = ", ".join(
    f"COALESCE(sum(CASE WHEN week = {k} THEN s.quantity END), 0) AS w{k}" for k in WEEKS)
COHORT = f"""
    matched AS (
        SELECT p.uuid, s.quantity, s.totalsales, date_diff('day', p.combinedate, s.date) // 7 + 1 AS week
        FROM f_received p JOIN f_recent_sales s ON s.zid = p.zid AND s.itemcode = p.itemcode
             AND s.date >= p.combinedate AND s.date <= p.combinedate + 83),
    weekly AS (
        SELECT p.uuid, {_WEEK_SUMS}, COALESCE(sum(s.totalsales), 0) AS amount, COALESCE(sum(s.quantity), 0) AS sold
        FROM f_received p LEFT JOIN matched s ON s.uuid = p.uuid GROUP BY p.uuid),
    cohort AS (
        SELECT p.zid, p.itemcode, p.itemname, p.povoucher, p.shipmentname, p.combinedate, p.uuid,
               round_even(CAST(p.quantity AS DOUBLE), 0) AS quantity, round_even(CAST(p.cost AS DOUBLE), 0) AS cost,
               CASE WHEN sold = 0 THEN 0.0 ELSE round_even(CAST(amount AS DOUBLE) / CAST(sold AS DOUBLE), 0) END AS average_sales_price,
               {", ".join(f"round_even(CAST(w{k} AS DOUBLE), 0) AS week_{k}" for k in WEEKS)},
               COALESCE(date_diff('day', lag(p.combinedate) OVER (PARTITION BY p.zid, p.itemcode
                        ORDER BY p.combinedate, p.povoucher, p.uuid), p.combinedate), 0) AS days_since_last_purchase,
               COALESCE(round_even(CAST(p.quantity AS DOUBLE) * 30.5 / nullif(CAST(w1 + w2 + w3 + w4 AS DOUBLE), 0), 0), 0.0)
                   AS days_of_product_left
        FROM f_received p JOIN weekly w ON w.uuid = p.uuid)"""


def windowed(t: DriverTables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recent sales, received lines, open orders."""
    purchases = t.purchases()
    sales, received, cutoff = prep.trailing_window(t.sales(False, False), purchases, years=2)
    return sales, received, prep.open_orders(purchases, cutoff)


def planning(t: DriverTables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Cohort of the last receipts, open orders, stock and item sales, with the shared inputs computed once."""
    sales, received, orders = windowed(t)
    daily = cut_lineage(purchasing.daily_item_sales(sales))
    cohort = purchasing.purchase_cohort(daily, purchasing.latest_receipts(received))
    stock = extracts.scan_stock(t.stock_table(), t.items())
    return cohort, cut_lineage(purchasing.open_shipments(orders)), stock, daily


@case("purchase_cohort", f"WITH {COHORT} SELECT * FROM cohort")
def purchase_cohort(t: DriverTables) -> DataFrame:
    sales, received, _ = windowed(t)
    return purchasing.purchase_cohort(sales, received)


# The same sums by a join on the raw lines: every receipt line of an item with its sales.
@case("purchase_cohort_unrounded", """
    WITH m AS (
        SELECT p.uuid, s.quantity, s.totalsales FROM f_purchase p JOIN f_sales s
          ON s.zid = p.zid AND s.itemcode = p.itemcode AND s.date >= p.combinedate AND s.date < p.combinedate + 84
        WHERE p.grnvoucher IS NOT NULL)
    SELECT p.zid, p.uuid, CAST(COALESCE(sum(m.quantity), 0) AS DOUBLE) AS sold,
           COALESCE(CAST(sum(m.totalsales) AS DOUBLE) / nullif(CAST(sum(m.quantity) AS DOUBLE), 0), 0.0) AS average_sales_price
    FROM f_purchase p LEFT JOIN m ON m.uuid = p.uuid WHERE p.grnvoucher IS NOT NULL GROUP BY p.zid, p.uuid""")
def purchase_cohort_unrounded(t: DriverTables) -> DataFrame:
    received = t.purchases().filter(F.col("grnvoucher").isNotNull())
    cohort = purchasing.purchase_cohort(t.sales(False, False), received, digits=None)
    sold = sum((F.col(c) for c in purchasing.WEEK_COLUMNS), F.lit(0.0))
    return cohort.select("zid", "uuid", sold.alias("sold"), "average_sales_price")


_REQUISITION = f"""
    WITH {COHORT},
    latest AS (
        SELECT * FROM cohort
        QUALIFY row_number() OVER (PARTITION BY zid, itemcode ORDER BY combinedate DESC, povoucher DESC, uuid DESC) = 1),
    on_hand AS (
        SELECT zid, itemcode, CAST(sum(stockqty) AS DOUBLE) AS stockqty, min(itemname) AS itemname
        FROM f_scan_stock WHERE itemgroup IN ('ECONOMY', 'SMALL', 'PROMO') GROUP BY zid, itemcode),
    named AS (
        SELECT zid, itemcode, itemname FROM f_scan_stock WHERE itemgroup IN ('ECONOMY', 'SMALL', 'PROMO')
        QUALIFY row_number() OVER (PARTITION BY zid, itemcode ORDER BY itemname, itemgroup) = 1),
    monthly AS (SELECT zid, itemcode, year, month, sum(quantity) AS q FROM f_recent_sales GROUP BY ALL),
    usual AS (SELECT *, avg(q) OVER (PARTITION BY zid, itemcode) AS m FROM monthly),
    means AS (SELECT zid, itemcode, CAST(sum(q) AS DOUBLE) / count(q) AS n_mean FROM usual
              WHERE CAST(q AS DOUBLE) * 5 >= m GROUP BY zid, itemcode),
    ships AS (
        SELECT zid, list({{'a': arrival, 's': shipmentname}} ORDER BY arrival, shipmentname) AS ships
        FROM (SELECT DISTINCT zid, shipmentname, split_part(shipmentname, ',', 2) AS arrival FROM f_open
              WHERE contains(shipmentname, 'MDKF')) GROUP BY zid),
    ordered AS (
        SELECT zid, itemcode, map_from_entries(list((shipmentname, q))) AS on_order
        FROM (SELECT zid, itemcode, shipmentname, CAST(sum(quantity) AS DOUBLE) AS q FROM f_open
              WHERE contains(shipmentname, 'MDKF') GROUP BY ALL) GROUP BY zid, itemcode),
    base AS (
        SELECT h.zid, h.itemcode, h.stockqty, n.itemname, l.combinedate, l.cost, l.average_sales_price, l.quantity,
               l.week_1, l.week_2, l.week_3, l.week_4, COALESCE(m.n_mean, 0.0) AS n_mean, s.ships, o.on_order
        FROM on_hand h JOIN named n ON n.zid = h.zid AND n.itemcode = h.itemcode
             LEFT JOIN latest l ON l.zid = h.zid AND l.itemcode = h.itemcode
             LEFT JOIN means m ON m.zid = h.zid AND m.itemcode = h.itemcode
             LEFT JOIN ships s ON s.zid = h.zid
             LEFT JOIN ordered o ON o.zid = h.zid AND o.itemcode = h.itemcode),
    steps AS (
        SELECT zid, itemcode, unnest(range(1, len(ships) + 1)) AS i, ships, on_order, stockqty, n_mean FROM base),
    qty AS (
        SELECT zid, itemcode, i, ships[i].s AS shipmentname, ships[i].a AS arrival, stockqty, n_mean,
               COALESCE(on_order[ships[i].s], 0.0) AS quantity,
               date_diff('day', CASE WHEN i = 1 THEN DATE '{AS_OF}' ELSE CAST(ships[i - 1].a AS DATE) END,
                         CAST(ships[i].a AS DATE)) / 30.0 AS months
        FROM steps),
    s1 AS (SELECT *, greatest(stockqty - months * n_mean, 0.0) AS before1 FROM qty WHERE i = 1),
    s2 AS (SELECT q.*, greatest(p.before1 + p.quantity - q.months * q.n_mean, 0.0) AS before2
           FROM qty q JOIN s1 p USING (zid, itemcode) WHERE q.i = 2),
    s3 AS (SELECT q.*, greatest(p.before2 + p.quantity - q.months * q.n_mean, 0.0) AS before3
           FROM qty q JOIN s2 p USING (zid, itemcode) WHERE q.i = 3),
    s4 AS (SELECT q.*, greatest(p.before3 + p.quantity - q.months * q.n_mean, 0.0) AS before4
           FROM qty q JOIN s3 p USING (zid, itemcode) WHERE q.i = 4),
    walk AS (
        SELECT zid, itemcode, i, shipmentname, arrival, quantity, before1 AS stock_before FROM s1
        UNION ALL SELECT zid, itemcode, i, shipmentname, arrival, quantity, before2 FROM s2
        UNION ALL SELECT zid, itemcode, i, shipmentname, arrival, quantity, before3 FROM s3
        UNION ALL SELECT zid, itemcode, i, shipmentname, arrival, quantity, before4 FROM s4)"""


# The data has four shipments per company, so the SQL walks the fold step by step.
@case("stock_projection", _REQUISITION + """
    SELECT zid, itemcode, shipmentname, arrival, round_even(stock_before, 0) AS stock_before,
           round_even(quantity, 0) AS quantity FROM walk""")
def stock_projection(t: DriverTables) -> DataFrame:
    return purchasing.stock_projection(*planning(t), AS_OF, GROUPS)


_FINAL = """,
    final AS (
        SELECT zid, itemcode, max(CASE WHEN i = 4 THEN stock_before + quantity END) AS stock,
               sum(CASE WHEN i >= 2 THEN quantity END) > 0 AS has_shipments, count(*) AS shipments
        FROM walk GROUP BY zid, itemcode)"""


@case("purchase_requisition", _REQUISITION + _FINAL + """
    SELECT b.zid, b.itemcode, b.itemname, b.combinedate, f.has_shipments, round_even(b.stockqty, 0) AS stockqty,
           COALESCE(cost, 0.0) AS cost, COALESCE(average_sales_price, 0.0) AS average_sales_price,
           COALESCE(quantity, 0.0) AS quantity, COALESCE(week_1, 0.0) AS week_1, COALESCE(week_2, 0.0) AS week_2,
           COALESCE(week_3, 0.0) AS week_3, COALESCE(week_4, 0.0) AS week_4, round_even(b.n_mean, 0) AS n_mean,
           round_even(greatest(f.stock - b.n_mean, 0.0), 0) AS final_stock, CAST(f.shipments AS INTEGER) AS shipments
    FROM base b JOIN final f ON f.zid = b.zid AND f.itemcode = b.itemcode""")
def purchase_requisition(t: DriverTables) -> DataFrame:
    return purchasing.purchase_requisition(*planning(t), AS_OF, GROUPS, ordered=True).drop("steps")


_SHIPMENTS = [f"MDKF-{k},2002-0{k + 1}-15" for k in range(4)]
_WIDE = ", ".join(
    f"COALESCE(max(CASE WHEN shipmentname = '{name}' THEN round_even({column}, 0) END), 0) AS \"{prefix}{name}\""
    for name in _SHIPMENTS for column, prefix in (("stock_before", "stock_before_"), ("quantity", "")))


@case("requisition_wide", _REQUISITION + _FINAL + f""",
    wide AS (SELECT zid, itemcode, {_WIDE} FROM walk GROUP BY zid, itemcode)
    SELECT w.*, b.itemname, b.combinedate, round_even(b.stockqty, 0) AS stockqty, COALESCE(b.cost, 0.0) AS cost,
           COALESCE(b.average_sales_price, 0.0) AS average_sales_price, COALESCE(b.quantity, 0.0) AS quantity,
           COALESCE(week_1, 0.0) AS week_1, COALESCE(week_2, 0.0) AS week_2, COALESCE(week_3, 0.0) AS week_3,
           COALESCE(week_4, 0.0) AS week_4, round_even(b.n_mean, 0) AS n_mean,
           round_even(greatest(f.stock - b.n_mean, 0.0), 0) AS final_stock
    FROM base b JOIN final f ON f.zid = b.zid AND f.itemcode = b.itemcode JOIN wide w ON w.zid = b.zid AND w.itemcode = b.itemcode""")
def requisition_wide(t: DriverTables) -> DataFrame:
    cohort, orders, stock, sales = planning(t)
    # A column for each shipment under way: their names are read from the orders.
    shipments = [r["shipmentname"] for r in orders.select("shipmentname").distinct().orderBy("shipmentname").collect()]
    return purchasing.requisition_wide(purchasing.purchase_requisition(cohort, orders, stock, sales, AS_OF, GROUPS), shipments)
