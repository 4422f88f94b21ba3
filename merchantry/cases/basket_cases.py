"""Market baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from merchantry.cases import case
from merchantry.operators import prep
from merchantry.plans import baskets
from merchantry.sources import extracts
from merchantry.sources.driver_tables import DriverTables


def basket_sql(view: str, voucher: str) -> str:
    """All pairs counted one by one, padded with the first ten item codes, five best kept."""
    return f"""
    presence AS (
        SELECT zid, {voucher} AS voucher, itemcode, sum(quantity) >= 1 AS present FROM {view}
        WHERE {voucher} IS NOT NULL GROUP BY zid, {voucher}, itemcode),
    counts AS (SELECT zid, itemcode, CAST(sum(CASE WHEN present THEN 1 ELSE 0 END) AS BIGINT) AS n FROM presence GROUP BY zid, itemcode),
    pairs AS (
        SELECT a.zid, a.itemcode, b.itemcode AS other, count(*) AS shared FROM presence a JOIN presence b
          ON a.zid = b.zid AND a.voucher = b.voucher AND a.itemcode <> b.itemcode
        WHERE a.present AND b.present GROUP BY a.zid, a.itemcode, b.itemcode),
    heads AS (SELECT zid, itemcode FROM counts QUALIFY row_number() OVER (PARTITION BY zid ORDER BY itemcode) <= 10),
    candidates AS (
        SELECT zid, itemcode, other, max(shared) AS shared FROM (
            SELECT * FROM pairs
            UNION ALL
            SELECT c.zid, c.itemcode, l.itemcode, 0 FROM counts c JOIN heads l ON l.zid = c.zid AND l.itemcode <> c.itemcode
            WHERE c.n > 0)
        GROUP BY ALL),
    ranked AS (
        SELECT k.zid, k.itemcode, k.other, CAST(k.shared AS DOUBLE) / c.n AS support,
               row_number() OVER (PARTITION BY k.zid, k.itemcode ORDER BY k.shared DESC, k.other) AS rank
        FROM candidates k JOIN counts c ON c.zid = k.zid AND c.itemcode = k.itemcode
        QUALIFY rank <= 5)"""


_SLOTS = ", ".join(
    f"max(CASE WHEN rank = {k} THEN other END) AS item_{k}, round_even(max(CASE WHEN rank = {k} THEN support END), 4) AS support_{k}"
    for k in range(1, 6))


@case("purchase_basket", f"""
    WITH {basket_sql("f_received", "grnvoucher")},
    names AS (SELECT zid, itemcode, min(itemname) AS itemname FROM f_received GROUP BY zid, itemcode)
    SELECT c.zid, c.itemcode, c.n AS purchase_count, n.itemname, {_SLOTS}
    FROM counts c JOIN names n ON n.zid = c.zid AND n.itemcode = c.itemcode
    LEFT JOIN ranked r ON r.zid = c.zid AND r.itemcode = c.itemcode
    GROUP BY c.zid, c.itemcode, c.n, n.itemname""")
def purchase_basket(t: DriverTables) -> DataFrame:
    _, received, _ = prep.trailing_window(t.sales(False, False), t.purchases(), years=2)
    return baskets.purchase_basket(received, t.items())


_SALES_SLOTS = ", ".join(
    f"max(CASE WHEN rank = {k} THEN other END) AS item_{k}, max(CASE WHEN rank = {k} THEN o.itemname END) AS item_{k}_name, "
    f"round_even(max(CASE WHEN rank = {k} THEN support END), 4) AS support_{k}, "
    f"CAST(COALESCE(max(CASE WHEN rank = {k} THEN o.sold END), 0) AS DOUBLE) AS item_{k}_sales"
    for k in range(1, 6))


@case("sales_basket", f"""
    WITH {basket_sql("f_sales", "voucher")},
    facts AS (SELECT zid, itemcode, min(itemname) AS itemname, sum(totalsales) AS sold FROM f_sales GROUP BY zid, itemcode),
    report AS (
        SELECT f.zid, f.itemcode, f.itemname, CAST(f.sold AS DOUBLE) AS item_sales, {_SALES_SLOTS},
               CAST(f.sold + COALESCE(sum(o.sold), 0) AS DOUBLE) AS total_sales_all_items
        FROM facts f LEFT JOIN ranked r ON r.zid = f.zid AND r.itemcode = f.itemcode
             LEFT JOIN facts o ON o.zid = r.zid AND o.itemcode = r.other
        GROUP BY f.zid, f.itemcode, f.itemname, f.sold)
    SELECT p.*, CAST(s.stockqty AS DOUBLE) AS stockqty FROM report p
    LEFT JOIN f_scan_stock s ON s.zid = p.zid AND s.itemcode = p.itemcode""")
def sales_basket(t: DriverTables) -> DataFrame:
    stock = extracts.scan_stock(t.stock_table(), t.items())
    return baskets.sales_basket(t.sales(False, False), stock, t.items())


# With blocks of one item each item meets a voucher's others in a row of its own; the companions are the same.
@case("basket_item_classes", f"""
    WITH {basket_sql("f_received", "grnvoucher")}
    SELECT zid, itemcode, other, round_even(support, 8) AS support, CAST(rank AS INTEGER) AS rank FROM ranked""")
def basket_item_classes(t: DriverTables) -> DataFrame:
    from pyspark.sql import functions as F
    from merchantry.functions import numeric
    _, received, _ = prep.trailing_window(t.sales(False, False), t.purchases(), years=2)
    presence = baskets.item_presence(baskets.voucher_items(received, "grnvoucher"))
    best = baskets.top_associates(presence, block=1).join(
        baskets.item_counts(presence), ["zid", "itemcode"])
    return best.select("zid", "itemcode", "other", "rank", numeric.half_even(
        numeric.ratio(F.col("shared"), F.col("vouchers")), 8).alias("support"))


@case("basket_matrix", f"""
    WITH presence AS (
        SELECT zid, voucher, itemcode FROM f_sales WHERE voucher IS NOT NULL GROUP BY zid, voucher, itemcode HAVING sum(quantity) >= 1),
    counts AS (
        SELECT zid, itemcode, count(DISTINCT CASE WHEN q >= 1 THEN voucher END) AS n
        FROM (SELECT zid, voucher, itemcode, sum(quantity) AS q FROM f_sales WHERE voucher IS NOT NULL GROUP BY zid, voucher, itemcode)
        GROUP BY zid, itemcode),
    -- The best codes of a number of shared vouchers, not all pairs in order: five lists to an item at most.
    pairs AS (
        SELECT a.zid, a.itemcode, b.itemcode AS other, count(*) AS shared
        FROM presence a JOIN presence b ON a.zid = b.zid AND a.voucher = b.voucher AND a.itemcode <> b.itemcode GROUP BY ALL),
    best AS (
        SELECT zid, itemcode, unnest(min(struct_pack(rest := -shared, other := other), 5)) AS b FROM pairs GROUP BY zid, itemcode),
    cells AS (
        SELECT b.zid, b.itemcode, b.b.other AS other, -b.b.rest AS shared, c.n FROM best b JOIN counts c ON c.zid = b.zid AND c.itemcode = b.itemcode),
    rowsum AS (
        SELECT c.zid, c.itemcode, COALESCE(CAST(sum(k.shared) AS DOUBLE) / c.n, 0) AS s
        FROM counts c LEFT JOIN cells k ON k.zid = c.zid AND k.itemcode = c.itemcode GROUP BY c.zid, c.itemcode, c.n),
    chosen AS (
        SELECT zid, itemcode, s / count(*) OVER (PARTITION BY zid) AS mean_support FROM rowsum
        QUALIFY row_number() OVER (PARTITION BY zid ORDER BY s DESC, itemcode) <= 100)
    SELECT r.zid, r.itemcode, r.other, round_even(CAST(r.shared AS DOUBLE) / r.n, 4) AS support, round_even(b.mean_support, 8) AS mean_support
    FROM cells r JOIN chosen b ON b.zid = r.zid AND b.itemcode = r.itemcode
         JOIN chosen o ON o.zid = r.zid AND o.itemcode = r.other""")
def basket_matrix(t: DriverTables) -> DataFrame:
    return baskets.basket_matrix(t.sales(False, False))
