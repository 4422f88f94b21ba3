"""The analytical and ERP tables as SQL views over the given tables.

The views join every dimension in full; the DataFrame side leaves out dimensions a report
does not read, which is part of what the comparison covers.
"""

from __future__ import annotations

import re

from merchantry.plans.statements import BALANCE_LINES, INCOME_LINES

_PREFIXES = "['JV--', 'RCT-', 'CRCT', 'STJV', 'BRCT', 'CPAY', 'BPAY', 'INOP']"


def _labels() -> str:
    rows = [("income", i, line) for i, line in enumerate(INCOME_LINES)]
    rows += [("balance", i, line) for i, line in enumerate(BALANCE_LINES, start=len(INCOME_LINES))]
    return ", ".join(f"('{s}', 'K{i:02d}', '{line}')" for s, i, line in rows)


def _change_times(created: str, key: str) -> str:
    return (f"{created} AS ztime, CASE WHEN {key} % 5 = 0 "
            f"THEN {created} + to_days(CAST({key} % 30 AS INTEGER)) END AS zutime")


VIEWS = {
    "f_orders": """
        SELECT CAST(100000 + n_regionkey AS INTEGER) AS zid, o_orderkey, CAST(o_orderdate AS DATE) AS order_date,
               o_orderstatus, o_orderdate, CAST(o_custkey AS VARCHAR) AS cusid, c_name AS cusname, n_name AS area
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "f_lines": """
        SELECT f_orders.*, lineitem.*, part.*, s_name,
               concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER),
                         CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y%m%d')) AS uuid,
               CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS amount,
               CAST(CAST(l_quantity AS DECIMAL(18,2)) * CAST(p_retailprice AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS cost_amount
        FROM lineitem JOIN f_orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
             JOIN supplier ON l_suppkey = s_suppkey""",
    "f_sales": """
        SELECT uuid, zid, CAST(l_suppkey AS VARCHAR) AS spid, s_name AS spname, cusid, cusname, area,
               CAST(l_partkey AS VARCHAR) AS itemcode, p_name AS itemname, p_type AS itemgroup,
               CAST(l_orderkey AS VARCHAR) AS voucher, order_date AS date,
               CAST(year(order_date) AS INTEGER) AS year, CAST(month(order_date) AS INTEGER) AS month,
               CAST(l_quantity AS DECIMAL(18,4)) AS quantity, amount AS totalsales, cost_amount AS cost,
               amount - cost_amount AS gross_margin
        FROM f_lines""",
    "f_return": """
        SELECT uuid, zid, CAST(l_suppkey AS VARCHAR) AS spid, s_name AS spname, cusid, cusname, area,
               CAST(l_partkey AS VARCHAR) AS itemcode, p_name AS itemname, p_type AS itemgroup,
               'RE' || l_orderkey AS revoucher, CAST(l_shipdate AS DATE) AS date,
               CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
               CAST(l_quantity AS DECIMAL(18,4)) AS returnqty, amount AS treturnamt, cost_amount AS returncost
        FROM f_lines WHERE l_returnflag = 'R'""",
    "f_purchase": """
        SELECT uuid, zid, 'IP--' || l_orderkey AS povoucher,
               CASE WHEN l_linestatus = 'F' THEN 'GRN-' || l_orderkey END AS grnvoucher,
               CAST(l_shipdate AS DATE) AS combinedate, CAST(l_partkey AS VARCHAR) AS itemcode, p_name AS itemname,
               'MDKF-' || (l_suppkey % 4) || ',2002-0' || (l_suppkey % 4 + 1) || '-15' AS shipmentname,
               CAST(l_quantity AS DECIMAL(18,4)) AS quantity, CAST(p_retailprice AS DECIMAL(18,4)) AS cost,
               CASE WHEN l_linestatus = 'F' THEN '5-Received' ELSE '1-Open' END AS status
        FROM f_lines WHERE l_linenumber = 7""",
    "f_company": "SELECT CAST(100000 + r_regionkey AS INTEGER) AS zid FROM region",
    "f_item": """
        SELECT zid, CAST(p_partkey AS VARCHAR) AS itemcode, p_name AS itemname, p_type AS itemgroup,
               p_brand AS itemgroup2,
               CASE p_size % 10 WHEN 0 THEN 'PK' || (p_partkey % 50) WHEN 1 THEN 'NO' WHEN 2 THEN ''
                                WHEN 3 THEN 'KH' || (p_partkey % 50) END AS packcode
        FROM part, f_company""",
    "f_employee": """
        SELECT zid, CAST(s_suppkey AS VARCHAR) AS spid, s_name AS spname, 'D' || s_nationkey AS department,
               CASE WHEN s_acctbal > 0 THEN 'Senior' ELSE 'Junior' END AS designation
        FROM supplier, f_company""",
    "f_customer": """
        SELECT CAST(100000 + n_regionkey AS INTEGER) AS zid, CAST(c_custkey AS VARCHAR) AS cusid, c_name AS cusname,
               'add ' || c_nationkey AS cusadd, n_name AS cuscity, c_mktsegment AS cusstate,
               CAST(c_custkey * 7 AS VARCHAR) AS cusmobile, CAST(c_custkey * 11 AS VARCHAR) AS cusmobile2
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "f_account": """
        SELECT zid, 'A' || p_partkey AS ac_code, p_name AS ac_name,
               CASE WHEN p_partkey % 25 = 0 THEN 'Income' WHEN p_partkey % 25 < 11 THEN 'Expenditure'
                    WHEN p_partkey % 25 < 18 THEN 'Asset' WHEN p_partkey % 25 < 24 THEN 'Liability'
                    WHEN p_partkey % 50 = 24 THEN 'Asset' END AS ac_type,
               'T' || (p_partkey % 25 // 12) AS ac_lv1, 'G' || (p_partkey % 25 // 6) AS ac_lv2,
               'H' || (p_partkey % 25 // 3) AS ac_lv3,
               'K' || lpad(CAST(p_partkey % 25 AS VARCHAR), 2, '0') AS ac_lv4,
               CASE WHEN p_partkey % 25 = 12 THEN 'AR' ELSE 'GL' END AS usage
        FROM part, f_company""",
    "f_label": f"SELECT * FROM (VALUES {_labels()}) AS v(statement, ac_lv4, line)",
    "f_header": f"""
        SELECT zid, {_PREFIXES}[o_orderkey % 8 + 1] || o_orderkey AS voucher, order_date AS date,
               CAST(year(order_date) AS INTEGER) AS year,
               CAST(CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE month(order_date) END AS INTEGER) AS month
        FROM f_orders""",
    "f_detail": f"""
        SELECT uuid, zid, 'A' || l_partkey AS ac_code, cusid AS ac_sub, 'P' || (l_orderkey % 2) AS project,
               {_PREFIXES}[l_orderkey % 8 + 1] || l_orderkey AS voucher,
               CAST(CASE WHEN (l_orderkey + l_linenumber) % 2 = 0 THEN CAST(l_extendedprice AS DECIMAL(18,4))
                         ELSE -CAST(l_extendedprice AS DECIMAL(18,4)) END AS DECIMAL(18,4)) AS value
        FROM f_lines""",
    "f_posting": """
        SELECT d.*, a.ac_name, a.ac_type, a.ac_lv1, a.ac_lv2, a.ac_lv3, a.ac_lv4, a.usage, h.date, h.year, h.month
        FROM f_account a JOIN f_detail d ON a.ac_code = d.ac_code AND a.zid = d.zid
             JOIN f_header h ON d.voucher = h.voucher AND d.zid = h.zid""",
    # Vouchers by the four letters they begin with, added up as far as the key says.
    "f_collection": """
        SELECT zid, voucher AS glvoucher, ac_sub AS cusid, date, year, month, abs(sum(value)) AS value
        FROM (SELECT *, left(voucher, 4) AS kind FROM f_posting WHERE usage = 'AR')
        SEMI JOIN (VALUES ('JV--'), ('RCT-'), ('CRCT'), ('STJV'), ('BRCT')) AS taken(kind) USING (kind)
        GROUP BY ALL""",
    "f_payment": """
        WITH paid AS (
            SELECT zid, voucher AS glvoucher, ac_sub AS account, ac_name AS description, date, year, month, sum(value) AS value
            FROM (SELECT *, left(voucher, 4) AS kind FROM f_posting)
            SEMI JOIN (VALUES ('CPAY'), ('BPAY'), ('STJV')) AS taken(kind) USING (kind) GROUP BY ALL)
        SELECT * FROM paid WHERE value > 0""",
    "f_movement": f"""
        SELECT zid, xdocnum, CAST(l_partkey AS VARCHAR) AS xitem, CAST(l_quantity AS DECIMAL(18,4)) AS xqty,
               cost_amount AS xval, CAST(xsign AS INTEGER) AS xsign, CAST(year(l_shipdate) AS INTEGER) AS xyear,
               CAST(month(l_shipdate) AS INTEGER) AS xper, 'W' || (l_suppkey % 4) AS xwh,
               l_shipdate AS ztime, CAST(NULL AS TIMESTAMP) AS zutime
        FROM (SELECT *, CAST(l_orderkey AS VARCHAR) AS xdocnum, CASE WHEN l_linenumber = 7 THEN 1 ELSE -1 END AS xsign
              FROM f_lines
              UNION ALL
              SELECT *, 'RE' || l_orderkey, 1 FROM f_lines WHERE l_returnflag = 'R')""",
    "f_stock": """
        SELECT zid, xitem AS itemcode, sum(xqty * xsign) AS stockqty, sum(xval * xsign) AS stockvalue
        FROM f_movement GROUP BY zid, xitem""",
    "f_stock_value": """
        SELECT zid, xyear AS year, xper AS month, xwh AS warehouse, sum(xval * xsign) AS stockvalue
        FROM f_movement GROUP BY zid, xyear, xper, xwh""",
    "f_scan_stock": """
        SELECT zid, if(starts_with(coalesce(packcode, ''), 'KH'), itemcode, coalesce(nullif(nullif(packcode, ''), 'NO'), itemcode)) AS itemcode,
               itemname, itemgroup, stockqty, stockvalue
        FROM f_item JOIN f_stock USING (zid, itemcode)""",
    "f_opdor": f"""
        SELECT zid, CAST(o_orderkey AS VARCHAR) AS xdornum, order_date AS xdate,
               CAST(o_orderkey % 10 AS VARCHAR) AS xsp, cusid AS xcus, {_change_times('o_orderdate', 'o_orderkey')}
        FROM f_orders""",
    "f_opddt": f"""
        SELECT zid, CAST(l_orderkey AS VARCHAR) AS xdornum, CAST(l_partkey AS VARCHAR) AS xitem,
               CAST(l_quantity AS DECIMAL(18,4)) AS xqty, amount AS xlineamt, {_change_times('l_shipdate', 'l_partkey')}
        FROM f_lines""",
    "f_opcrn": f"""
        SELECT zid, 'RE' || o_orderkey AS xcrnnum, order_date AS xdate, CAST(o_orderkey % 10 AS VARCHAR) AS xemp,
               cusid AS xcus, {_change_times('o_orderdate', 'o_orderkey')}
        FROM f_orders""",
    "f_opcdt": f"""
        SELECT zid, 'RE' || l_orderkey AS xcrnnum, CAST(l_partkey AS VARCHAR) AS xitem,
               CAST(l_quantity AS DECIMAL(18,4)) AS xqty, amount AS xlineamt, {_change_times('l_shipdate', 'l_partkey')}
        FROM f_lines WHERE l_returnflag = 'R'""",
    "f_poord": """
        SELECT zid, 'IP--' || o_orderkey AS xpornum, order_date AS xdate, 'S' || (o_orderkey % 4) AS xcounterno,
               CASE o_orderstatus WHEN 'F' THEN '5-Received' WHEN 'O' THEN '1-Open' ELSE '3-Cancelled' END AS xstatuspor
        FROM f_orders""",
    "f_poodt": f"""
        SELECT zid, 'IP--' || l_orderkey AS xpornum, CAST(l_partkey AS VARCHAR) AS xitem,
               CAST(l_quantity AS DECIMAL(18,4)) AS xqtyord, CAST(p_retailprice AS DECIMAL(18,4)) AS xrate,
               {_change_times('l_shipdate', 'l_partkey')}
        FROM f_lines WHERE l_linenumber = 7""",
    "f_pogrn": """
        SELECT zid, 'IP--' || o_orderkey AS xpornum, 'GRN-' || o_orderkey AS xgrnnum, order_date + 10 AS xdate
        FROM f_orders WHERE o_orderstatus = 'F'""",
    "f_source": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate AS itime,
               CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) END AS utime
        FROM orders""",
    # As the first day of 2000 left it: what was updated later is still in its older version.
    "f_target": """
        SELECT o_orderkey, o_custkey, if(utime > TIMESTAMP '2000-01-01', 'X', o_orderstatus) AS o_orderstatus, itime,
               if(utime > TIMESTAMP '2000-01-01', NULL, utime) AS utime
        FROM f_source WHERE itime <= TIMESTAMP '2000-01-01' AND o_orderkey % 97 <> 0""",
    "f_received": """
        SELECT p.* FROM f_purchase p
        JOIN (SELECT zid, max(date) - 730 AS cutoff FROM f_sales GROUP BY zid) c ON p.zid = c.zid
        WHERE grnvoucher IS NOT NULL AND combinedate > cutoff""",
    "f_recent_sales": """
        SELECT s.* FROM f_sales s
        JOIN (SELECT zid, max(date) - 730 AS cutoff FROM f_sales GROUP BY zid) c ON s.zid = c.zid
        WHERE date > cutoff""",
    "f_open": """
        SELECT p.* FROM f_purchase p
        JOIN (SELECT zid, max(date) - 730 AS cutoff FROM f_sales GROUP BY zid) c ON p.zid = c.zid
        WHERE grnvoucher IS NULL AND combinedate > cutoff""",
}

_NAME = re.compile(r"\bf_\w+")


def with_views(sql: str) -> str:
    """The query with the views it needs, in declaration order, as common table expressions."""
    needed: set[str] = set()
    waiting = [n for n in _NAME.findall(sql) if n in VIEWS]
    while waiting:
        name = waiting.pop()
        if name not in needed:
            needed.add(name)
            waiting += [n for n in _NAME.findall(VIEWS[name]) if n in VIEWS]
    views = [f"{name} AS ({VIEWS[name].strip()})" for name in VIEWS if name in needed]
    body = sql.strip()
    if not views:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(views) + ",\n" + body[5:]
    return "WITH " + ",\n".join(views) + "\n" + body
