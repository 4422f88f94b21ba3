"""Scans, ERP extracts, catalog and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.cases import case
from merchantry.operators import prep
from merchantry.session import new_folder
from merchantry.sources import catalog, erp, extracts, layout, schemas, sinks
from merchantry.sources.driver_tables import FIRST_COMPANY, LABELS, DriverTables


def star_sql(fact: str, document: str, *figures: str) -> str:
    """A fact view with the names its dimensions give it; rows without one of them drop out."""
    amounts = ", ".join(f"{f}::DOUBLE AS {f}" for f in figures)
    return f"""
    WITH fact AS (SELECT * EXCLUDE (spname, cusname, area, itemname, itemgroup) FROM {fact})
    SELECT zid, {document}, date, year, month, spid, spname, cusid, cusname, cuscity AS area, itemcode, itemname,
           itemgroup2 AS itemgroup, {amounts}
    FROM fact NATURAL JOIN (SELECT zid, cusid, cusname, cuscity FROM f_customer)
         NATURAL JOIN (SELECT zid, spid, spname FROM f_employee)
         NATURAL JOIN (SELECT zid, itemcode, itemname, itemgroup2 FROM f_item)"""


@case("scan_sales", star_sql("f_sales", "voucher", "quantity", "totalsales", "cost"))
def scan_sales(t: DriverTables) -> DataFrame:
    return prep.decimal_to_double(
        extracts.scan_sales(t.sales_table(), t.employees(), t.customers(), t.items(), steps=True))


@case("scan_returns", star_sql("f_return", "revoucher", "returnqty", "treturnamt", "returncost"))
def scan_returns(t: DriverTables) -> DataFrame:
    return prep.decimal_to_double(
        extracts.scan_returns(t.return_table(), t.employees(), t.customers(), t.items()))


ASIA = "(SELECT r_regionkey + 100000 FROM region WHERE r_name = 'ASIA')"
FOLDER_YEARS = [1997, 1998]


def in_folders(t: DriverTables, facts: DataFrame, spread: list[str]) -> DataFrame:
    """The company of one region in two years, of facts written by company and year."""
    path = new_folder(t.spark, "facts")
    facts = facts.withColumn("year", F.year("date"))
    layout.write_facts(facts, path, spread)
    asia = t.raw("region").filter(F.col("r_name") == "ASIA").select((F.col("r_regionkey") + FIRST_COMPANY).alias("zid"))
    return layout.read_facts(t.spark, path, facts.schema, asia, FOLDER_YEARS).drop("year")


@case("scan_sales_folders", f"""
    SELECT * FROM ({star_sql("f_sales", "voucher", "quantity", "totalsales", "cost")})
    WHERE zid IN {ASIA} AND year IN (1997, 1998)""")
def scan_sales_folders(t: DriverTables) -> DataFrame:
    sales = in_folders(t, t.sales_table(), ["voucher"])
    return prep.decimal_to_double(extracts.scan_sales(sales, t.employees(), t.customers(), t.items()))


@case("scan_returns_folders", f"""
    SELECT * FROM ({star_sql("f_return", "revoucher", "returnqty", "treturnamt", "returncost")})
    WHERE zid IN {ASIA} AND year IN (1997, 1998)""")
def scan_returns_folders(t: DriverTables) -> DataFrame:
    returns = in_folders(t, t.return_table(), ["revoucher"])
    return prep.decimal_to_double(extracts.scan_returns(returns, t.employees(), t.customers(), t.items()))


#: The code an item is ordered under: its pack code if it has a real one.
ORDER_CODE = "coalesce(nullif(nullif(packcode, ''), 'NO'), itemcode)"
#: The code it is stocked under: as above, but packs that begin with KH keep the item's own code.
STOCK_CODE = f"if(starts_with(coalesce(packcode, ''), 'KH'), itemcode, {ORDER_CODE})"


@case("scan_purchase", f"""
    WITH coded AS (
        SELECT pu.* EXCLUDE (itemcode, itemname, quantity, cost), it.itemname, it.ordered_as AS itemcode,
               pu.quantity::DOUBLE AS quantity, pu.cost::DOUBLE AS cost
        FROM (SELECT zid, itemcode, itemname, {ORDER_CODE} AS ordered_as FROM f_item) it
        JOIN f_purchase pu USING (zid, itemcode)),
    owners AS (SELECT zid, zid AS shown_for FROM f_company UNION ALL SELECT 100004, 100000)
    SELECT owners.shown_for AS zid, coded.* EXCLUDE (zid) FROM coded JOIN owners USING (zid)""")
def scan_purchase(t: DriverTables) -> DataFrame:
    return prep.decimal_to_double(
        extracts.scan_purchase(t.purchases().drop("itemname"), t.items(), partners={100000: [100004]}))


@case("scan_stock", """
    WITH owners AS (SELECT zid, zid AS shown_for FROM f_company UNION ALL SELECT 100004, 100000)
    SELECT shown_for AS zid, itemcode, itemname, itemgroup, stockqty::DOUBLE AS stockqty, stockvalue::DOUBLE AS stockvalue
    FROM f_scan_stock JOIN owners USING (zid)""")
def scan_stock(t: DriverTables) -> DataFrame:
    return prep.decimal_to_double(
        extracts.scan_stock(t.stock_table(), t.items(), partners={100000: [100004]}))


@case("scan_stock_value", """
    SELECT zid, year, month, warehouse, CAST(stockvalue AS DOUBLE) AS stockvalue FROM f_stock_value""")
def scan_stock_value(t: DriverTables) -> DataFrame:
    return prep.decimal_to_double(extracts.scan_stock_value(t.stock_value_table()))


@case("packcode_remap", f"SELECT zid, itemcode, {ORDER_CODE} AS ordered_as, {STOCK_CODE} AS stocked_as FROM f_item")
def packcode_remap(t: DriverTables) -> DataFrame:
    from merchantry.functions import codes
    pack, item = F.col("packcode"), F.col("itemcode")
    return t.items().select(
        "zid", "itemcode", codes.packcode_or_item(pack, item).alias("ordered_as"),
        codes.packcode_or_item(pack, item, codes.STOCK_KEEPS_OWN_CODE_PREFIX).alias("stocked_as"))


@case("parametrised_source", """
    SELECT zid, year, month, warehouse, CAST(stockvalue AS DOUBLE) AS stockvalue FROM f_stock_value
    WHERE zid IN (100001, 100003)""")
def parametrised_source(t: DriverTables) -> DataFrame:
    return prep.decimal_to_double(catalog.Catalog(t.table).extract("stock_value", [100001, 100003]))


@case("label_dimension", """
    SELECT a.ac_lv4, l.statement, l.line, count(*) AS accounts
    FROM f_account a JOIN f_label l ON a.ac_lv4 = l.ac_lv4 GROUP BY a.ac_lv4, l.statement, l.line""")
def label_dimension(t: DriverTables) -> DataFrame:
    labels = catalog.label_dimension(t.spark, LABELS)
    return t.accounts().join(labels, "ac_lv4").groupBy("ac_lv4", "statement", "line").agg(
        F.count("*").alias("accounts"))


@case("business_projects", "SELECT DISTINCT zid, project FROM f_detail")
def business_projects(t: DriverTables) -> DataFrame:
    listed = t.gl_details().select("zid", "project").distinct().groupBy("zid").agg(
        F.sort_array(F.collect_list("project")).alias("projects"))
    business = F.struct(F.concat(F.lit("Company "), F.col("zid")).alias("zorg"), F.col("projects"))
    config = listed.select(F.to_json(F.struct(
        F.create_map(F.col("zid").cast("string"), business).alias("businesses"))).alias("config"))
    return catalog.business_projects(config)


@case("report_sink", """
    SELECT zid, year, CAST(sum(totalsales) AS DOUBLE) AS sales_total FROM f_sales GROUP BY zid, year""")
def report_sink(t: DriverTables) -> DataFrame:
    report = t.sales(False, False).groupBy("zid", "year").agg(
        F.sum("totalsales").cast("double").alias(sinks.flatten_name(["sales", "total"])))
    path = sinks.write_report(report, new_folder(t.spark, "report"))
    return sinks.read_report(t.spark, path, report.schema)


@case("declared_schema", """
    SELECT uuid, zid, voucher AS ordernumber, date, spid AS sp_id, cusid, itemcode,
           CAST(quantity AS DOUBLE) AS quantity, CAST(totalsales AS DOUBLE) AS totalsales,
           CAST(cost AS DOUBLE) AS cost, CAST(NULL AS TIMESTAMP) AS itime, CAST(NULL AS TIMESTAMP) AS utime
    FROM f_sales""")
def declared_schema(t: DriverTables) -> DataFrame:
    path = new_folder(t.spark, "declared")
    schemas.conform(t.sales_table(), "sales").write.parquet(path)
    stored = schemas.read_declared(t.spark, path, schemas.declared_schema("sales"))
    return prep.decimal_to_double(stored)


# ---- ERP extracts -------------------------------------------------------------------------------

_START = "TIMESTAMP '1995-01-01'"


def _master_sql(view: str, columns: str, key: str, created: str = _START) -> str:
    return (f"SELECT {created} AS itime, CASE WHEN {key} % 5 = 0 THEN {created} + to_days(CAST({key} % 30 AS INTEGER)) "
            f"END AS utime, {columns} FROM {view}")


MASTERS = {
    "etl_glmst": ("glmst", _master_sql(
        "f_account", "zid, ac_code, ac_name, ac_type, ac_lv1, ac_lv2, ac_lv3, ac_lv4, usage",
        "CAST(substr(ac_code, 2) AS BIGINT)")),
    "etl_gldetail": ("gldetail", _master_sql(
        "f_detail", "zid, ac_code, ac_sub, project, voucher, CAST(value AS DOUBLE) AS value",
        "CAST(ac_sub AS BIGINT)")),
    "etl_glheader": ("glheader", _master_sql(
        "f_header", "zid, voucher, date, year, month", "month", "CAST(date AS TIMESTAMP)")),
    "etl_customer": ("cacus", _master_sql(
        "f_customer", "zid, cusid, cusname, cusadd, cuscity, cusstate, cusmobile, cusmobile2",
        "CAST(cusid AS BIGINT)")),
    "etl_item": ("caitem", _master_sql(
        "f_item", "zid, itemcode, itemname, itemgroup, itemgroup2, packcode", "CAST(itemcode AS BIGINT)")),
    "etl_employee": ("prmst", _master_sql(
        "f_employee", "zid, spid, spname, department, designation", "CAST(spid AS BIGINT)")),
}
for _key, (_table, _sql) in MASTERS.items():
    case(_key, _sql)(lambda t, name=_table: prep.decimal_to_double(erp.renamed(t.erp_master(name), name)))


@case("etl_purchase", """
    WITH wanted AS (SELECT zid, xpornum, xdate AS ordered_on, xcounterno, xstatuspor FROM f_poord
                    WHERE list_contains(['1-Open', '5-Received'], xstatuspor)),
         receipt AS (SELECT zid, xpornum, xgrnnum, xdate AS received_on FROM f_pogrn)
    SELECT zid, ztime AS itime, zutime AS utime, xpornum AS povoucher, xgrnnum AS grnvoucher, xitem AS itemcode,
           xcounterno AS shipmentname, xstatuspor AS status, ifnull(received_on, ordered_on) AS combinedate,
           xqtyord::DOUBLE AS quantity, xrate::DOUBLE AS cost
    FROM f_poodt JOIN wanted USING (zid, xpornum) LEFT JOIN receipt USING (zid, xpornum)""")
def etl_purchase(t: DriverTables) -> DataFrame:
    return prep.decimal_to_double(erp.etl_purchase(t.poord(), t.poodt(), t.pogrn()))


def document_sql(heads: str, lines: str, number: str, names: str, moved: str, whole: str) -> str:
    """Document x item figures: lines and movements are summed before they meet, and what meets several rows of
    the other side counts once for each of them."""
    return f"""
    WITH head AS (SELECT *, count(*) AS heads FROM {heads} GROUP BY ALL),
    line AS (SELECT zid, {number}, xitem, ztime, zutime, sum(xqty)::DOUBLE AS qty, sum(xlineamt)::DOUBLE AS amount, count(*) AS n
             FROM {lines} GROUP BY ALL),
    move AS (SELECT zid, xdocnum AS {number}, xitem, ztime AS moved_at, zutime AS corrected_at, sum(xval)::DOUBLE AS val,
                    count(*) AS moves FROM f_movement GROUP BY ALL)
    SELECT {names.format(times="heads * ifnull(moves, 1)")}
    FROM head {whole} JOIN line ON (line.zid, line.{number}) = (head.zid, head.{number})
    {moved} JOIN move ON (move.zid, move.{number}, move.xitem) = (line.zid, line.{number}, line.xitem)"""


@case("etl_sales", document_sql("f_opdor", "f_opddt", "xdornum", """line.zid, head.xdornum AS ordernumber,
           line.xitem AS itemcode, xcus AS cusid, xsp AS sp_id, xdate AS date, line.ztime AS itime, line.zutime AS utime,
           qty * {times} AS quantity, amount * {times} AS totalsales, val * n * heads AS cost""", "LEFT", "LEFT"))
def etl_sales(t: DriverTables) -> DataFrame:
    rows = erp.etl_sales(t.opdor(), t.opddt(), t.movements()).drop(*erp.TRAILING_TIMES)
    return prep.decimal_to_double(rows)


@case("etl_return", document_sql("f_opcrn", "f_opcdt", "xcrnnum", """line.zid, head.xcrnnum AS revoucher,
           line.xitem AS itemcode, xcus AS cusid, xemp AS sp_id, xdate AS date, line.ztime AS itime, line.zutime AS utime,
           qty * {times} AS returnqty, amount * {times} AS treturnamt, val * n * heads AS returncost""", "", ""))
def etl_return(t: DriverTables) -> DataFrame:
    rows = erp.etl_return(t.opcrn(), t.opcdt(), t.movements()).drop(*erp.TRAILING_TIMES)
    return prep.decimal_to_double(rows)


@case("etl_stock", """
    SELECT zid, itemcode, CAST(stockqty AS DOUBLE) AS stockqty, CAST(stockvalue AS DOUBLE) AS stockvalue FROM f_stock""")
def etl_stock(t: DriverTables) -> DataFrame:
    return prep.decimal_to_double(erp.etl_stock(t.movements()))


@case("etl_stock_value", """
    SELECT zid, year, month, warehouse, CAST(stockvalue AS DOUBLE) AS stockvalue FROM f_stock_value""")
def etl_stock_value(t: DriverTables) -> DataFrame:
    return prep.decimal_to_double(erp.etl_stock_value(t.movements()))
