"""Ledger extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.cases import case
from merchantry.functions import codes
from merchantry.operators import prep
from merchantry.sources import extracts
from merchantry.sources.driver_tables import DriverTables


def ledger(t: DriverTables) -> tuple[DataFrame, DataFrame, DataFrame]:
    return t.accounts(), t.gl_details(), t.gl_headers()


@case("scan_collections", """
    SELECT zid, glvoucher, cusid, date, year, month, CAST(value AS DOUBLE) AS value FROM f_collection""")
def scan_collections(t: DriverTables) -> DataFrame:
    return prep.decimal_to_double(extracts.scan_collections(*ledger(t)))


@case("scan_payments", """
    SELECT zid, glvoucher, account, description, date, year, month, CAST(value AS DOUBLE) AS value
    FROM f_payment ORDER BY zid, value DESC""")
def scan_payments(t: DriverTables) -> DataFrame:
    return prep.decimal_to_double(extracts.scan_payments(*ledger(t), ordered=True))


@case("post_agg_filter", """
    SELECT zid, voucher, CAST(sum(value) AS DOUBLE) AS value FROM f_posting GROUP BY zid, voucher HAVING sum(value) > 0""")
def post_agg_filter(t: DriverTables) -> DataFrame:
    accounts, details, headers = ledger(t)
    postings = details.join(accounts.select("zid", "ac_code"), ["zid", "ac_code"]).join(
        headers.select("zid", "voucher"), ["zid", "voucher"])
    return extracts.total_value(postings, ["zid", "voucher"]).filter(F.col("value") > 0)


@case("voucher_prefix", """
    SELECT zid, sum(CASE WHEN voucher LIKE 'CPAY%' OR voucher LIKE 'BPAY%' OR voucher LIKE 'STJV%' THEN 1 ELSE 0 END)::BIGINT AS payments,
           sum(CASE WHEN voucher LIKE 'JV--%' OR voucher LIKE 'RCT-%' OR voucher LIKE 'CRCT%' OR voucher LIKE 'STJV%'
                         OR voucher LIKE 'BRCT%' THEN 1 ELSE 0 END)::BIGINT AS collections
    FROM f_header GROUP BY zid""")
def voucher_prefix(t: DriverTables) -> DataFrame:
    count = lambda prefixes: F.sum(codes.has_prefix(F.col("voucher"), prefixes).cast("int"))
    return t.gl_headers().groupBy("zid").agg(
        count(codes.PAYMENT_PREFIXES).alias("payments"), count(codes.COLLECTION_PREFIXES).alias("collections"))


@case("gl_rollup", """
    SELECT 'income' AS statement, zid, project, ac_code, year, month, CAST(sum(value) AS DOUBLE) AS value
    FROM f_posting WHERE ac_type IN ('Income', 'Expenditure') AND month >= 2 AND month <= 11
    GROUP BY zid, project, ac_code, year, month
    UNION ALL
    SELECT 'balance', zid, project, ac_code, year, month, CAST(sum(value) AS DOUBLE)
    FROM f_posting WHERE ac_type IN ('Asset', 'Liability') AND month <= 11
    GROUP BY zid, project, ac_code, year, month""")
def gl_rollup(t: DriverTables) -> DataFrame:
    return prep.decimal_to_double(extracts.gl_rollup(*ledger(t), start_month=2, end_month=11))


@case("gl_rollup_all_projects", """
    SELECT zid, '(all)' AS project, ac_code, year, month, CAST(sum(value) AS DOUBLE) AS value
    FROM f_posting WHERE ac_type IN ('Income', 'Expenditure') AND year IN (1999, 2000)
    GROUP BY zid, ac_code, year, month""")
def gl_rollup_all_projects(t: DriverTables) -> DataFrame:
    return prep.decimal_to_double(
        extracts.gl_rollup(*ledger(t), balance_sheet=False, years=[1999, 2000], by_project=False
        ).drop("statement"))


SUPPLIERS = [str(i) for i in range(0, 1500, 3)]


@case("gl_ap_split", f"""
    WITH lines AS (
        SELECT * FROM f_posting WHERE ac_lv4 = 'K18' AND month <= 10)
    SELECT zid, project, year, 'INTERNAL' AS source,
           CAST(sum(CASE WHEN ac_sub IN ({", ".join(f"'{s}'" for s in SUPPLIERS)}) THEN value END) AS DOUBLE) AS total
    FROM lines GROUP BY zid, project, year
    UNION ALL
    SELECT zid, project, year, 'EXTERNAL',
           CAST(sum(CASE WHEN ac_sub NOT IN ({", ".join(f"'{s}'" for s in SUPPLIERS)}) THEN value END) AS DOUBLE)
    FROM lines GROUP BY zid, project, year""")
def gl_ap_split(t: DriverTables) -> DataFrame:
    accounts, details, headers = ledger(t)
    payables = accounts.filter(F.col("ac_lv4") == "K18")
    return prep.decimal_to_double(
        extracts.gl_ap_split(payables, details, headers, None, SUPPLIERS, end_month=10))


@case("gl_accounts", """
    SELECT zid, ac_code, ac_name, ac_type, ac_lv1, ac_lv2, ac_lv3, ac_lv4 FROM f_account
    WHERE ac_type IS NULL OR ac_type NOT IN ('Income', 'Expenditure')""")
def gl_accounts(t: DriverTables) -> DataFrame:
    return extracts.gl_accounts(t.accounts(), extracts.INCOME_TYPES)
