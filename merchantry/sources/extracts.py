"""The analytical extracts: facts with their names, and ledger roll-ups.

Dimensions carry no broadcast hint. Read straight from files their size is known, and the
planner broadcasts them below its threshold and shuffles beyond it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.functions import codes, numeric
from merchantry.operators.prep import filter_in
from merchantry.session import cut_lineage

# Account types on each statement.
BALANCE_TYPES = ["Asset", "Liability"]
INCOME_TYPES = ["Income", "Expenditure"]
ALL_PROJECTS = "(all)"
STATEMENTS = ["income", "balance"]
ACCOUNT_COLUMNS = ["zid", "ac_code", "ac_name", "ac_type", "ac_lv1", "ac_lv2", "ac_lv3", "ac_lv4"]


def _star(fact: DataFrame, employees: DataFrame, customers: DataFrame, items: DataFrame, steps: bool = False) -> DataFrame:
    """With ``steps`` the fact is stored before and between its joins: what a join exchanged is gone before the next one. For
    facts of which all rows are asked for, as later filters don't pass a stored step."""
    keep = (lambda rows: cut_lineage(rows, "star")) if steps else (lambda rows: rows)
    people = employees.select("zid", F.col("spid").alias("sp_id"), "spname")
    buyers = customers.select("zid", "cusid", "cusname", F.col("cuscity").alias("area"))
    goods = items.select("zid", "itemcode", "itemname", F.col("itemgroup2").alias("itemgroup"))
    return (
        keep(keep(fact).join(people, ["zid", "sp_id"]).join(buyers, ["zid", "cusid"])).join(goods, ["zid", "itemcode"])
        .withColumnRenamed("sp_id", "spid")
        .withColumns({"year": F.year("date"), "month": F.month("date")})
    )


def scan_sales(sales: DataFrame, employees: DataFrame, customers: DataFrame, items: DataFrame,
               zids: Sequence[int] | None = None, steps: bool = False) -> DataFrame:
    sales = sales.select("zid", "ordernumber", "date", "sp_id", "cusid", "itemcode", "quantity", "totalsales", "cost")
    return _star(filter_in(sales, "zid", zids), employees, customers, items, steps).select(
        "zid", F.col("ordernumber").alias("voucher"), "date", "year", "month", "spid", "spname",
        "cusid", "cusname", "area", "itemcode", "itemname", "itemgroup", "quantity", "totalsales", "cost",
    )


def scan_returns(returns: DataFrame, employees: DataFrame, customers: DataFrame, items: DataFrame,
                 zids: Sequence[int] | None = None) -> DataFrame:
    return _star(filter_in(returns, "zid", zids), employees, customers, items).select(
        "zid", "revoucher", "date", "year", "month", "spid", "spname", "cusid", "cusname", "area",
        "itemcode", "itemname", "itemgroup", "returnqty", "treturnamt", "returncost",
    )


def _owners(zid: Column, partners: Mapping[int, Sequence[int]] | None) -> Column:
    """The company itself and every company that also plans with its rows.

    ``partners`` maps a company to the further companies whose rows it looks at.
    """
    owners = [F.when(zid.isin(list(others)), F.lit(owner)) for owner, others in (partners or {}).items()]
    return F.array_compact(F.array(zid, *owners))


def scan_purchase(purchases: DataFrame, items: DataFrame, zids: Sequence[int] | None = None,
                  partners: Mapping[int, Sequence[int]] | None = None) -> DataFrame:
    """Purchase lines under the item's pack code; imports only, open or received."""
    wanted = filter_in(purchases, "zid", zids).filter(
        codes.has_prefix(F.col("povoucher"), [codes.PURCHASE_PREFIX])
        & F.col("status").isin(codes.PURCHASE_STATES)
    )
    goods = items.select("zid", "itemcode", "itemname", "packcode")
    return wanted.join(goods, ["zid", "itemcode"]).select(
        F.explode(_owners(F.col("zid"), partners)).alias("zid"), "combinedate", "povoucher", "grnvoucher",
        codes.packcode_or_item(F.col("packcode"), F.col("itemcode")).alias("itemcode"),
        "itemname", "shipmentname", "quantity", "cost", "status", "uuid",
    )


def scan_stock(stock: DataFrame, items: DataFrame, zids: Sequence[int] | None = None,
               partners: Mapping[int, Sequence[int]] | None = None) -> DataFrame:
    goods = items.select("zid", "itemcode", "itemname", "itemgroup", "packcode")
    code = codes.packcode_or_item(F.col("packcode"), F.col("itemcode"), codes.STOCK_KEEPS_OWN_CODE_PREFIX)
    return filter_in(stock, "zid", zids).join(goods, ["zid", "itemcode"]).select(
        F.explode(_owners(F.col("zid"), partners)).alias("zid"), code.alias("itemcode"),
        "itemname", "itemgroup", "stockqty", "stockvalue",
    )


def scan_stock_value(stock_value: DataFrame, zids: Sequence[int] | None = None) -> DataFrame:
    return filter_in(stock_value, "zid", zids).select("zid", "year", "month", "warehouse", "stockvalue")


def _postings(accounts: DataFrame, details: DataFrame, headers: DataFrame) -> DataFrame:
    """Journal lines with their account and voucher date, each matched within its company."""
    return details.join(accounts, ["zid", "ac_code"]).join(headers, ["zid", "voucher"])


def scan_collections(accounts: DataFrame, details: DataFrame, headers: DataFrame,
                     zids: Sequence[int] | None = None) -> DataFrame:
    """Receipts on receivable accounts per voucher, customer and date, as positive amounts."""
    receivable = accounts.filter(F.col("usage") == "AR").select("zid", "ac_code")
    lines = filter_in(details, "zid", zids).filter(
        codes.has_prefix(F.col("voucher"), codes.COLLECTION_PREFIXES))
    keys = ["zid", "voucher", "ac_sub", "date", "year", "month"]
    return _postings(receivable, lines, headers).groupBy(*keys).agg(
        F.abs(F.sum("value")).alias("value")
    ).select("zid", F.col("voucher").alias("glvoucher"), F.col("ac_sub").alias("cusid"),
             "date", "year", "month", "value")


def scan_payments(accounts: DataFrame, details: DataFrame, headers: DataFrame,
                  zids: Sequence[int] | None = None, ordered: bool = False) -> DataFrame:
    """Positive payment totals per voucher, sub-account, account name and date."""
    named = accounts.select("zid", "ac_code", "ac_name")
    lines = filter_in(details, "zid", zids).filter(
        codes.has_prefix(F.col("voucher"), codes.PAYMENT_PREFIXES))
    keys = ["zid", "voucher", "ac_sub", "ac_name", "date", "year", "month"]
    paid = _postings(named, lines, headers).groupBy(*keys).agg(F.sum("value").alias("value")) \
        .filter(F.col("value") > 0)
    result = paid.select(
        "zid", F.col("voucher").alias("glvoucher"), F.col("ac_sub").alias("account"),
        F.col("ac_name").alias("description"), "date", "year", "month", "value")
    return result.orderBy("zid", F.desc("value")) if ordered else result


def gl_rollup(
    accounts: DataFrame,
    details: DataFrame,
    headers: DataFrame,
    balance_sheet: bool | None = None,
    start_month: int | None = None,
    end_month: int | None = None,
    years: Sequence[int] | None = None,
    zids: Sequence[int] | None = None,
    projects: Sequence[str] | None = None,
    by_project: bool = True,
) -> DataFrame:
    """Ledger totals per company, project, account, year and month, all companies at once.

    The balance sheet takes every month up to the end, opening balances (month 0) included;
    the income statement takes the months between start and end. ``balance_sheet=None`` rolls
    up both in one pass over the ledger, told apart by ``statement``. ``by_project=False`` puts
    all projects of a company together.
    """
    on_balance = F.col("ac_type").isin(BALANCE_TYPES)
    wanted = {None: BALANCE_TYPES + INCOME_TYPES, True: BALANCE_TYPES, False: INCOME_TYPES}[balance_sheet]
    chosen = accounts.filter(F.col("ac_type").isin(wanted)).select(
        "zid", "ac_code", F.when(on_balance, STATEMENTS[1]).otherwise(STATEMENTS[0]).alias("statement"))
    dated = filter_in(headers, "year", years).select("zid", "voucher", "year", "month")
    if end_month:
        dated = dated.filter(F.col("month") <= end_month)
    lines = filter_in(filter_in(details, "zid", zids), "project", projects)
    if not by_project:
        lines = lines.withColumn("project", F.lit(ALL_PROJECTS))
    postings = _postings(chosen, lines, dated)
    if start_month and not balance_sheet:
        postings = postings.filter((F.col("statement") == STATEMENTS[1]) | (F.col("month") >= start_month))
    return postings.groupBy("statement", "zid", "project", "ac_code", "year", "month").agg(
        F.sum("value").alias("value"))


def gl_ap_split(accounts: DataFrame, details: DataFrame, headers: DataFrame, ac_codes: Sequence[str] | None,
                suppliers: Sequence[str], end_month: int, years: Sequence[int] | None = None) -> DataFrame:
    """Payables towards the listed suppliers (INTERNAL) and all others (EXTERNAL).

    A line without supplier belongs to neither; both classes are listed for every group.
    """
    chosen = filter_in(accounts, "ac_code", ac_codes).select("zid", "ac_code")
    dated = filter_in(headers, "year", years).filter(F.col("month") <= end_month) \
        .select("zid", "voucher", "year")
    inside = F.col("ac_sub").isin(list(suppliers))
    totals = _postings(chosen, details, dated).groupBy("zid", "project", "year").agg(
        F.sum(F.when(inside, F.col("value"))).alias("INTERNAL"),
        F.sum(F.when(~inside, F.col("value"))).alias("EXTERNAL"),
    )
    return totals.unpivot(["zid", "project", "year"], ["INTERNAL", "EXTERNAL"], "source", "total")


def gl_accounts(accounts: DataFrame, excluded_types: Sequence[str]) -> DataFrame:
    """Account master without the excluded types; accounts without a type stay."""
    excluded = F.coalesce(F.col("ac_type").isin(list(excluded_types)), F.lit(False))
    return accounts.filter(~excluded).select(*ACCOUNT_COLUMNS)


def total_value(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(numeric.total(F.col("value")).cast("double").alias("value"))
