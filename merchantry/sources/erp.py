"""Extracts from the ERP's own tables into the analytical layout."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.functions import codes
from merchantry.operators.aggregate import signed_sum

# ERP column -> analytical column, per master table.
RENAMES: dict[str, dict[str, str]] = {
    "glmst": {"ztime": "itime", "zutime": "utime", "zid": "zid", "xacc": "ac_code", "xdesc": "ac_name",
              "xacctype": "ac_type", "xhrc1": "ac_lv1", "xhrc2": "ac_lv2", "xhrc3": "ac_lv3",
              "xhrc4": "ac_lv4", "xaccusage": "usage"},
    "gldetail": {"ztime": "itime", "zutime": "utime", "zid": "zid", "xacc": "ac_code", "xsub": "ac_sub",
                 "xproj": "project", "xvoucher": "voucher", "xprime": "value"},
    "glheader": {"ztime": "itime", "zutime": "utime", "zid": "zid", "xvoucher": "voucher", "xdate": "date",
                 "xyear": "year", "xper": "month"},
    "cacus": {"ztime": "itime", "zutime": "utime", "zid": "zid", "xcus": "cusid", "xshort": "cusname",
              "xadd2": "cusadd", "xcity": "cuscity", "xstate": "cusstate", "xmobile": "cusmobile",
              "xtaxnum": "cusmobile2"},
    "caitem": {"ztime": "itime", "zutime": "utime", "zid": "zid", "xitem": "itemcode", "xdesc": "itemname",
               "xgitem": "itemgroup", "xabc": "itemgroup2", "xscode": "packcode"},
    "prmst": {"ztime": "itime", "zutime": "utime", "zid": "zid", "xemp": "spid", "xname": "spname",
              "xdept": "department", "xdesig": "designation"},
}


def renamed(source: DataFrame, table: str) -> DataFrame:
    """The plain projections: accounts, journals, vouchers, customers, items, employees."""
    return source.select([F.col(old).alias(new) for old, new in RENAMES[table].items()])


def etl_purchase(poord: DataFrame, poodt: DataFrame, pogrn: DataFrame) -> DataFrame:
    """Order lines with their receipts; the date is the receipt's, or the order's before that."""
    heads = poord.filter(F.col("xstatuspor").isin(codes.PURCHASE_STATES)).select(
        "zid", "xpornum", F.col("xdate").alias("order_date"), "xcounterno", "xstatuspor")
    lines = poodt.select("zid", "xpornum", "ztime", "zutime", "xitem", "xqtyord", "xrate")
    receipts = pogrn.select("zid", "xpornum", "xgrnnum", F.col("xdate").alias("receipt_date"))
    return lines.join(heads, ["zid", "xpornum"]).join(receipts, ["zid", "xpornum"], "left").select(
        F.col("ztime").alias("itime"), F.col("zutime").alias("utime"), "zid",
        F.coalesce("receipt_date", "order_date").alias("combinedate"),
        F.col("xpornum").alias("povoucher"), F.col("xgrnnum").alias("grnvoucher"),
        F.col("xitem").alias("itemcode"), F.col("xcounterno").alias("shipmentname"),
        F.col("xqtyord").alias("quantity"), F.col("xrate").alias("cost"), F.col("xstatuspor").alias("status"),
    )


def _document_totals(
    heads: DataFrame, lines: DataFrame, moves: DataFrame, number: str, person: str, keep_empty: bool,
    names: Mapping[str, str], together: bool = False,
) -> DataFrame:
    """Document x item totals with the stock movement's cost.

    One row per combination of the change times involved; a line meeting several movements
    counts once for each of them, and a movement once for each line. Lines and movements are
    summed and counted before they meet, so a document with very many lines is small by then
    and the repeats are a multiplication. Lines and movements are dealt by document and item at once, which
    serves their sums and their meeting; the heads come last, so each row is exchanged twice at most.
    With ``together`` all are dealt by document alone, under ``session.TOGETHER`` once for all that follows.
    """
    h = heads.select(
        "zid", F.col(number).alias("number"), F.col("xdate").alias("date"), F.col(person).alias("sp_id"),
        F.col("xcus").alias("cusid"), F.col("ztime").alias("h_itime"), F.col("zutime").alias("h_utime"))
    document, place = ["zid", "number"], ["zid", "number", "itemcode"]
    dealt = document if together else place
    h = h.repartition(*document).groupBy(*h.columns).agg(F.count("*").alias("heads"))
    d = lines.select(
        "zid", F.col(number).alias("number"), F.col("xitem").alias("itemcode"),
        F.col("ztime").alias("itime"), F.col("zutime").alias("utime"), "xqty", "xlineamt")
    d = d.repartition(*dealt).groupBy(*place, "itime", "utime").agg(
        F.sum("xqty").alias("qty"), F.sum("xlineamt").alias("amount"), F.count("*").alias("lines"))
    m = moves.select(
        "zid", F.col("xdocnum").alias("number"), F.col("xitem").alias("itemcode"),
        F.col("ztime").alias("m_itime"), F.col("zutime").alias("m_utime"), "xval")
    m = m.repartition(*dealt).groupBy(*place, "m_itime", "m_utime").agg(
        F.sum("xval").alias("value"), F.count("*").alias("moves"))
    met = d.join(m, place, "left" if keep_empty else "inner")
    # A header without lines stays, without company: that comes from the line.
    met = met.join(h, document, "right" if keep_empty else "inner")
    times = F.coalesce("moves", F.lit(1)) * F.col("heads")
    out = ["itime", "utime", "zid", "number", "date", "sp_id", "cusid", "itemcode",
           "qty", "amount", "value", "h_itime", "h_utime", "m_itime", "m_utime"]
    rows = met.withColumns({
        "qty": F.col("qty") * times, "amount": F.col("amount") * times,
        "value": F.col("value") * F.col("lines") * F.col("heads"),
        "zid": F.when(F.col("lines").isNotNull(), F.col("zid")),
    }).select(out)
    return rows.withColumnsRenamed({
        "number": names["number"], "qty": names["xqty"], "amount": names["xlineamt"], "value": names["xval"]})


# The change times of header and movement travel along so that an incremental run can look at them.
TRAILING_TIMES = ["h_itime", "h_utime", "m_itime", "m_utime"]


def etl_sales(opdor: DataFrame, opddt: DataFrame, imtrn: DataFrame, together: bool = False) -> DataFrame:
    """A header without lines yields one row with neither item nor company."""
    return _document_totals(opdor, opddt, imtrn, "xdornum", "xsp", True, {
        "number": "ordernumber", "xqty": "quantity", "xlineamt": "totalsales", "xval": "cost"}, together)


def etl_return(opcrn: DataFrame, opcdt: DataFrame, imtrn: DataFrame, together: bool = False) -> DataFrame:
    return _document_totals(opcrn, opcdt, imtrn, "xcrnnum", "xemp", False, {
        "number": "revoucher", "xqty": "returnqty", "xlineamt": "treturnamt", "xval": "returncost"}, together)


def etl_stock(imtrn: DataFrame) -> DataFrame:
    totals = signed_sum(imtrn, ["zid", "xitem"], {"stockqty": "xqty", "stockvalue": "xval"}, "xsign")
    return totals.withColumnRenamed("xitem", "itemcode")


def etl_stock_value(imtrn: DataFrame) -> DataFrame:
    totals = signed_sum(imtrn, ["zid", "xyear", "xper", "xwh"], {"stockvalue": "xval"}, "xsign")
    return totals.withColumnsRenamed({"xyear": "year", "xper": "month", "xwh": "warehouse"})
