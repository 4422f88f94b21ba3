"""The analytical and ERP tables derived from the TPC-H-like parquet tables.

Every derivation is a plain projection and join; TABLE_SQL holds the same derivations as
common table expressions for the SQL side of the checks.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.functions.numeric import MONEY
from merchantry.plans.statements import BALANCE_LINES, INCOME_LINES
from merchantry.session import cut_lineage

AS_OF = "2001-12-01"
FIRST_COMPANY = 100000

LABELS = {
    "income": {f"K{i:02d}": line for i, line in enumerate(INCOME_LINES)},
    "balance": {f"K{i:02d}": line for i, line in enumerate(BALANCE_LINES, start=len(INCOME_LINES))},
}


# Columns of the given tables. Declared, so that building a query reads no file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
}


def text(column: Column) -> Column:
    return column.cast("string")


def line_uuid() -> Column:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").cast("int"), cents, F.date_format("l_shipdate", "yyyyMMdd"),
    )


def line_amount() -> Column:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return (price * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast(MONEY)


def line_cost() -> Column:
    return (F.col("l_quantity").cast("decimal(18,2)") * F.col("p_retailprice").cast("decimal(18,2)")).cast(MONEY)


class DriverTables:
    """Views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}.parquet")

    def companies(self) -> DataFrame:
        return self.raw("region").select((F.col("r_regionkey") + FIRST_COMPANY).alias("zid"))

    @cached_property
    def years(self) -> list[int]:
        """The years from the first to the last order or shipment."""
        ends = self.raw("orders").select(F.year("o_orderdate").alias("y")).unionByName(
            self.raw("lineitem").select(F.year("l_shipdate").alias("y"))).agg(F.min("y").alias("a"), F.max("y").alias("b")).first()
        return list(range(ends["a"], ends["b"] + 1)) if ends["a"] is not None else []

    def orders(self) -> DataFrame:
        """Order heads with company, customer and area."""
        nations = self.raw("nation").select("n_nationkey", "n_regionkey", "n_name")
        customers = self.raw("customer").select("c_custkey", "c_nationkey", "c_name")
        return (
            self.raw("orders")
            .join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                (F.col("n_regionkey") + FIRST_COMPANY).alias("zid"), "o_orderkey",
                F.col("o_orderdate").cast("date").alias("order_date"), "o_orderstatus", "o_orderdate",
                text(F.col("o_custkey")).alias("cusid"), F.col("c_name").alias("cusname"),
                F.col("n_name").alias("area"),
            )
        )

    def lines(self, items: bool = True, employees: bool = True, where: Column | None = None) -> DataFrame:
        """Order lines with their head; part and supplier only where a report uses them."""
        lines = self.raw("lineitem")
        if where is not None:
            lines = lines.filter(where)
        # Two facts: the size estimate of the joined heads says little, so a broadcast of
        # either side is ruled out; a hot order is split by the run-time skew handling.
        lines = lines.join(self.orders().hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        if items:
            lines = lines.join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
        if employees:
            lines = lines.join(
                self.raw("supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        return lines

    def _common(self, items: bool, employees: bool) -> list[Column]:
        columns = [
            F.col("zid"), text(F.col("l_suppkey")).alias("spid"), F.col("cusid"), F.col("cusname"),
            F.col("area"), text(F.col("l_partkey")).alias("itemcode"), line_uuid().alias("uuid"),
        ]
        if employees:
            columns.append(F.col("s_name").alias("spname"))
        if items:
            columns += [F.col("p_name").alias("itemname"), F.col("p_type").alias("itemgroup")]
        return columns

    def sales(self, items: bool = True, employees: bool = True) -> DataFrame:
        extra = [line_cost().alias("cost")] if items else []
        return self.lines(items, employees).select(
            *self._common(items, employees), text(F.col("l_orderkey")).alias("voucher"),
            F.col("order_date").alias("date"), F.year("order_date").alias("year"),
            F.month("order_date").alias("month"),
            F.col("l_quantity").cast(MONEY).alias("quantity"), line_amount().alias("totalsales"), *extra,
        )

    def returns(self, items: bool = True, employees: bool = True) -> DataFrame:
        extra = [line_cost().alias("returncost")] if items else []
        shipped = F.col("l_shipdate").cast("date")
        return self.lines(items, employees, F.col("l_returnflag") == "R").select(
            *self._common(items, employees),
            F.concat(F.lit("RE"), text(F.col("l_orderkey"))).alias("revoucher"),
            shipped.alias("date"), F.year(shipped).alias("year"), F.month(shipped).alias("month"),
            F.col("l_quantity").cast(MONEY).alias("returnqty"), line_amount().alias("treturnamt"), *extra,
        )

    def purchases(self) -> DataFrame:
        received = F.col("l_linestatus") == "F"
        slot = F.col("l_suppkey") % 4
        shipment = F.concat(
            F.lit("MDKF-"), text(slot), F.lit(",2002-0"), text(slot + 1), F.lit("-15"))
        return self.lines(True, False, F.col("l_linenumber") == 7).select(
            "zid", F.concat(F.lit("IP--"), text(F.col("l_orderkey"))).alias("povoucher"),
            F.when(received, F.concat(F.lit("GRN-"), text(F.col("l_orderkey")))).alias("grnvoucher"),
            F.col("l_shipdate").cast("date").alias("combinedate"),
            text(F.col("l_partkey")).alias("itemcode"), F.col("p_name").alias("itemname"),
            shipment.alias("shipmentname"), F.col("l_quantity").cast(MONEY).alias("quantity"),
            F.col("p_retailprice").cast(MONEY).alias("cost"),
            F.when(received, F.lit("5-Received")).otherwise("1-Open").alias("status"),
            line_uuid().alias("uuid"),
        )

    # ---- the reporting tables in their stored layout -------------------------------------

    def sales_table(self) -> DataFrame:
        s = self.sales(True, False)
        return s.select("uuid", "zid", F.col("voucher").alias("ordernumber"), "date",
                        F.col("spid").alias("sp_id"), "cusid", "itemcode", "quantity", "totalsales", "cost")

    def return_table(self) -> DataFrame:
        r = self.returns(True, False)
        return r.select("uuid", "zid", "revoucher", "date", "cusid", F.col("spid").alias("sp_id"),
                        "itemcode", "returnqty", "treturnamt", "returncost")

    def items(self) -> DataFrame:
        size = F.col("p_size") % 10
        pack = (
            F.when(size == 0, F.concat(F.lit("PK"), text(F.col("p_partkey") % 50)))
            .when(size == 1, F.lit("NO")).when(size == 2, F.lit(""))
            .when(size == 3, F.concat(F.lit("KH"), text(F.col("p_partkey") % 50)))
        )
        part = self.raw("part").select(
            text(F.col("p_partkey")).alias("itemcode"), F.col("p_name").alias("itemname"),
            F.col("p_type").alias("itemgroup"), F.col("p_brand").alias("itemgroup2"), pack.alias("packcode"))
        return self._per_company(part)

    def employees(self) -> DataFrame:
        people = self.raw("supplier").select(
            text(F.col("s_suppkey")).alias("spid"), F.col("s_name").alias("spname"),
            F.concat(F.lit("D"), text(F.col("s_nationkey"))).alias("department"),
            F.when(F.col("s_acctbal") > 0, F.lit("Senior")).otherwise("Junior").alias("designation"))
        return self._per_company(people)

    def _per_company(self, df: DataFrame) -> DataFrame:
        """Every row once per company of the region table. As a join, so that the planner doesn't take the result for as small as
        one company's rows and broadcast it: each task would then hold all of it."""
        return df.crossJoin(F.broadcast(self.companies())).select("zid", *df.columns)

    def customers(self) -> DataFrame:
        nations = self.raw("nation")
        return self.raw("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
            (F.col("n_regionkey") + FIRST_COMPANY).alias("zid"), text(F.col("c_custkey")).alias("cusid"),
            F.col("c_name").alias("cusname"), F.concat(F.lit("add "), text(F.col("c_nationkey"))).alias("cusadd"),
            F.col("n_name").alias("cuscity"), F.col("c_mktsegment").alias("cusstate"),
            text(F.col("c_custkey") * 7).alias("cusmobile"), text(F.col("c_custkey") * 11).alias("cusmobile2"))

    def accounts(self) -> DataFrame:
        """One ledger account per part and company; 25 account kinds, the last one unlabelled."""
        kind = F.col("p_partkey") % 25
        kind_type = (
            F.when(kind == 0, F.lit("Income")).when(kind < 11, F.lit("Expenditure"))
            .when(kind < 18, F.lit("Asset")).when(kind < 24, F.lit("Liability"))
            .when(F.col("p_partkey") % 50 == 24, F.lit("Asset"))
        )
        part = self.raw("part").select(
            F.concat(F.lit("A"), text(F.col("p_partkey"))).alias("ac_code"),
            F.col("p_name").alias("ac_name"), kind_type.alias("ac_type"),
            F.concat(F.lit("T"), text(F.floor(kind / 12))).alias("ac_lv1"),
            F.concat(F.lit("G"), text(F.floor(kind / 6))).alias("ac_lv2"),
            F.concat(F.lit("H"), text(F.floor(kind / 3))).alias("ac_lv3"),
            F.concat(F.lit("K"), F.lpad(text(kind), 2, "0")).alias("ac_lv4"),
            F.when(kind == 12, F.lit("AR")).otherwise("GL").alias("usage"))
        return self._per_company(part)

    def gl_headers(self) -> DataFrame:
        prefixes = ["JV--", "RCT-", "CRCT", "STJV", "BRCT", "CPAY", "BPAY", "INOP"]
        return self.orders().select(
            "zid", self._voucher(prefixes, F.col("o_orderkey")).alias("voucher"),
            F.col("order_date").alias("date"), F.year("order_date").alias("year"),
            F.when(F.col("o_orderkey") % 50 == 0, 0).otherwise(F.month("order_date")).alias("month"))

    @staticmethod
    def _voucher(prefixes: list[str], key: Column) -> Column:
        prefix = F.get(F.array(*[F.lit(p) for p in prefixes]), (key % 8).cast("int"))
        return F.concat(prefix, text(key))

    def gl_details(self) -> DataFrame:
        prefixes = ["JV--", "RCT-", "CRCT", "STJV", "BRCT", "CPAY", "BPAY", "INOP"]
        even = (F.col("l_orderkey") + F.col("l_linenumber")) % 2 == 0
        price = F.col("l_extendedprice").cast(MONEY)
        return self.lines(False, False).select(
            line_uuid().alias("uuid"), "zid", F.concat(F.lit("A"), text(F.col("l_partkey"))).alias("ac_code"),
            F.col("cusid").alias("ac_sub"), F.concat(F.lit("P"), text(F.col("l_orderkey") % 2)).alias("project"),
            self._voucher(prefixes, F.col("l_orderkey")).alias("voucher"),
            F.when(even, price).otherwise(-price).alias("value"))

    def movements(self) -> DataFrame:
        """Stock ledger in the ERP layout: one movement per order line, one more per returned line."""
        shipped = F.col("l_shipdate").cast("date")
        base = self.lines(True, False).select(
            "zid", F.col("l_orderkey"), F.col("l_returnflag"), F.col("l_linenumber"),
            text(F.col("l_partkey")).alias("xitem"), F.col("l_quantity").cast(MONEY).alias("xqty"),
            line_cost().alias("xval"), F.year(shipped).alias("xyear"), F.month(shipped).alias("xper"),
            F.concat(F.lit("W"), text(F.col("l_suppkey") % 4)).alias("xwh"),
            F.col("l_shipdate").alias("ztime"))
        received_back = F.when(F.col("l_returnflag") == "R", F.struct(
            F.concat(F.lit("RE"), text(F.col("l_orderkey"))).alias("xdocnum"), F.lit(1).alias("xsign")))
        direction = F.when(F.col("l_linenumber") == 7, 1).otherwise(-1)
        sold = F.struct(text(F.col("l_orderkey")).alias("xdocnum"), direction.alias("xsign"))
        return base.withColumn("doc", F.explode(F.array_compact(F.array(sold, received_back)))).select(
            "zid", "doc.xdocnum", "xitem", "xqty", "xval", "doc.xsign", "xyear", "xper", "xwh", "ztime",
            F.lit(None).cast("timestamp_ntz").alias("zutime"))

    def stock_table(self) -> DataFrame:
        from merchantry.sources.erp import etl_stock
        return etl_stock(self.movements())

    def stock_value_table(self) -> DataFrame:
        from merchantry.sources.erp import etl_stock_value
        return etl_stock_value(self.movements())

    def table(self, name: str) -> DataFrame:
        """Stored tables by name, for the catalog."""
        return {
            "sales": self.sales_table, "return": self.return_table, "purchase": self.purchases,
            "stock": self.stock_table, "stock_value": self.stock_value_table, "glmst": self.accounts,
            "gldetail": self.gl_details, "glheader": self.gl_headers, "cacus": self.customers,
            "caitem": self.items, "employee": self.employees,
        }[name]()

    # ---- ERP tables ------------------------------------------------------------------------

    def _change_times(self, created: Column, key: Column) -> list[Column]:
        changed = F.when(key % 5 == 0, created + F.make_dt_interval(days=(key % 30).cast("int")))
        return [created.alias("ztime"), changed.alias("zutime")]

    def opdor(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.orders().select(
            "zid", text(key).alias("xdornum"), F.col("order_date").alias("xdate"),
            text(key % 10).alias("xsp"), F.col("cusid").alias("xcus"),
            *self._change_times(F.col("o_orderdate"), key))

    def opddt(self) -> DataFrame:
        return self.lines(False, False).select(
            "zid", text(F.col("l_orderkey")).alias("xdornum"), text(F.col("l_partkey")).alias("xitem"),
            F.col("l_quantity").cast(MONEY).alias("xqty"), line_amount().alias("xlineamt"),
            *self._change_times(F.col("l_shipdate"), F.col("l_partkey")))

    def opcrn(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.orders().select(
            "zid", F.concat(F.lit("RE"), text(key)).alias("xcrnnum"), F.col("order_date").alias("xdate"),
            text(key % 10).alias("xemp"), F.col("cusid").alias("xcus"),
            *self._change_times(F.col("o_orderdate"), key))

    def opcdt(self) -> DataFrame:
        return self.lines(False, False, F.col("l_returnflag") == "R").select(
            "zid", F.concat(F.lit("RE"), text(F.col("l_orderkey"))).alias("xcrnnum"),
            text(F.col("l_partkey")).alias("xitem"), F.col("l_quantity").cast(MONEY).alias("xqty"),
            line_amount().alias("xlineamt"), *self._change_times(F.col("l_shipdate"), F.col("l_partkey")))

    def poord(self) -> DataFrame:
        key = F.col("o_orderkey")
        state = F.when(F.col("o_orderstatus") == "F", F.lit("5-Received")) \
            .when(F.col("o_orderstatus") == "O", F.lit("1-Open")).otherwise("3-Cancelled")
        return self.orders().select(
            "zid", F.concat(F.lit("IP--"), text(key)).alias("xpornum"), F.col("order_date").alias("xdate"),
            F.concat(F.lit("S"), text(key % 4)).alias("xcounterno"), state.alias("xstatuspor"),
            *self._change_times(F.col("o_orderdate"), key))

    def poodt(self) -> DataFrame:
        return self.lines(True, False, F.col("l_linenumber") == 7).select(
            "zid", F.concat(F.lit("IP--"), text(F.col("l_orderkey"))).alias("xpornum"),
            text(F.col("l_partkey")).alias("xitem"), F.col("l_quantity").cast(MONEY).alias("xqtyord"),
            F.col("p_retailprice").cast(MONEY).alias("xrate"),
            *self._change_times(F.col("l_shipdate"), F.col("l_partkey")))

    def pogrn(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.orders().filter(F.col("o_orderstatus") == "F").select(
            "zid", F.concat(F.lit("IP--"), text(key)).alias("xpornum"),
            F.concat(F.lit("GRN-"), text(key)).alias("xgrnnum"), F.date_add("order_date", 10).alias("xdate"),
            *self._change_times(F.col("o_orderdate") + F.make_dt_interval(days=F.lit(10)), key))

    def _erp(self, df: DataFrame, names: dict[str, str], created: Column, key: Column) -> DataFrame:
        return df.select(*[F.col(ours).alias(theirs) for ours, theirs in names.items()],
                         *self._change_times(created, key))

    def erp_master(self, name: str) -> DataFrame:
        """ERP-named masters and journals."""
        start = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
        if name == "glmst":
            return self._erp(self.accounts(), {
                "zid": "zid", "ac_code": "xacc", "ac_name": "xdesc", "ac_type": "xacctype", "ac_lv1": "xhrc1",
                "ac_lv2": "xhrc2", "ac_lv3": "xhrc3", "ac_lv4": "xhrc4", "usage": "xaccusage",
            }, start, F.substring("ac_code", 2, 20).cast("long"))
        if name == "gldetail":
            return self._erp(self.gl_details(), {
                "zid": "zid", "ac_code": "xacc", "ac_sub": "xsub", "project": "xproj", "voucher": "xvoucher",
                "value": "xprime"}, start, F.col("ac_sub").cast("long"))
        if name == "glheader":
            return self._erp(self.gl_headers(), {
                "zid": "zid", "voucher": "xvoucher", "date": "xdate", "year": "xyear", "month": "xper",
            }, F.col("date").cast("timestamp_ntz"), F.col("month"))
        if name == "cacus":
            return self._erp(self.customers(), {
                "zid": "zid", "cusid": "xcus", "cusname": "xshort", "cusadd": "xadd2", "cuscity": "xcity",
                "cusstate": "xstate", "cusmobile": "xmobile", "cusmobile2": "xtaxnum",
            }, start, F.col("cusid").cast("long"))
        if name == "caitem":
            return self._erp(self.items(), {
                "zid": "zid", "itemcode": "xitem", "itemname": "xdesc", "itemgroup": "xgitem",
                "itemgroup2": "xabc", "packcode": "xscode"}, start, F.col("itemcode").cast("long"))
        if name == "prmst":
            return self._erp(self.employees(), {
                "zid": "zid", "spid": "xemp", "spname": "xname", "department": "xdept",
                "designation": "xdesig"}, start, F.col("spid").cast("long"))
        raise KeyError(name)

    # ---- synchronisation -------------------------------------------------------------------

    @staticmethod
    def sync_rows(orders: DataFrame) -> DataFrame:
        key = F.col("o_orderkey")
        changed = F.col("o_orderdate") + F.make_dt_interval(days=(key % 30).cast("int"))
        return orders.select(
            key, "o_custkey", "o_orderstatus", F.col("o_orderdate").alias("itime"),
            F.when(key % 5 == 0, changed).alias("utime"))

    def sync_source(self) -> DataFrame:
        return self.sync_rows(self.raw("orders"))

    def sync_target(self) -> DataFrame:
        """What a run on the first day of 2000 had brought over, with some vouchers lost on the way; rows updated
        since are still in their older version."""
        day = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
        later = F.coalesce(F.col("utime") > day, F.lit(False))
        return self.sync_source().filter((F.col("itime") <= day) & (F.col("o_orderkey") % 97 != 0)).withColumns({
            "o_orderstatus": F.when(later, F.lit("X")).otherwise(F.col("o_orderstatus")),
            "utime": F.when(~later, F.col("utime"))})

    def erp_tables(self) -> dict[str, DataFrame]:
        """All ERP tables by name."""
        masters = ["glmst", "gldetail", "glheader", "cacus", "caitem", "prmst"]
        return {name: self.erp_master(name) for name in masters} | {
            "poord": self.poord(), "poodt": self.poodt(), "pogrn": self.pogrn(), "opdor": self.opdor(), "opddt": self.opddt(),
            "opcrn": self.opcrn(), "opcdt": self.opcdt(), "imtrn": self.movements()}

    def erp_stored(self, *names: str) -> dict[str, DataFrame]:
        """All ERP tables by name, those named as stored tables: a run reads each of them several times, and the joins that
        they are derived by belong to none of these reads."""
        return {name: cut_lineage(rows, name) if name in names else rows for name, rows in self.erp_tables().items()}

    def erp_tables_on(self, heads: str, others: str, tables: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """All ERP tables as they stood, headers on one day and all other tables on another, later one. Rows changed after
        that are in their state before the change, where headers name another person or shipment."""
        value = {"opdor": "xsp", "opcrn": "xemp", "poord": "xcounterno"}
        then = {}
        for name, rows in (tables or self.erp_tables()).items():
            day = F.lit(f"{heads if name in value else others} 00:00:00").cast("timestamp_ntz")
            later = F.coalesce(F.col("zutime") > day, F.lit(False))
            rows = rows.filter(F.col("ztime") <= day)
            if name in value:
                rows = rows.withColumn(value[name], F.when(later, F.lit("X")).otherwise(F.col(value[name])))
            then[name] = rows.withColumn("zutime", F.when(~later, F.col("zutime")))
        return then

    def outdated(self, name: str, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
        """An analytical table as a run on some day had left it: rows created since are not there, some documents got
        lost on the way, and rows of which header, line or movement changed since still have an older value."""
        from merchantry.sources import erp
        tables = tables or self.erp_tables()
        number, value = {
            "glmst": ("ac_code", "ac_name"), "gldetail": ("voucher", "project"), "glheader": ("voucher", "month"),
            "purchase": ("povoucher", "shipmentname"), "sales": ("ordernumber", "sp_id"), "return": ("revoucher", "sp_id"),
            "cacus": ("cusid", "cusname"), "caitem": ("itemcode", "itemname"), "employee": ("spid", "spname")}[name]
        if name == "purchase":
            heads = tables["poord"].select("zid", F.col("xpornum").alias("povoucher"), F.col("zutime").alias("h_utime"))
            receipts = tables["pogrn"].select(
                "zid", F.col("xpornum").alias("povoucher"), F.col("ztime").alias("m_itime"), F.col("zutime").alias("m_utime"))
            rows = erp.etl_purchase(tables["poord"], tables["poodt"], tables["pogrn"])
            rows = rows.join(heads, ["zid", "povoucher"]).join(receipts, ["zid", "povoucher"], "left")
        elif name in ("sales", "return"):
            rows = erp.etl_sales(tables["opdor"], tables["opddt"], tables["imtrn"]) if name == "sales" else \
                erp.etl_return(tables["opcrn"], tables["opcdt"], tables["imtrn"])
        else:
            table = "prmst" if name == "employee" else name
            rows = erp.renamed(tables[table], table)
        day = F.lit(f"{'1995-01-15' if name in ('glmst', 'gldetail', 'cacus', 'caitem', 'employee') else '2000-01-01'} 00:00:00").cast("timestamp_ntz")
        times = [c for c in ["utime", *erp.TRAILING_TIMES] if c in rows.columns]
        later = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) > day, F.lit(False)) for c in times])
        old = F.lit(0) if dict(rows.dtypes)[value] == "int" else F.lit("X")
        lost = F.pmod(F.xxhash64("zid", number), F.lit(97)) == 0
        return rows.filter(F.col("zid").isNotNull() & (F.col("itime") <= day) & ~lost).withColumns({
            value: F.when(later, old).otherwise(F.col(value)), "utime": F.when(F.col("utime") <= day, F.col("utime")),
        }).drop(*erp.TRAILING_TIMES)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
