"""Purchase cohorts and the purchase requisition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from merchantry.functions import calendar, numeric
from merchantry.operators.ordered import latest_per_key, seasonal_mean
from merchantry.operators.prep import PLANNED_ITEM_GROUPS, item_group_filter, require_keys
from merchantry.operators.figures import stored_figure
from merchantry.session import cut_lineage

WEEKS = list(range(1, calendar.COHORT_WEEKS + 1))
WEEK_COLUMNS = [f"week_{k}" for k in WEEKS]
LINE_ORDER = ["povoucher", "uuid"]
# Days counted per month of sales, and the mark of shipment names that are planned.
DAYS_PER_MONTH = 30.5
SHIPMENT_MARK = "MDKF"


def _rounded(column: Column, digits: int | None) -> Column:
    return (column if digits is None else F.coalesce(numeric.half_even(column, digits), F.lit(0))).cast("double")


def daily_item_sales(sales: DataFrame) -> DataFrame:
    """Sales per item and day. Stands in for the sales wherever only item totals over time
    matter, at a fraction of the rows."""
    keys = ["zid", "itemcode", "date", "year", "month"]
    return require_keys(sales, keys).groupBy(*keys).agg(
        F.sum("quantity").cast("decimal(28,4)").alias("quantity"),
        F.sum("totalsales").cast("decimal(28,4)").alias("totalsales"))


def weekly_sales_after(sales: DataFrame, receipts: DataFrame) -> DataFrame:
    """Per item and receipt date: quantity sold in each of the 12 weeks from that date on, the
    amount of all of them, and the days since the item's previous receipt date.

    Both sides become one row per item and day first. The time line is cut into spans as long
    as the 12 weeks, so a receipt date only meets the sale days of its own span and the next:
    an equi-join whose groups are bounded by the calendar, however much one item sells.
    """
    item = ["zid", "itemcode"]
    span = 7 * calendar.COHORT_WEEKS
    span_of = lambda date: F.floor(F.unix_date(date) / span)
    sold = require_keys(sales, [*item, "date"]).groupBy(*item, F.col("date").alias("sale_date")).agg(
        F.sum("quantity").alias("quantity"), F.sum("totalsales").alias("amount"))
    bought = receipts.groupBy(*item, F.col("combinedate").alias("date")).agg(
        F.min(F.struct(*LINE_ORDER)).alias("first_line"))
    before = F.lag("date").over(W.partitionBy(*item).orderBy("date"))
    bought = bought.withColumn("gap", F.coalesce(F.datediff("date", before), F.lit(0)))
    own = span_of(F.col("date"))
    reach = bought.select(*item, "date", F.explode(F.array(own, own + 1)).alias("span"))
    days = F.datediff("sale_date", "date")
    met = reach.join(sold.withColumn("span", span_of(F.col("sale_date"))), [*item, "span"]).filter(
        (days >= 0) & (days < span))
    week = F.floor(days / 7) + 1
    after = met.groupBy(*item, "date").agg(
        *[F.sum(F.when(week == k, F.col("quantity"))).alias(name) for k, name in zip(WEEKS, WEEK_COLUMNS)],
        F.sum("amount").alias("amount"))
    return bought.join(after, [*item, "date"], "left").fillna(0, [*WEEK_COLUMNS, "amount"])


def purchase_cohort(sales: DataFrame, receipts: DataFrame, digits: int | None = 0) -> DataFrame:
    """Every received purchase line with what happened to the item in the 12 weeks after it.

    ``receipts`` needs zid, itemcode, itemname, povoucher, shipmentname, combinedate, quantity,
    cost and a unique uuid. ``digits=None`` leaves the figures unrounded.
    """
    after = weekly_sales_after(sales, receipts)
    lines = receipts.join(
        after.withColumnRenamed("date", "combinedate"), ["zid", "itemcode", "combinedate"])
    sold = sum((F.col(c) for c in WEEK_COLUMNS), F.lit(0))
    first_month = sum((F.col(c) for c in WEEK_COLUMNS[:4]), F.lit(0))
    price = F.coalesce(numeric.ratio(F.col("amount"), sold), F.lit(0.0))
    days_left = numeric.ratio(F.col("quantity").cast("double") * DAYS_PER_MONTH, first_month)
    leads = F.struct(*LINE_ORDER) == F.col("first_line")
    return lines.select(
        "zid", "itemcode", "itemname", "povoucher", "shipmentname", "combinedate",
        _rounded(F.col("quantity"), digits).alias("quantity"),
        _rounded(F.col("cost"), digits).alias("cost"),
        _rounded(price, digits).alias("average_sales_price"),
        *[_rounded(F.col(c), digits).alias(c) for c in WEEK_COLUMNS],
        F.when(leads, F.col("gap")).otherwise(0).alias("days_since_last_purchase"),
        _rounded(days_left, digits).alias("days_of_product_left"),
        "uuid",
    )


def latest_receipts(receipts: DataFrame) -> DataFrame:
    """The last received line of each item. Which one it is doesn't depend on sales, so a report that only shows the
    last receipt builds the cohort of these lines alone; only days_since_last_purchase needs the earlier ones."""
    return latest_per_key(receipts, ["zid", "itemcode"], ["combinedate", *LINE_ORDER])


def latest_cohort(cohort: DataFrame) -> DataFrame:
    """The last cohort row of each item."""
    kept = ["zid", "itemcode", "cost", "average_sales_price", "combinedate", "quantity", *WEEK_COLUMNS[:4]]
    latest = latest_per_key(cohort, ["zid", "itemcode"], ["combinedate", *LINE_ORDER])
    return latest.select(*kept)


def open_shipments(orders: DataFrame) -> DataFrame:
    """Quantity on order per item and shipment; the arrival date is the text after the comma."""
    marked = require_keys(orders, ["zid", "itemcode", "shipmentname"]).filter(
        F.col("shipmentname").contains(SHIPMENT_MARK))
    return marked.groupBy("zid", "itemcode", "shipmentname").agg(
        numeric.total(F.col("quantity")).cast("double").alias("quantity"))


def project_stock(base: DataFrame, as_of: str) -> DataFrame:
    """Fold the shipments of each item in order of arrival, for frames that hold them as an array; ``stock_walk`` is the
    same over rows.

    Stock falls by a month's mean every 30 days, never below 0, and rises with each shipment;
    one further month is taken off at the end. Needs stockqty, n_mean, shipments (sorted) and
    on_order (shipmentname -> quantity); adds steps and final_stock. A shipment whose arrival date can't be read is an
    error that names it: no stock after it would mean anything.
    """
    empty = F.array().cast("array<struct<shipmentname:string,arrival:string,stock_before:double,quantity:double>>")
    start = F.struct(
        F.col("stockqty").cast("double").alias("stock"), F.lit(as_of).cast("date").alias("day"), empty.alias("steps"))

    def arrive(state: Column, shipment: Column) -> Column:
        unreadable = F.raise_error(F.concat(F.lit("no readable arrival date in shipment "), shipment["shipmentname"])).cast("date")
        day = F.coalesce(shipment["arrival"].try_cast("date"), unreadable)
        months = F.datediff(day, state["day"]) / F.lit(30.0)
        before = F.greatest(state["stock"] - months * F.col("n_mean"), F.lit(0.0))
        quantity = F.coalesce(F.try_element_at("on_order", shipment["shipmentname"]), F.lit(0.0))
        step = F.struct(
            shipment["shipmentname"].alias("shipmentname"), shipment["arrival"].alias("arrival"),
            before.alias("stock_before"), quantity.alias("quantity"))
        return F.struct(
            (before + quantity).alias("stock"), day.alias("day"),
            F.concat(state["steps"], F.array(step)).alias("steps"))

    folded = base.withColumn("state", F.aggregate("shipments", start, arrive))
    return folded.withColumn("steps", F.col("state.steps")).withColumn(
        "final_stock", F.greatest(F.col("state.stock") - F.col("n_mean"), F.lit(0.0))).drop("state")


def arrivals(orders: DataFrame, as_of: str) -> DataFrame:
    """The open shipments of each company in order of arrival: (zid, shipmentname, arrival, step, steps, months), where
    ``months`` is the time since the shipment before, or since ``as_of``.

    Every shipment is a column of the requisition, so there are few of them by nature. One whose arrival date can't be
    read is an error that names it.
    """
    named = require_keys(orders, ["zid", "shipmentname"]).filter(F.col("shipmentname").contains(SHIPMENT_MARK))
    distinct = named.select("zid", "shipmentname", F.split("shipmentname", ",")[1].alias("arrival")).distinct()
    unreadable = F.raise_error(F.concat(F.lit("no readable arrival date in shipment "), "shipmentname")).cast("date")
    company = W.partitionBy("zid")
    in_order = company.orderBy("arrival", "shipmentname")
    before = F.coalesce(F.lag("day").over(in_order), F.lit(as_of).cast("date"))
    return (
        distinct.withColumn("day", F.coalesce(F.col("arrival").try_cast("date"), unreadable))
        .withColumn("step", F.row_number().over(in_order))
        .withColumn("steps", F.count("*").over(company))
        .withColumn("months", F.datediff("day", before) / F.lit(30.0))
        .drop("day")
    )


def stock_walk(items: DataFrame, shipments: DataFrame, on_order: DataFrame) -> DataFrame:
    """Stock of each item just before each of its company's shipments, as a prefix scan.

    ``items`` has zid, itemcode, stockqty and n_mean, one row per item; ``shipments`` comes from ``arrivals``; ``on_order``
    is (zid, itemcode, shipmentname, quantity). Stock falls by n_mean a month, never below 0, and rises with a shipment.

    Clamping at 0 is a fold, but max(x + p, 0) composes: where the plain running sum reaches a new minimum below 0, the
    clamped stock is 0 and starts anew. A first running sum finds these points, a second one adds up from the last of
    them, in the order of the fold. Rows are (item, shipment, fall or rise); all windows share one exchange by item.
    """
    item = ["zid", "itemcode"]
    falls = -(F.col("months") * F.col("n_mean"))
    first = F.when(F.col("step") == 1, F.col("stockqty").cast("double") + falls).otherwise(falls)
    moves = F.array(
        F.struct(F.lit(0).alias("phase"), first.alias("move")), F.struct(F.lit(1).alias("phase"), F.col("quantity").alias("move")))
    rows = (
        items.select(*item, "stockqty", "n_mean")
        .join(shipments, "zid")
        .join(on_order, [*item, "shipmentname"], "left")
        .withColumn("quantity", F.coalesce(F.col("quantity").cast("double"), F.lit(0.0)))
        .select(*item, "shipmentname", "arrival", "step", "steps", "quantity", F.inline(moves))
    )
    so_far = W.partitionBy(*item).orderBy("step", "phase").rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy(*item).orderBy("step", "phase").rowsBetween(W.unboundedPreceding, -1)
    # Only a fall can touch the floor; what a shipment brings is never clamped.
    lowest = F.least(F.coalesce(F.min(F.when(F.col("phase") == 0, F.col("plain"))).over(earlier), F.lit(0.0)), F.lit(0.0))
    anew = (F.col("phase") == 0) & (F.col("plain") < F.col("lowest"))
    since = W.partitionBy(*item, "since").orderBy("step", "phase").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        rows.withColumn("plain", F.sum("move").over(so_far))
        .withColumn("lowest", lowest)
        .withColumn("anew", anew)
        .withColumn("since", F.coalesce(F.max(F.when(F.col("anew"), F.col("step"))).over(so_far), F.lit(0)))
        .withColumn("stock", F.sum(F.when(F.col("anew"), 0.0).otherwise(F.col("move"))).over(since))
        .filter("phase = 0")
        .select(*item, "shipmentname", "arrival", "step", "steps",
                F.greatest("stock", F.lit(0.0)).alias("stock_before"), "quantity")
    )


def _planned_items(stock: DataFrame, sales: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Stock, least name and monthly mean of each planned item."""
    item = ["zid", "itemcode"]
    on_hand = require_keys(item_group_filter(stock, groups), item).groupBy(*item).agg(
        numeric.total(F.col("stockqty")).cast("double").alias("stockqty"), F.min("itemname").alias("itemname"))
    return on_hand.join(seasonal_mean(sales), item, "left").fillna(0, ["n_mean"])


def stock_projection(cohort: DataFrame, orders: DataFrame, stock: DataFrame, sales: DataFrame, as_of: str,
                     groups: Sequence[str] = PLANNED_ITEM_GROUPS, digits: int | None = 0) -> DataFrame:
    """Long form: one row per item and open shipment. The projection doesn't depend on ``cohort``."""
    walk = stock_walk(_planned_items(stock, sales, groups), stored_figure(arrivals(orders, as_of)), open_shipments(orders))
    return walk.select(
        "zid", "itemcode", "shipmentname", "arrival",
        _rounded(F.col("stock_before"), digits).alias("stock_before"),
        _rounded(F.col("quantity"), digits).alias("quantity"))


def purchase_requisition(cohort: DataFrame, orders: DataFrame, stock: DataFrame, sales: DataFrame, as_of: str,
                         groups: Sequence[str] = PLANNED_ITEM_GROUPS, digits: int | None = 0,
                         ordered: bool = False) -> DataFrame:
    """One row per planned item: stock, last receipt, sales rhythm, open shipments, stock at the end.

    ``steps`` holds each shipment with the stock just before it. Items with a shipment among
    the last three come first, then the lowest final stock, then the fastest sellers.
    """
    item = ["zid", "itemcode"]
    planned = cut_lineage(_planned_items(stock, sales, groups), "planned")
    walk = stock_walk(planned, stored_figure(arrivals(orders, as_of)), open_shipments(orders))
    step = F.struct("step", "shipmentname", "arrival", "stock_before", "quantity")
    walked = walk.groupBy(*item).agg(
        F.max_by(F.col("stock_before") + F.col("quantity"), "step").alias("stock"),
        (F.sum(F.when(F.col("step") > F.col("steps") - 3, F.col("quantity"))) > 0).alias("has_shipments"),
        F.count("*").cast("int").alias("shipments"),
        F.transform(F.sort_array(F.collect_list(step)), lambda s: s.dropFields("step")).alias("steps"))
    none = F.array().cast(walked.schema["steps"].dataType)
    figures = ["stockqty", "cost", "average_sales_price", "quantity", *WEEK_COLUMNS[:4], "n_mean", "final_stock"]
    result = (
        planned.join(walked, item, "left").join(latest_cohort(cohort), item, "left")
        .fillna(0, ["cost", "average_sales_price", "quantity", *WEEK_COLUMNS[:4], "shipments"])
        .fillna(False, ["has_shipments"])
        .withColumn("steps", F.coalesce("steps", none))
        .withColumn("final_stock", F.greatest(F.coalesce("stock", "stockqty") - F.col("n_mean"), F.lit(0.0)))
        .select("zid", "itemcode", "itemname", "combinedate", "has_shipments",
                *[_rounded(F.col(c), digits).alias(c) for c in figures], "shipments", "steps")
    )
    if not ordered:
        return result
    return result.orderBy("zid", F.desc("has_shipments"), "final_stock", F.desc("n_mean"), "itemcode")


def requisition_wide(requisition: DataFrame, shipments: Sequence[str], digits: int | None = 0) -> DataFrame:
    """A stock_before_<shipment> and a quantity column per shipment."""
    def step_of(name: str) -> Column:
        return F.get(F.filter("steps", lambda step: step["shipmentname"] == name), F.lit(0))

    columns = []
    for name in shipments:
        hit = step_of(name)
        columns += [_rounded(hit["stock_before"], digits).alias(f"stock_before_{name}"),
                    _rounded(hit["quantity"], digits).alias(name)]
    keep = [c for c in requisition.columns if c not in ("steps", "shipments", "final_stock", "has_shipments")]
    return requisition.select(*keep, *columns, "final_stock")
