"""Which items go together: market baskets over receipts and sales vouchers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.functions import numeric
from merchantry.operators.ordered import top_k_per_group
from merchantry.operators.prep import decimal_to_double, require_keys
from merchantry.operators.figures import stored_figure
from merchantry.session import cut_lineage

TOP = 5
#: Items of a voucher that meet all its others in one place. Only spreads the work.
BLOCK = 256
#: At most so many of an item's largest vouchers are skipped. More only saves work where as many large vouchers hold the same items.
DEPTH = 4
#: Items of a voucher up to which all its pairs are counted. Only larger ones are skipped or dealt into blocks.
LARGE = 64


def voucher_items(df: DataFrame, voucher: str) -> DataFrame:
    """One row per voucher and item, computed once and kept: every step of a basket report reads it.

    ``present`` says whether at least one whole unit is in there.
    """
    figures = [(numeric.total(F.col("quantity")) >= 1).alias("present")]
    if "totalsales" in df.columns:
        figures.append(numeric.total(F.col("totalsales")).cast("decimal(28,4)").alias("totalsales"))
    keys = ["zid", voucher, "itemcode"]
    grouped = require_keys(df, ["zid", "itemcode"]).groupBy(*keys).agg(*figures)
    return cut_lineage(grouped.withColumnRenamed(voucher, "voucher"))


def item_names(df: DataFrame) -> DataFrame:
    """The least name per item, from facts or from an item table; repeats go before names are compared."""
    distinct = require_keys(df, ["zid", "itemcode"]).select("zid", "itemcode", "itemname").distinct()
    return distinct.groupBy("zid", "itemcode").agg(F.min("itemname").alias("itemname"))


def item_presence(items: DataFrame) -> DataFrame:
    return items.filter(F.col("voucher").isNotNull()).select("zid", "voucher", "itemcode", "present")


def item_counts(presence: DataFrame) -> DataFrame:
    """Vouchers per item; an item never reaching one unit is listed with 0."""
    return presence.groupBy("zid", "itemcode").agg(
        F.sum(F.col("present").cast("int")).cast("long").alias("vouchers"))


def large_vouchers(rows: DataFrame, large: int = LARGE) -> DataFrame:
    """Vouchers of more than ``large`` items: (zid, voucher, size)."""
    return rows.groupBy("zid", "voucher").agg(F.count("*").alias("size")).filter(F.col("size") > large)


def skipped_vouchers(rows: DataFrame, top: int = TOP, depth: int = DEPTH, large: int = LARGE) -> DataFrame:
    """Per item its largest vouchers, in which companions need not be counted one by one: (zid, itemcode, skipped).

    Only vouchers of more than ``large`` items; an item without any is not listed. The largest one always; further ones as long as more than ``top`` items have the same largest vouchers, at most ``depth``.
    Those items are found together that often, which is a floor for the companions of each: one that is found less often
    can't be among the best, and one found more often is also met in another voucher.
    """
    largest = top_k_per_group(rows.join(large_vouchers(rows, large), ["zid", "voucher"]), ["zid", "itemcode"], [F.desc("size"), F.asc("voucher")], depth)
    listed = F.array_sort(F.collect_list(F.struct("rank", "voucher")))
    largest = cut_lineage(largest.groupBy("zid", "itemcode").agg(listed["voucher"].alias("largest")))
    # Longer beginnings can only be shared by items that share the first two vouchers.
    two = F.slice("largest", 1, 2)
    alike = largest.filter(F.size("largest") > 1).groupBy("zid", two.alias("two")).agg(F.count("*").alias("n")).filter(F.col("n") > top)
    alike = largest.withColumn("two", two).join(alike, ["zid", "two"], "left_semi")
    begins = F.transform(F.sequence(F.lit(2), F.size("largest")), lambda n: F.slice("largest", 1, n))
    begins = alike.select("zid", "itemcode", F.explode(begins).alias("skipped"))
    crowded = begins.groupBy("zid", "skipped").agg(F.count("*").alias("n")).filter(F.col("n") > top)
    longest = begins.join(crowded, ["zid", "skipped"], "left_semi").groupBy("zid", "itemcode").agg(
        F.max(F.struct(F.size("skipped"), "skipped")).alias("longest"))
    return largest.join(longest, ["zid", "itemcode"], "left").select(
        "zid", "itemcode", F.coalesce(F.col("longest.skipped"), F.slice("largest", 1, 1)).alias("skipped"))


def leading_items(rows: DataFrame, skipped: DataFrame, top: int = TOP) -> DataFrame:
    """The first codes of the items that are in all of the skipped vouchers: (zid, skipped, other)."""
    last = skipped.select("zid", "skipped").distinct().withColumn("voucher", F.element_at("skipped", -1))
    inside = last.join(rows, ["zid", "voucher"]).select("zid", "skipped", F.col("itemcode").alias("other"))
    # One of several vouchers says nothing about the others.
    asked = inside.filter(F.size("skipped") > 1).withColumn("voucher", F.explode("skipped"))
    in_all = asked.join(rows.withColumnRenamed("itemcode", "other"), ["zid", "voucher", "other"]).groupBy("zid", "skipped", "other").agg(
        F.count("*").alias("n")).filter(F.col("n") == F.size("skipped")).drop("n")
    found = inside.filter(F.size("skipped") == 1).unionByName(in_all)
    return top_k_per_group(found, ["zid", "skipped"], [F.asc("other")], top + 1).drop("rank")


def met_pairs(rows: DataFrame, skipped: DataFrame, block: int = BLOCK) -> DataFrame:
    """(zid, itemcode, other), itemcode < other, for each voucher that holds both and is not skipped by both. Items that are
    not listed in ``skipped`` skip none.

    The items that don't skip a voucher are dealt into blocks of about ``block``, each of which meets the whole voucher: a large
    voucher is work for many tasks.
    """
    skips = F.coalesce(F.array_contains("skipped", F.col("voucher")), F.lit(False))
    rows = rows.join(skipped, ["zid", "itemcode"], "left").select("zid", "voucher", "itemcode", (~skips).alias("asks"))
    blocks = rows.groupBy("zid", "voucher").agg(F.ceil(F.count_if("asks") / block).cast("int").alias("blocks")).filter("blocks > 0")
    rows = rows.join(blocks, ["zid", "voucher"])
    asking = rows.filter("asks").select("zid", "voucher", "itemcode", F.pmod(F.xxhash64("itemcode"), F.col("blocks")).cast("int").alias("part"))
    present = rows.select(
        "zid", "voucher", F.col("itemcode").alias("other"), "asks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    # Two that both ask meet once.
    met = asking.join(present, ["zid", "voucher", "part"]).filter(
        (F.col("itemcode") < F.col("other")) | ((F.col("itemcode") > F.col("other")) & ~F.col("asks")))
    return met.select("zid", F.least("itemcode", "other").alias("itemcode"), F.greatest("itemcode", "other").alias("other"))


def listed_pairs(rows: DataFrame) -> DataFrame:
    """(zid, itemcode, other), itemcode < other, for each voucher that holds both; the vouchers are short."""
    listed = rows.groupBy("zid", "voucher").agg(F.sort_array(F.collect_list("itemcode")).alias("items"))
    ahead = listed.filter(F.size("items") > 1).select("zid", "items", F.posexplode("items").alias("place", "itemcode"))
    return ahead.select("zid", "itemcode", F.explode(F.slice("items", F.col("place") + 2, F.size("items"))).alias("other"))


def shared_vouchers(rows: DataFrame, large: DataFrame, skipped: DataFrame, block: int = BLOCK) -> DataFrame:
    """(zid, itemcode, other, shared), both ways, of pairs that meet in a voucher which one of them doesn't skip."""
    short = listed_pairs(rows.join(large, ["zid", "voucher"], "left_anti"))
    long = met_pairs(rows.join(large, ["zid", "voucher"], "left_semi"), skipped, block)
    counted = short.unionByName(long).groupBy("zid", "itemcode", "other").agg(F.count("*").alias("n"))
    theirs = skipped.select("zid", F.col("itemcode").alias("other"), F.col("skipped").alias("other_skipped"))
    both = counted.join(skipped, ["zid", "itemcode"], "left").join(theirs, ["zid", "other"], "left")
    # What both skip holds both, and was not counted.
    shared = F.col("n") + F.coalesce(F.size(F.array_intersect("skipped", "other_skipped")), F.lit(0))
    one, back = F.struct("itemcode", "other"), F.struct(F.col("other").alias("itemcode"), F.col("itemcode").alias("other"))
    return both.select("zid", F.inline(F.array(one, back)), shared.alias("shared"))


def top_associates(presence: DataFrame, block: int = BLOCK, top: int = TOP, depth: int = DEPTH, large: int = LARGE) -> DataFrame:
    """The ``top`` items most often found with each item: (zid, itemcode, other, shared, rank).

    Ties, and places left over when an item has too few companions, go by item code. A search with bounds: an item
    meets its companions in all but its largest vouchers, of those with more than ``large`` items. Whoever it meets only there has all of them in common at most, so that
    the first codes found in all of them are the only ones that matter.
    """
    rows = cut_lineage(presence.filter("present").select("zid", "voucher", "itemcode"))
    # Stored, so that their size is known: mostly there are few large vouchers or none, and what joins them is no exchange.
    vouchers = cut_lineage(large_vouchers(rows, large).select("zid", "voucher"))
    skipped = cut_lineage(skipped_vouchers(rows.join(vouchers, ["zid", "voucher"], "left_semi"), top, depth, large))
    order = [F.desc("shared"), F.asc("other")]
    # Stored: the pairs that were exchanged for the few that stay are gone before anything else is exchanged.
    met = cut_lineage(top_k_per_group(shared_vouchers(rows, vouchers, skipped, block), ["zid", "itemcode"], order, top).drop("rank"), "met")
    leading = skipped.join(leading_items(rows, skipped, top), ["zid", "skipped"]).select(
        "zid", "itemcode", "other", F.size("skipped").cast("long").alias("shared"))

    # The first codes of the company fill up with support 0.
    universe = item_counts(presence)
    first_codes = top_k_per_group(
        universe.select("zid", F.col("itemcode").alias("other")), ["zid"], [F.asc("other")], top + 1)
    fill_lists = stored_figure(first_codes.groupBy("zid").agg(F.sort_array(F.collect_list("other")).alias("others")))
    filling = universe.filter("vouchers > 0").join(fill_lists, "zid").select(
        "zid", "itemcode", F.explode("others").alias("other"), F.lit(0).cast("long").alias("shared"))
    candidates = (
        met.unionByName(leading).unionByName(filling).filter(F.col("itemcode") != F.col("other"))
        .groupBy("zid", "itemcode", "other").agg(F.max("shared").alias("shared"))
    )
    return cut_lineage(top_k_per_group(candidates, ["zid", "itemcode"], order, top), "associates")


def _support(associates: DataFrame, counts: DataFrame) -> DataFrame:
    return associates.join(counts, ["zid", "itemcode"]).withColumn(
        "support", numeric.ratio(F.col("shared"), F.col("vouchers")))


def _side_by_side(ranked: DataFrame, columns: dict[str, str], digits: int) -> DataFrame:
    """The ranked companions of an item, at most TOP, as numbered columns of one row."""
    best = F.sort_array(F.collect_list(F.struct("rank", *columns.values())))
    report = ranked.groupBy("zid", "itemcode").agg(best.alias("best"))
    slots = []
    for k in range(1, TOP + 1):
        slot = F.get("best", F.lit(k - 1))
        for name, source in columns.items():
            value = slot[source]
            slots.append((numeric.half_even(value, digits) if source == "support" else value).alias(name.format(k)))
    return report.select("zid", "itemcode", *slots)


def purchase_basket(receipts: DataFrame, names: DataFrame | None = None, digits: int = 4, block: int = BLOCK) -> DataFrame:
    """Per received item: its five most frequent companions and the share of its receipts they
    are in, and the number of its receipts. ``names`` is an item table; without it the receipts name the items."""
    items = voucher_items(receipts, "grnvoucher")
    presence = item_presence(items)
    counts = item_counts(presence)
    ranked = _support(top_associates(presence, block), counts)
    report = _side_by_side(ranked, {"item_{}": "other", "support_{}": "support"}, digits)
    return (
        counts.join(item_names(receipts if names is None else names), ["zid", "itemcode"])
        .join(report, ["zid", "itemcode"], "left")
        .withColumnRenamed("vouchers", "purchase_count"))


def sales_basket(sales: DataFrame, stock: DataFrame | None = None, names: DataFrame | None = None, digits: int = 4,
                 block: int = BLOCK) -> DataFrame:
    """Per sold item: five companions with name, share and sales, the sales of all six, and the
    stock on hand. ``names`` is an item table; without it the sales name the items."""
    items = voucher_items(sales, "voucher")
    presence = item_presence(items)
    counts = item_counts(presence)
    facts = cut_lineage(items.groupBy("zid", "itemcode").agg(F.sum("totalsales").alias("item_sales")).join(
        item_names(sales if names is None else names), ["zid", "itemcode"], "left").select(
        "zid", "itemcode", "itemname", "item_sales"))
    ranked = _support(top_associates(presence, block), counts)
    companions = facts.select(
        "zid", F.col("itemcode").alias("other"), F.col("itemname").alias("other_name"),
        F.col("item_sales").alias("other_sales"))
    ranked = ranked.join(companions, ["zid", "other"])
    report = _side_by_side(ranked, {
        "item_{}": "other", "item_{}_name": "other_name", "support_{}": "support", "item_{}_sales": "other_sales"}, digits)
    listed = counts.select("zid", "itemcode")
    result = facts.join(listed, ["zid", "itemcode"]).join(report, ["zid", "itemcode"], "left")
    sales_columns = [f"item_{k}_sales" for k in range(1, TOP + 1)]
    result = result.fillna(0, sales_columns)
    total = sum((F.col(c) for c in sales_columns), F.col("item_sales"))
    result = result.withColumn("total_sales_all_items", total)
    if stock is not None:
        on_hand = cut_lineage(stock.select("zid", "itemcode", "stockqty"), "stock")
        result = result.join(on_hand, ["zid", "itemcode"], "left")
    return decimal_to_double(result)


def basket_matrix(sales: DataFrame, rows: int = 100, block: int = BLOCK) -> DataFrame:
    """Non-zero cells of the support matrix between the ``rows`` items of highest mean support.

    An item's row holds the support of its five companions; the mean is over all items.
    """
    presence = item_presence(voucher_items(sales.drop("totalsales"), "voucher"))
    counts = item_counts(presence)
    # Five rows to an item, read for the row sums and for the cells: the pairs behind them are counted once.
    cells = cut_lineage(_support(top_associates(presence, block), counts).filter(F.col("support") > 0), "cells")
    row_sums = cells.groupBy("zid", "itemcode").agg(F.sum("shared").alias("shared"), F.first("vouchers").alias("vouchers"))
    # Items without any companion have mean 0 and compete for the last places.
    items = counts.select("zid", "itemcode").join(row_sums, ["zid", "itemcode"], "left").select(
        "zid", "itemcode", F.coalesce(numeric.ratio(F.col("shared"), F.col("vouchers")), F.lit(0.0)).alias("support_sum"))
    chosen = top_k_per_group(items, ["zid"], [F.desc("support_sum"), F.asc("itemcode")], rows)
    size = counts.groupBy("zid").agg(F.count("*").alias("all_items"))
    chosen = chosen.join(size, "zid").select(
        "zid", "itemcode", (F.col("support_sum") / F.col("all_items")).alias("mean_support"))
    columns = chosen.select("zid", F.col("itemcode").alias("other"))
    return cells.join(chosen, ["zid", "itemcode"]).join(columns, ["zid", "other"]).select(
        "zid", "itemcode", "other", numeric.half_even(F.col("support"), 4).alias("support"),
        numeric.half_even(F.col("mean_support"), 8).alias("mean_support"))
