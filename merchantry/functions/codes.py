"""Expressions over item and voucher codes."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Voucher prefixes and order states that select each kind of posting.
COLLECTION_PREFIXES = ["JV--", "RCT-", "CRCT", "STJV", "BRCT"]
PAYMENT_PREFIXES = ["CPAY", "BPAY", "STJV"]
PURCHASE_PREFIX = "IP--"
PURCHASE_STATES = ["5-Received", "1-Open"]
NO_PACKCODE = ["", "NO"]
STOCK_KEEPS_OWN_CODE_PREFIX = "KH"


def has_prefix(code: Column, prefixes: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [code.startswith(p) for p in prefixes])


def packcode_or_item(packcode: Column, itemcode: Column, excluded_prefix: str | None = None) -> Column:
    """The pack code stands for the item unless it is missing, blank, 'NO' or excluded."""
    usable = packcode.isNotNull() & ~packcode.isin(NO_PACKCODE)
    if excluded_prefix:
        usable = usable & ~packcode.startswith(excluded_prefix)
    return F.when(usable, packcode).otherwise(itemcode)


def id_and_name(identifier: Column, name: Column) -> Column:
    return F.concat(identifier.cast("string"), F.lit(" - "), name)
