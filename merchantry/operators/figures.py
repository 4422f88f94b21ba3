"""Figures of which there is one row for a company or group."""

from __future__ import annotations

from pyspark.sql import DataFrame

from merchantry.session import cut_lineage


def stored_figure(df: DataFrame) -> DataFrame:
    """The figure computed once into a table, so that every join with it knows its size in bytes.

    Joining facts with one row per company by a shuffle on the company is what a hot company makes slow. A
    table's size is known: the engine broadcasts it up to its own threshold, and splits hot companies beyond it.
    """
    return cut_lineage(df, "figure")
