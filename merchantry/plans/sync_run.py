"""The synchronisation run over all tables: ERP tables in, the analytical tables' new content out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.operators import sync
from merchantry.session import RELEASED, TOGETHER, cut_lineage, settings
from merchantry.sources import commits, erp

# Change times as the ERP names them, and as the analytical tables do.
ERP_TIMES = {"ztime": "itime", "zutime": "utime"}
BEFORE_ALL = "0001-01-01 00:00:00"


@dataclass(frozen=True)
class Followed:
    """How a table follows the ERP, document by document.

    ``reads`` names the ERP tables in the order ``extract`` takes them, each with its column that holds the
    document's number; the first is the header, where documents are looked up that never arrived. ``number`` is
    the same column in the analytical table. ``columns`` names what ``extract`` needs of a table that has much more.
    """
    extract: Callable[..., DataFrame]
    reads: Mapping[str, str]
    number: str
    columns: Mapping[str, Sequence[str]] = field(default_factory=dict)


def _master(table: str, number: str) -> Followed:
    return Followed(lambda rows: erp.renamed(rows, table), {table: number}, erp.RENAMES[table][number])


def _without_times(extract: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    # A header without lines has no company, so it belongs to no document.
    return lambda *tables: extract(*tables, together=True).drop(*erp.TRAILING_TIMES).filter(F.col("zid").isNotNull())


MOVED = {"imtrn": ["zid", "xdocnum", "xitem", "xval", "ztime", "zutime"]}

# Tables and the columns that hold a document's number.
FOLLOWED = {
    "glmst": _master("glmst", "xacc"),
    "gldetail": _master("gldetail", "xvoucher"),
    "glheader": _master("glheader", "xvoucher"),
    "purchase": Followed(erp.etl_purchase, {"poord": "xpornum", "poodt": "xpornum", "pogrn": "xpornum"}, "povoucher"),
    "sales": Followed(_without_times(erp.etl_sales), {"opdor": "xdornum", "opddt": "xdornum", "imtrn": "xdocnum"}, "ordernumber", MOVED),
    "return": Followed(_without_times(erp.etl_return), {"opcrn": "xcrnnum", "opcdt": "xcrnnum", "imtrn": "xdocnum"}, "revoucher", MOVED),
    "cacus": _master("cacus", "xcus"),
    "caitem": _master("caitem", "xitem"),
    "employee": _master("prmst", "xemp"),
}
# Totals without change times: taken anew as a whole.
REFRESHED = {"stock": erp.etl_stock, "stock_value": erp.etl_stock_value}


def _numbered(rows: DataFrame, number: str) -> DataFrame:
    return rows.select("zid", F.col(number).alias("number"))


def source_marks(sources: Mapping[str, DataFrame]) -> dict[str, dict[str, str | None]]:
    """The latest insert and update time of each ERP table, as text. Tables without such times are left out."""
    rows = sync.watermarks({name: rows.withColumnsRenamed(ERP_TIMES) for name, rows in sources.items()})
    named = rows.select("table_name", *[F.col(c).cast("string") for c in ERP_TIMES.values()])
    return {r["table_name"]: {c: r[c] for c in ERP_TIMES.values()} for r in named.collect()}


def documents_to_fetch(followed: Followed, sources: Mapping[str, DataFrame], target: DataFrame,
                       marks: Mapping[str, Mapping[str, str | None]] | None = None) -> DataFrame:
    """(zid, number) of each document of which any row, in any of the tables read, was created or changed since that
    table's mark, and of each that the header table holds and the target does not.

    ``marks`` are the ``source_marks`` of the last run; a table that they don't know is new, so all of its rows count. Without marks
    the target's own watermark stands in for every table. Rows at the mark itself count too: another change may have
    come at that very time. A table that has rows but no update time yet has seen no update, so each one counts.
    """
    if marks is None:
        own = target.agg(F.max("itime").cast("string").alias("itime"), F.max("utime").cast("string").alias("utime")).first()
        marks = dict.fromkeys(followed.reads, own.asDict())
    found = []
    for table, number in followed.reads.items():
        rows = sources[table]
        times = {theirs: ours for theirs, ours in ERP_TIMES.items() if theirs in rows.columns}
        if times:
            timed = rows.select("zid", F.col(number).alias("number"), *[F.col(c).alias(n) for c, n in times.items()])
            mark = marks.get(table, {})
            earliest = BEFORE_ALL if any(mark.values()) else None
            since = {ours: mark.get(ours) or earliest if ours in times.values() else None for ours in ERP_TIMES.values()}
            found.append(sync.changed_since(timed, **since, inclusive=True).select("zid", "number"))
    header, number = next(iter(followed.reads.items()))
    found.append(sync.missing_rows(_numbered(sources[header], number), _numbered(target, followed.number), ["zid", "number"]))
    return reduce(lambda a, b: a.unionByName(b), found).distinct()


def _extracted(followed: Followed, sources: Mapping[str, DataFrame], wanted: DataFrame) -> DataFrame:
    """The documents made anew from their rows alone."""
    parts = [
        rows.join(wanted.withColumnRenamed("number", number), ["zid", number], "left_semi")
        for rows, number in ((sources[table], number) for table, number in followed.reads.items())]
    return followed.extract(*parts)


def stored_documents(rows: DataFrame) -> DataFrame:
    """Extracted documents, whose rows are exchanged once: by document."""
    with settings(rows.sparkSession, TOGETHER):
        return cut_lineage(rows, "fetched")


def sync_table(name: str, sources: Mapping[str, DataFrame], target: DataFrame,
               marks: Mapping[str, Mapping[str, str | None]] | None = None) -> DataFrame:
    """The table's new content. Each document to fetch is extracted anew from its rows alone and takes the place of
    what the target holds of it, so a change in header, line or movement arrives, lines that are gone
    leave, and a second run changes nothing. Rows without company or number belong to no document and stay as they are."""
    if name in REFRESHED:
        return REFRESHED[name](sources["imtrn"]).select(target.columns)
    followed = FOLLOWED[name]
    wanted = documents_to_fetch(followed, sources, target, marks)
    if len(followed.reads) > 1:
        # Stored step by step: what one step exchanged is gone before the next one begins.
        wanted = cut_lineage(wanted, "documents")
        fresh = stored_documents(_extracted(followed, sources, wanted).select(target.columns))
    else:
        fresh = _extracted(followed, sources, wanted)
    kept = target.join(wanted.withColumnRenamed("number", followed.number), ["zid", followed.number], "left_anti")
    return kept.select(target.columns).unionByName(fresh.select(target.columns))


def _same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same rows, each as often, from one exchange of them."""
    sided = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(-1)))
    with settings(a.sparkSession, RELEASED):
        return sided.groupBy(*a.columns).agg(F.sum("_side").alias("_more")).filter(F.col("_more") != 0).isEmpty()


def _changed_content(followed: Followed, sources: Mapping[str, DataFrame], target: DataFrame,
                     marks: Mapping[str, Mapping[str, str | None]]) -> DataFrame | None:
    """The table's new content, or None where the documents fetched are those that the target holds already."""
    wanted = cut_lineage(documents_to_fetch(followed, sources, target, marks), "documents")
    of_target = wanted.withColumnRenamed("number", followed.number)
    fresh = stored_documents(_extracted(followed, sources, wanted).select(target.columns))
    held = target.join(of_target, ["zid", followed.number], "left_semi").select(target.columns)
    if _same_rows(fresh, held):
        return None
    return target.join(of_target, ["zid", followed.number], "left_anti").select(target.columns).unionByName(fresh)


def run_logged(sources: Mapping[str, DataFrame], folder: str, tables: Sequence[str] = (*FOLLOWED, *REFRESHED),
               adopt: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """One run with a log entry: brings ``tables`` below ``folder`` up to date and returns them.

    The marks are each ERP table's own, taken before its rows are read: what arrives meanwhile is read again next time. So a
    header changed before the newest line known, but after the last run, arrives with this one. All tables become visible with the
    entry; a run that ends early is repeated from the entry before. A table without changes keeps its version. A table that the log
    does not know is extracted as a whole, or follows its own watermark if ``adopt`` has it. Name the same
    tables in each run: an entry's marks hold for all tables in it. Naming fewer than the last entry holds is an error.
    """
    spark = next(iter(sources.values())).sparkSession
    last = commits.last_commit(spark, folder)
    left_out = set(last.versions) - set(tables)
    if left_out:
        raise ValueError(f"tables of the last run are left out, and would miss changes: {sorted(left_out)}")
    needed = {table for name in tables if name in FOLLOWED for table in FOLLOWED[name].reads}
    needed |= {"imtrn"} if set(tables) & set(REFRESHED) else set()
    marks = source_marks({table: sources[table] for table in sorted(needed)})
    versions = {}
    for name in tables:
        known = last.versions.get(name)
        if name in REFRESHED:
            content = REFRESHED[name](sources["imtrn"])
        elif known:
            content = _changed_content(FOLLOWED[name], sources, commits.read_version(spark, folder, known), last.marks)
        elif adopt and name in adopt:
            content = sync_table(name, sources, adopt[name])
        else:
            content = FOLLOWED[name].extract(*[sources[table] for table in FOLLOWED[name].reads])
        with settings(spark, TOGETHER if name in FOLLOWED else {}):
            versions[name] = known if content is None else commits.write_version(content, folder, name)
    commits.publish(spark, folder, commits.Commit(last.number + 1, marks, versions))
    return {name: commits.read_version(spark, folder, version) for name, version in versions.items()}


def sync_all(sources: Mapping[str, DataFrame], targets: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """New content of all eleven tables; write each beside the old one (sinks.full_refresh)."""
    return {name: sync_table(name, sources, targets[name]) for name in [*FOLLOWED, *REFRESHED]}
