"""Line dedup: lines that spread over many sites are boilerplate and go.

Each distinct line gets a HyperLogLog sketch of its sites, built per task and merged by the aggregation, so
no list of sites travels. A line whose estimate is clearly under or over the threshold is decided by the
sketch; within the error band the distinct sites are counted exactly. Then every occurrence of a line of
too many sites is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.llm.common import table
from merchantry.session import cut_lineage

#: A sketch has 2**LG_K registers; its relative standard error is 1.04 / sqrt(2**LG_K).
LG_K = 12
#: Estimates within so many standard errors of the threshold, and half a site, are counted exactly.
ERRORS = 6
BLANKS = " \t\r\x0b\x0c"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _hashes(line: Column) -> list[Column]:
    """128 bits in two columns."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit(1)).alias("h2")]


def spread_lines(lines: DataFrame, most_sites: int) -> DataFrame:
    """(h1, h2) of the lines on more than ``most_sites`` sites. lines: (h1, h2, site)."""
    error = ERRORS * 1.04 / (1 << LG_K) ** 0.5
    low, high = (most_sites + 0.5) * (1 - error) - 0.5, (most_sites + 0.5) * (1 + error) + 0.5
    # A line found fewer times than the band begins can't be on so many sites, whatever its sketch says.
    rated = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.count("*").alias("n")).where(F.col("n") > most_sites)
    rated = cut_lineage(rated.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= low), "rated")
    near = rated.where(F.col("sites") <= high).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("sites"))
    return rated.where(F.col("sites") > high).select("h1", "h2").unionByName(exact.where(F.col("sites") > most_sites).select("h1", "h2"))


def line_dedup(docs: DataFrame, most_sites: int = 8, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, text.

    Lines are compared without blanks at their ends; blank lines are not counted and stay. A null text
    is empty; rows without a site share one site of their own; rows with equal id and text are treated alike
    and all returned; further columns are not looked at; an empty table gives an empty result."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    rows = rows.withColumn("body_key", F.xxhash64("body", F.length("body")))
    every = rows.select("id", "body_key", "site", F.posexplode(F.split("body", r"\n")).alias("at", "line")).withColumn("line", _trimmed(F.col("line"))).where("line <> ''")
    lines = cut_lineage(every.select("id", "body_key", "site", "at", *_hashes(F.col("line"))), "lines")
    wide = cut_lineage(spread_lines(lines.select("h1", "h2", "site"), most_sites), "spread")
    gone = lines.join(wide, ["h1", "h2"]).groupBy("id", "body_key").agg(F.collect_set("at").alias("gone"))
    joined = rows.alias("r").join(gone.alias("g"), [F.col("r.id").eqNullSafe(F.col("g.id")), F.col("r.body_key") == F.col("g.body_key")], "left")
    kept = F.filter(F.split("body", r"\n"), lambda line, i: ~F.array_contains(F.col("gone"), i))
    return joined.select(
        F.col("r.id").alias("doc_id"), F.size(F.filter(F.split("body", r"\n"), lambda line: _trimmed(line) != "")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )


def op4_line_dedup(spark, sf_dir):
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


SQL = r"""
WITH cut AS (SELECT doc_id, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
every AS (SELECT doc_id, site, trim(unnest(lines), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM cut),
wide AS (SELECT line FROM every WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) > 8),
gone AS (SELECT list(line) AS gone FROM wide),
kept AS (SELECT doc_id, lines, coalesce(gone, []) AS gone,
  list_filter(lines, lambda l: NOT list_contains(coalesce(gone, []), trim(l, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))) AS kept FROM cut, gone)
SELECT doc_id, len(list_filter(lines, lambda l: trim(l, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> '')) AS n_lines, len(lines) - len(kept) AS n_removed,
  length(array_to_string(kept, chr(10))) AS n_chars, sha256(array_to_string(kept, chr(10))) AS text_sha256
FROM kept
"""
