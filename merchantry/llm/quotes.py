"""Chat formatting: link quotations to the messages they come from.

The lines of a message are parsed into quote levels. For each level the whole passage, and each of its lines,
is normalised and hashed; so are the whole and the lines of what each message says itself. A quoted hash
joins the latest earlier message of the conversation that holds it, the best joined message is the one
replied to, and pointer jumping over the replies gives each message its thread and depth. What comes out
is each conversation in reply order, without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantry.llm.common import table
from merchantry.session import cut_lineage

#: Turns of a conversation that one window partition may hold.
SPAN = 4096
BLANK = r"[\x20\x09-\x0D]+"
PREFIX = r"^([\x20\x09]*>)+"


def _normal(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(low, BLANK, " "), "^ | $", "")


def parsed(text: Column) -> Column:
    """(level, line) of each line: the number of quote marks before it, and the rest."""
    def one(line: Column) -> Column:
        head = F.regexp_substr(line, F.lit(PREFIX))
        level = F.coalesce(F.length(F.regexp_replace(head, "[^>]", "")), F.lit(0))
        return F.struct(level.alias("level"), F.when(level > 0, F.regexp_replace(F.regexp_replace(line, PREFIX, ""), "^ ", "")).otherwise(line).alias("line"))
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\n"), one)


def _at(level: Column) -> Column:
    return F.transform(F.filter("parsed", lambda p: p["level"] == level), lambda p: p["line"])


def _units(rows: DataFrame, level: Column) -> DataFrame:
    """Hashes of the whole passage of a level and of its lines, blank ones left out."""
    lines = _at(level)
    every = F.array_distinct(F.filter(F.transform(F.concat(F.array(F.array_join(lines, " ")), lines), _normal), lambda u: u != ""))
    rows = rows.select("conv_id", "turn", level.alias("level"), F.explode(every).alias("unit"))
    return rows.select("conv_id", "turn", "level", F.xxhash64("unit").alias("h1"), F.xxhash64("unit", F.lit(1)).alias("h2"), F.length("unit").cast("long").alias("size"))


def latest_before(asked: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """asked with ``parent``: the greatest turn of held that is less than its own, by keys.

    Turns go in spans: a window sees one span, and what the spans before end with comes from a second
    window over one row a span, so that no key puts all its rows into one task."""
    span = F.floor(F.col("turn") / SPAN).alias("span")
    marks = held.select(*keys, F.col("turn").alias("own"), "turn", F.lit(1).alias("kind"), span)
    both = asked.withColumn("own", F.lit(None).cast("long")).withColumn("kind", F.lit(0)).withColumn("span", span).unionByName(marks, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "span").orderBy("turn", "kind").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("near", F.max("own").over(inside)).where("kind = 0")
    ends = both.select(*keys, "span").distinct().withColumn("last", F.lit(None).cast("long")).unionByName(marks.groupBy(*keys, "span").agg(F.max("own").alias("last")))
    ends = ends.groupBy(*keys, "span").agg(F.max("last").alias("last"))
    before = Window.partitionBy(*keys).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("far", F.max("last").over(before)).drop("last")
    return both.join(ends, [*keys, "span"], "left").withColumn("parent", F.coalesce("near", "far")).drop("own", "kind", "span", "near", "far").where("parent IS NOT NULL")


def replies(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent): the message replied to. messages: (conv_id, turn, parsed).

    Of the messages that quoted units come from, the least quote level counts first, then the most
    quoted characters, then the latest turn."""
    quoting = messages.where(F.exists("parsed", lambda p: p["level"] > 0))
    levels = quoting.withColumn("lv", F.explode(F.array_distinct(F.filter(F.transform("parsed", lambda p: p["level"]), lambda v: v > 0))))
    asked = cut_lineage(_units(levels, F.col("lv")), "quoted")
    keys = ["conv_id", "h1", "h2"]
    held = _units(messages, F.lit(0)).join(asked.select(*keys).distinct(), keys, "left_semi").select(*keys, "turn").distinct()
    met = latest_before(asked, held, keys)
    scored = met.groupBy("conv_id", "turn", "parent", "level").agg(F.sum("size").alias("size"))
    best = F.max(F.struct(-F.col("level"), "size", "parent")).alias("best")
    return scored.groupBy("conv_id", "turn").agg(best).select("conv_id", "turn", F.col("best.parent").alias("parent"))


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, thread, depth): where the chain of replies ends, and how long it is.

    Each round doubles how far a message sees, so a chain of n replies takes log2(n) rounds."""
    state = cut_lineage(links.select("conv_id", "turn", "parent", F.col("parent").alias("thread"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        moved = state.join(up, ["conv_id", "thread"], "left")
        state = cut_lineage(moved.select("conv_id", "turn", "parent", F.coalesce("next", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "threads")
        if not state.where("moved").head(1):
            return state.drop("moved")


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with ``place``, 0 for the first of each group. The rows are sorted over all partitions, each
    counts its own rows, and groups that several partitions share get the counts before them added."""
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = cut_lineage(dealt.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()), "placed")
    ends = dealt.groupBy("part", group).agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", F.col(group).alias("own_group"), "first", "earlier")
    out = dealt.join(ends, [dealt["part"] == ends["part"], dealt[group].eqNullSafe(F.col("own_group"))])
    return out.withColumn("place", F.col("nth") - F.col("first") + F.col("earlier")).drop("part", "nth", "first", "earlier", "own_group")


def linked_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, reply_to, thread, depth, place, body.

    reply_to is the turn replied to (null: none), thread the turn that its chain of replies begins with
    (its own if it replies to none), depth the length of the chain, body the message without quoted lines. place
    orders a conversation: by thread, then depth, then turn, so that a reply follows what it answers. A null
    text is empty; messages without conversation or turn are linked with nothing and stay; rows with
    one conversation and turn share their links and are all returned, ordered by role and body; an empty
    table gives an empty result; further columns are not looked at."""
    rows = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), parsed(F.col(text_col)).alias("parsed"))
    links = threads(replies(rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "parsed")))
    out = rows.select("conv_id", "turn", "role", F.array_join(_at(F.lit(0)), "\n").alias("body")).join(links, ["conv_id", "turn"], "left")
    out = out.select("conv_id", "turn", "role", F.col("parent").alias("reply_to"), F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "body")
    return placed(out, "conv_id", ["thread", "depth", "turn", "role", "body"]).select("conv_id", "turn", "role", "reply_to", "thread", "depth", "place", "body")


def op10_quotation_links(spark, sf_dir):
    return linked_conversations(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH RECURSIVE lines AS (
  SELECT r, conv_id, turn, role, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nth
  FROM (SELECT *, row_number() OVER () AS r FROM conversations)),
parsed AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^([\x20\x09]*>)+'), '[^>]', '', 'g')) AS level,
    CASE WHEN regexp_matches(line, '^([\x20\x09]*>)+') THEN regexp_replace(regexp_replace(line, '^([\x20\x09]*>)+', ''), '^ ', '') ELSE line END AS said FROM lines),
units AS (
  SELECT DISTINCT conv_id, turn, level, regexp_replace(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g') AS unit
  FROM (SELECT conv_id, turn, level, said AS unit FROM parsed UNION ALL SELECT conv_id, turn, level, string_agg(said, ' ' ORDER BY nth) FROM parsed GROUP BY r, conv_id, turn, level)),
met AS (
  SELECT q.conv_id, q.turn, q.level, q.unit, max(o.turn) AS parent FROM units q JOIN units o ON o.conv_id = q.conv_id AND o.unit = q.unit AND o.turn < q.turn
  WHERE q.level > 0 AND o.level = 0 AND q.unit <> '' GROUP BY ALL),
scored AS (SELECT conv_id, turn, parent, level, sum(length(unit)) AS size FROM met GROUP BY ALL),
links AS (SELECT conv_id, turn, parent FROM scored QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, size DESC, parent DESC) = 1),
up AS (
  SELECT conv_id, turn, parent, parent AS thread, 1 AS depth FROM links
  UNION ALL SELECT u.conv_id, u.turn, u.parent, l.parent, u.depth + 1 FROM up u JOIN links l ON l.conv_id = u.conv_id AND l.turn = u.thread),
chains AS (SELECT conv_id, turn, parent, min(thread) AS thread, max(depth) AS depth FROM up GROUP BY ALL),
bodies AS (SELECT conv_id, turn, role, coalesce(string_agg(said, chr(10) ORDER BY nth) FILTER (WHERE level = 0), '') AS body FROM parsed GROUP BY conv_id, turn, role, r),
joined AS (SELECT b.conv_id, b.turn, b.role, c.parent AS reply_to, coalesce(c.thread, b.turn) AS thread, coalesce(c.depth, 0) AS depth, b.body FROM bodies b LEFT JOIN chains c ON c.conv_id = b.conv_id AND c.turn = b.turn)
SELECT conv_id, turn, role, reply_to, thread, depth, row_number() OVER (PARTITION BY conv_id ORDER BY thread, depth, turn, role, body) - 1 AS place, body FROM joined
"""
