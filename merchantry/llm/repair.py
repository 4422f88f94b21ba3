"""Conversation structure repair: Knuth's lightest derivation over weighted deductions.

A repair is derived from row items and prefix items: Prefix(i, state) says that the first i rows are repaired so that
the roles so far lead to that state of the grammar. Prefix(i, state) and Row(i) together deduce Prefix(i + 1, state'), by keeping,
reroling or deleting the row; Prefix(i, state) alone deduces another one by an insertion. An item's value is (cost, audit);
each rule's value never falls below those of what it is deduced from and rises with them, so the agenda pops items in the order of
their final values and stops once the goals are popped.

A conversation of any length is cut into segments, which one range sort deals to tasks; a segment's lightest derivations
from each state to each state are the rules that a sorted pass over its conversation's segments joins up, hashing the repaired text on
the way. No task holds a whole conversation's texts.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.llm.common import prepare, table, tidied
from merchantry.session import cut_lineage

#: A segment ends after so many rows or bytes of text.
SEGMENT_ROWS, SEGMENT_BYTES = 1024, 1 << 18
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a; and where a role's initial leads.
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
STEPS = {(NOTHING, "s"): AFTER_S, (NOTHING, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
COMPLETE = (NOTHING, AFTER_A)
#: The one role that an edit can give in a state.
GIVEN = {NOTHING: "user", AFTER_S: "user", AFTER_U: "assistant", AFTER_A: "user"}
FOLLOWS = {"su", "ua", "au"}
BLANK, DUPLICATE, CUT, SOUND = "blank", "duplicate", "truncated", ""
_SPACE = r"\x20\x09-\x0D"

Value = tuple[int, str]


# --- lightest derivations -----------------------------------------------------------------------

def lightest(axioms: Iterable[tuple[Hashable, Value]], consequents: Callable[[Hashable, dict], Iterable[tuple[Hashable, Value]]], goals: Iterable[Hashable]) -> dict[Hashable, Value]:
    """Least values of items, until all goals that can be derived have theirs.

    ``consequents`` gives the heads that an item deduces together with items whose values are final (the chart)."""
    chart: dict[Hashable, Value] = {}
    left = set(goals)
    agenda = [(value, item) for item, value in axioms]
    heapq.heapify(agenda)
    while agenda and left:
        value, item = heapq.heappop(agenda)
        if item in chart:
            continue
        chart[item] = value
        left.discard(item)
        for head, one in consequents(item, chart):
            if head not in chart:
                heapq.heappush(agenda, (one, head))
    return chart


def derivations(rows: list[tuple[str, str]], start: int) -> dict[int, Value]:
    """Of rows (role, fault): the least (cost, audit) from a state to each other one."""
    n = len(rows)

    def with_row(i: int, state: int, value: Value) -> Iterator[tuple[Hashable, Value]]:
        role, fault = rows[i]
        cost, audit = value
        yield ("prefix", i + 1, state), (cost + DELETE, audit + "D")
        if fault in (BLANK, DUPLICATE):
            return
        extra = TRUNCATED if fault == CUT else 0
        if (led := STEPS.get((state, role[:1]))) is not None:
            yield ("prefix", i + 1, led), (cost + KEEP + extra, audit + "K")
        yield ("prefix", i + 1, STEPS[state, GIVEN[state][0]]), (cost + REROLE + extra, audit + "R")

    def consequents(item, chart):
        if item[0] == "row":
            for state in range(4):
                if (value := chart.get(("prefix", item[1], state))) is not None:
                    yield from with_row(item[1], state, value)
            return
        _, i, state = item
        cost, audit = value = chart[item]
        yield ("prefix", i, STEPS[state, GIVEN[state][0]]), (cost + INSERT, audit + "I")
        if i < n and ("row", i) in chart:
            yield from with_row(i, state, value)

    axioms = [(("row", i), (0, "")) for i in range(n)] + [(("prefix", 0, start), (0, ""))]
    ends = [("prefix", n, state) for state in range(4) if state != NOTHING or start == NOTHING]
    ends = [e for e in ends if e[2] != AFTER_S or start in (NOTHING, AFTER_S)]
    chart = lightest(axioms, consequents, ends)
    return {e[2]: chart[e] for e in ends if e in chart}


def edited(rows: Iterable[tuple[str, str]], audit: str, state: int) -> Iterator[str]:
    """The repaired ``role:text`` of rows (role, text) under an audit that begins in a state."""
    left = iter(rows)
    for edit in audit:
        role, text = (GIVEN[state], "") if edit == "I" else next(left)
        if edit == "D":
            continue
        if edit == "R":
            role = GIVEN[state]
        state = STEPS[state, role[:1]]
        yield f"{role}:{text}"


# --- rows ---------------------------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present) after planted faults, chosen by crc32 of ``conv_id:turn``; a null counts as
    one space, except that conv_id and turn stay null as keys."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") != 0).alias("present"), times.alias("time")).drop("time")


def faults(rows: DataFrame) -> DataFrame:
    """One row for equal rows: conv_id, turn, role, text, present, copies, fault of the first of them. The others are
    duplicates, or blank like the first."""
    rows = rows.groupBy("conv_id", "turn", "role", "text", "present").agg(F.count("*").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    rows = rows.withColumn("place", place).withColumn("digest", F.sha2("text", 256))
    firsts = rows.where("present").groupBy("conv_id", "role", "digest").agg(F.min("place").alias("first"))
    held, own = rows.alias("r"), firsts.alias("f")
    same = F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.role") == F.col("f.role")) & (F.col("r.digest") == F.col("f.digest"))
    fault = (F.when(~F.col("r.text").rlike(f"[^{_SPACE}]"), BLANK).when(~F.col("r.place").eqNullSafe(F.col("f.first")), DUPLICATE)
             .when(~F.col("r.text").rlike(rf"[.!?][{_SPACE}]*\z"), CUT).otherwise(SOUND))
    return held.join(own, same, "left").select(*[F.col(f"r.{c}") for c in ("conv_id", "turn", "role", "text", "present", "copies")], fault.alias("fault"))


# --- segments -----------------------------------------------------------------------------------

_SEGMENT = ("conv_id long, part int, at long, paths array<struct<start:int,end:int,cost:long,audit:string>>, roles array<string>, texts array<string>, "
            "blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long")
_SEGMENT_TYPE = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()),
    ("paths", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
    *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn")]])


@dataclass
class Segment:
    begins: bool  # surely the first of its conversation
    rows: list[tuple[str, str]] = field(default_factory=list)  # role, fault
    texts: list[str] = field(default_factory=list)
    turns: list[int] = field(default_factory=list)  # known ones, each once
    size: int = 0

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if turn is not None and self.turns[-1:] != [turn]:
            self.turns.append(turn)
        self.rows.append((role, fault))
        self.texts.append(text)
        self.size += len(text)

    def full(self) -> bool:
        return len(self.rows) >= SEGMENT_ROWS or self.size >= SEGMENT_BYTES

    def summary(self, conv: int | None, part: int, at: int) -> dict:
        starts = (NOTHING,) if self.begins else range(4)
        paths = [{"start": s, "end": e, "cost": cost, "audit": audit} for s in starts for e, (cost, audit) in derivations(self.rows, s).items()]
        roles = [r for r, _ in self.rows]
        count = lambda fault: sum(f == fault for _, f in self.rows)
        return {"conv_id": conv, "part": part, "at": at, "paths": paths, "roles": roles, "texts": self.texts, "blank": count(BLANK),
                "duplicate": count(DUPLICATE), "truncated": count(CUT), "illegal": sum(a[:1] + b[:1] not in FOLLOWS for a, b in zip(roles, roles[1:])),
                "turns": len(self.turns), "first_turn": self.turns[0] if self.turns else None, "last_turn": self.turns[-1] if self.turns else None}


@tidied
def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of conversation, turn, role and text as segments with their derivations."""
    part, at, conv, one = TaskContext.get().partitionId(), 0, None, None
    done: list[dict] = []
    for batch in batches:
        for name, turn, role, text, present, copies, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "present", "copies", "fault")), strict=True):
            if one is None or name != conv:
                if one is not None:
                    done.append(one.summary(conv, part, at))
                # The first conversation of a task may have begun in the task before.
                conv, one, at = name, Segment(one is not None), at + 1
            for i in range(copies if present else 0):
                if one.full():
                    done.append(one.summary(conv, part, at))
                    one, at = Segment(False), at + 1
                one.add(turn, role, text, fault if i == 0 or fault == BLANK else DUPLICATE)
            if len(done) >= 64:
                yield pa.RecordBatch.from_pylist(done, schema=_SEGMENT_TYPE)
                done = []
    if one is not None:
        done.append(one.summary(conv, part, at))
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=_SEGMENT_TYPE)


# --- whole conversations ------------------------------------------------------------------------

@dataclass
class Route:
    """The lightest repair so far that ends in a state."""
    cost: int = 0
    audit: str = ""
    digest: object = field(default_factory=hashlib.sha256)
    lines: int = 0

    def extended(self, path: dict, segment: dict) -> Route:
        longer = Route(self.cost + path["cost"], self.audit + path["audit"], self.digest.copy(), self.lines)
        for line in edited(zip(segment["roles"], segment["texts"], strict=True), path["audit"], path["start"]):
            longer.digest.update((("\n" if longer.lines else "") + line).encode())
            longer.lines += 1
        return longer


class Whole:
    """A conversation whose segments arrive in order."""

    def __init__(self):
        self.routes, self.faults, self.illegal, self.tail = {NOTHING: Route()}, dict.fromkeys((BLANK, DUPLICATE, CUT), 0), 0, None
        self.turns, self.least, self.most = 0, None, None

    def add(self, segment: dict) -> None:
        best: dict[int, tuple[Value, dict]] = {}
        for path in segment["paths"]:
            if (route := self.routes.get(path["start"])) is not None:
                value = (route.cost + path["cost"], route.audit + path["audit"])
                if path["end"] not in best or value < best[path["end"]][0]:
                    best[path["end"]] = (value, path)
        self.routes = {end: self.routes[path["start"]].extended(path, segment) for end, (_, path) in best.items()}
        for fault in self.faults:
            self.faults[fault] += segment[fault]
        roles = segment["roles"]
        if roles:
            self.illegal += segment["illegal"] + (self.tail is not None and self.tail + roles[0][:1] not in FOLLOWS)
            self.tail = roles[-1][:1]
        if segment["turns"]:
            self.turns += segment["turns"] - (self.most == segment["first_turn"])
            self.least = segment["first_turn"] if self.least is None else self.least
            self.most = segment["last_turn"]

    def result(self, conv: int | None) -> tuple:
        end = min((self.routes[s] for s in COMPLETE if s in self.routes), key=lambda r: (r.cost, r.audit))
        gaps = 0 if self.least is None else min(self.most - self.least + 1 - self.turns, (1 << 63) - 1)
        return conv, gaps, *self.faults.values(), self.illegal, end.cost, end.audit, end.digest.hexdigest()


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT_TYPES = [*[pa.int64()] * 7, pa.string(), pa.string()]


@tidied
def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, whole, done = None, None, []

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), _RESULT_TYPES, strict=True)], [f.split()[0] for f in _RESULT.split(", ")])

    for batch in batches:
        for segment in batch.to_pylist():
            if whole is None or segment["conv_id"] != conv:
                if whole is not None:
                    done.append(whole.result(conv))
                conv, whole = segment["conv_id"], Whole()
            whole.add(segment)
        if len(done) >= 1024:
            yield rows()
            done = []
    if whole is not None:
        done.append(whole.result(conv))
    if done:
        yield rows()


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conv_id of rows (conv_id, turn, role, text, present): conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256. A row that is not present only names its conversation; further columns are not looked at.

    Rows go by turn, those without one first, then by role and text. The first fault of a row counts: blank (nothing but
    ASCII white space), duplicate (role and text seen earlier in the conversation), truncated (ends without one of . ! ?). The audit is
    the cheapest edits' initials (Keep, Rerole, Delete, Insert) that give role initials (s?(ua)+)?, the least in ASCII among equal
    ones; the hash is over the repaired role:text lines. gaps are missing turn numbers between the least and the greatest.

    A null role or text counts as one space; a null conv_id is a conversation of its own; an empty role can't be kept; repeated rows
    are duplicates; very long texts and conversations are read piece by piece, though the audit of a conversation is one string; a
    conversation without rows has zeros, an empty audit and the hash of nothing; an empty table gives an empty result."""
    prepare(rows.sparkSession)
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), told("role"), told("text"), F.coalesce("present", F.lit(True)).alias("present"))
    order: list[Column | str] = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    dealt = faults(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    segments = cut_lineage(dealt.select("conv_id", "turn", "role", "text", "present", "copies", "fault").mapInArrow(_segments, _SEGMENT), "segments")
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at").mapInArrow(_joined, _RESULT)


def op13_conversation_repair(spark, sf_dir):
    return repaired(damaged(table(spark, sf_dir, "conversations")))


# --- the same rows by a fold over each conversation -----------------------------------------------

def _more(key: str, weight: str, edit: str) -> str:
    """A key is a cost of nine digits and the audit, so that the least key is the cheapest and then the least audit."""
    return f"(CASE WHEN {key} IS NOT NULL THEN lpad(CAST(CAST(left({key}, 9) AS BIGINT) + {weight} AS VARCHAR), 9, '0') || substr({key}, 10) || '{edit}' END)"


_OPEN = "least(a[1], a[2], a[4])"
_INSERTED = f"list_transform([{{}}], lambda a: list_transform([least(a[3], {_more(_OPEN, '2', 'I')})], lambda u: [a[1], a[2], u, least(a[4], {_more('u', '2', 'I')})])[1])[1]"
_ROW = _INSERTED.format(
    f"[{_more('a[1]', '3', 'D')}, least({_more('a[2]', '3', 'D')}, CASE WHEN r.ok AND r.initial = 's' THEN {_more('a[1]', 'r.extra', 'K')} END), "
    f"least({_more('a[3]', '3', 'D')}, CASE WHEN r.ok AND r.initial = 'u' THEN {_more(_OPEN, 'r.extra', 'K')} END, CASE WHEN r.ok THEN {_more(_OPEN, '2 + r.extra', 'R')} END), "
    f"least({_more('a[4]', '3', 'D')}, CASE WHEN r.ok AND r.initial = 'a' THEN {_more('a[3]', 'r.extra', 'K')} END, CASE WHEN r.ok THEN {_more('a[3]', '2 + r.extra', 'R')} END)]")
_GIVEN = "CASE WHEN p.q = 'u' THEN 'assistant' ELSE 'user' END"
SQL = rf"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
coded AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS code FROM told),
damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN code = 3 THEN [1, 2] ELSE [1] END) AS time
  FROM coded WHERE code <> 0),
marked AS (
  SELECT *, NOT regexp_matches(text, '[^{_SPACE}]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again,
         NOT regexp_matches(text, '[.!?][{_SPACE}]*$') AS cut, left(role, 1) AS initial,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM damaged),
rows AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT blank AND NOT again) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
         list(struct_pack(initial := initial, ok := NOT blank AND NOT again, extra := CASE WHEN cut THEN 1 ELSE 0 END, role := role, text := text) ORDER BY turn NULLS FIRST, role, text, again) AS rows
  FROM marked GROUP BY conv_id),
folded AS (
  SELECT *, list_reduce(rows, lambda a, r: {_ROW}, ['000000000', NULL, '000000002I', '000000004II']) AS ends FROM rows),
best AS (SELECT *, least(ends[1], ends[4]) AS best FROM folded),
edited AS (
  SELECT *, list_reduce(string_split(substr(best, 10), ''), lambda p, e: struct_pack(
      i := CASE WHEN e = 'I' THEN p.i ELSE p.i + 1 END,
      q := CASE e WHEN 'D' THEN p.q WHEN 'K' THEN rows[p.i].initial ELSE left({_GIVEN}, 1) END,
      lines := CASE e WHEN 'D' THEN p.lines WHEN 'K' THEN list_append(p.lines, rows[p.i].role || ':' || rows[p.i].text) WHEN 'R' THEN list_append(p.lines, {_GIVEN} || ':' || rows[p.i].text)
                      WHEN 'I' THEN list_append(p.lines, {_GIVEN} || ':') ELSE p.lines END),
    struct_pack(i := CAST(1 AS BIGINT), q := '', lines := CAST([] AS VARCHAR[]))) AS repair FROM best)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(CAST(left(best, 9) AS BIGINT), 0) AS cost, coalesce(substr(best, 10), '') AS audit, sha256(coalesce(array_to_string(repair.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN edited e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
