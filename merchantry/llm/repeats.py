"""Suffix-array dedup: bytes of long strings that stand elsewhere too are removed.

A corpus is too long for one suffix order, and most of it can't repeat. So each window of LENGTH bytes is
first named by its anchor, the least hashed gram within it; equal windows have equal anchors at equal
places. Windows in a row with one anchor are a context. A context whose anchor is found once in the corpus
holds no repeat; a context that is found twice as a whole is all repeat. Only different contexts of one anchor
are left, and they meet in one partition: each sender's contexts are a shard with its own Burrows-Wheeler
transform over blocks of BLOCK bytes, and the transforms are merged by refining their interleave block by
block, as Holt and McMillan do, until it orders all suffixes by LENGTH bytes. A round that tells two neighbours
apart ends their common prefix there; intervals that no round tells apart are the repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.llm.common import KeyFilter, mix64, prepare, table, text_bytes, tidied
from merchantry.llm.rolling import BYTE, SLICE, prefix_sums, ranges, slices
from merchantry.session import cut_lineage

LENGTH, GRAM, BLOCK = 400, 128, 100
WINDOW = LENGTH - GRAM + 1
#: Text bytes to a range of anchors; the number of ranges follows from it.
RANGE_BYTES, LEAST_RANGES = 8_000_000, 1024
#: An anchor with more different contexts is dealt out further, by what its windows have in common.
CROWD, STEP = 5_000, 32
#: Bodies with more in common than that go window by window instead of meeting in one task.
MEETING = 5_000
HELD = 400_000


# --- contexts -----------------------------------------------------------------------------------

def contexts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Of rows in one array: row, first and last window of each context and place of its anchor (by bytes of the
    array), hash of the anchor, hash of the whole context."""
    n, low32 = len(data), np.uint64(0xFFFFFFFF)
    if n < LENGTH:
        return {k: np.zeros(0, t) for k, t in (("row", np.int64), ("lo", np.int64), ("hi", np.int64), ("at", np.int64), ("anchor", np.uint64), ("whole", np.uint64))}
    sums = prefix_sums(BYTE[data])
    at = np.arange(n - GRAM + 1)
    grams = mix64(ranges(sums, at, at + GRAM))
    least = (grams & ~low32) | (low32 - at.astype(np.uint64))  # equal hashes: the last one
    width = 1
    while 2 * width <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < WINDOW:
        least = np.minimum(least[:len(least) - (WINDOW - width)], least[WINDOW - width:])
    begins, ends = offsets[:-1], offsets[1:] - LENGTH
    has = ends >= begins
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begins[has], 1)
    np.add.at(edge, ends[has] + 1, -1)
    windows = np.flatnonzero(np.cumsum(edge[:n - LENGTH + 1]) > 0)
    anchor = (low32 - (least[windows] & low32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(windows) else np.zeros(0, np.int64)
    lo, hi = windows[first], windows[np.concatenate([first[1:], [len(windows)]]) - 1] if len(windows) else first
    whole = mix64(ranges(sums, lo, hi + LENGTH) ^ mix64((hi - lo + 1).astype(np.uint64)))
    return {"row": np.searchsorted(offsets, lo, side="right") - 1, "lo": lo, "hi": hi, "at": anchor[first], "anchor": grams[anchor[first]], "whole": whole}


def contexts_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """The same by slices; lo and hi count from the row's begin, at from the data's. Comes with where each
    context's bytes begin.

    A long row is cut into slices that overlap, which at most cuts a context in two."""
    for first, last in slices(data, offsets):
        start, end = offsets[first], offsets[last]
        for at in range(start, max(end - LENGTH + 1, start + 1), SLICE) if last - first == 1 else [start]:
            stop = min(at + SLICE + LENGTH - 1, end) if last - first == 1 else end
            rows = offsets[first:last + 1] - at if last - first > 1 else np.array([0, stop - at])
            found = contexts(data[at:stop], rows)
            begins = found["lo"] + at
            found["row"], found["at"] = found["row"] + first, found["at"] + at
            found["lo"], found["hi"] = begins - offsets[found["row"]], found["hi"] + at - offsets[found["row"]]
            yield found, begins


def _row_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(id, key) that tell rows apart; rows of equal id and text are alike."""
    data, offsets = text_bytes(batch.column("text"))
    ids = batch.column("doc_id").to_pylist()
    keys = [int.from_bytes(hashlib.blake2b(data[offsets[i]:offsets[i + 1]].tobytes(), digest_size=8, key=b"none" if one is None else b"row").digest(), "little", signed=True) for i, one in enumerate(ids)]
    return np.array([0 if one is None else one for one in ids], np.int64), np.array(keys, np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _counted(ranges_n: int):
    """Per task (range, packed anchors, wholes, counts): what it holds of each context, counted."""
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def packed():
            anchor, whole = (np.concatenate([h[k] for h in held]) for k in ("anchor", "whole"))
            order = np.lexsort((whole, anchor))
            anchor, whole = anchor[order], whole[order]
            new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])]))
            counts = np.diff(np.concatenate([new, [len(anchor)]])).astype(np.uint64)
            rows = np.stack([anchor[new], whole[new], counts])
            part = (rows[0] % np.uint64(ranges_n)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(ranges_n + 1))
            used = [r for r in range(ranges_n) if cuts[r] < cuts[r + 1]]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([rows[:, order[cuts[r]:cuts[r + 1]]].tobytes() for r in used], pa.binary())], ["part", "packed"])

        for batch in batches:
            for found, _ in contexts_of(*text_bytes(batch.column(0))):
                if len(found["row"]):
                    held.append({k: found[k] for k in ("anchor", "whole")})
                    n += len(found["row"])
            if n >= HELD:
                yield packed()
                held, n = [], 0
        if n:
            yield packed()
    return run


def _contested(group: pd.DataFrame) -> pd.DataFrame:
    """Contexts whose anchor is found twice or more: (anchor, whole, twice, contexts)."""
    anchor, whole, counts = np.concatenate([np.frombuffer(p, np.uint64).reshape(3, -1) for p in group["packed"]], axis=1)
    order = np.lexsort((whole, anchor))
    anchor, whole, counts = anchor[order], whole[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])]))
    anchor, whole, counts = anchor[new], whole[new], np.add.reduceat(counts, new)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    kinds = np.diff(np.concatenate([first, [len(anchor)]]))
    many = np.repeat(np.add.reduceat(counts, first) > 1, kinds)
    return pd.DataFrame({"anchor": _signed(anchor[many]), "whole": _signed(whole[many]), "twice": counts[many] > 1, "contexts": np.repeat(kinds, kinds)[many]})


# --- merged transforms --------------------------------------------------------------------------

class Shard:
    """One sender's contexts as a Burrows-Wheeler transform over blocks.

    A window is read as LENGTH / BLOCK blocks. ``order`` after h rounds is the shard's windows by their last h
    blocks, and the transform at round h is, in that order, the block before those."""

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks  # (rounds, windows): the block that round h adds
        self.order = np.arange(blocks.shape[1])
        self.transforms = []
        for one in blocks:
            self.transforms.append(one[self.order])
            self.order = self.order[np.argsort(self.transforms[-1], kind="stable")]


def merge(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all shards (counted through) in merged order, and the interval of each: windows of one
    interval have all blocks in common.

    The interleave says from which shard each place takes its next suffix. A round reads the transforms along it,
    which gives each place a block, and deals the places stably by block: no suffix is compared or sorted again."""
    sizes = np.array([len(s.order) for s in shards])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint16 if len(shards) < 1 << 16 else np.int64), sizes)
    parted = np.zeros(len(interleave), np.int64)  # intervals of places that no round told apart
    for h in range(LENGTH // BLOCK):
        transform = np.concatenate([s.transforms[h] for s in shards])
        place = np.empty(len(interleave), np.int64)
        place[np.argsort(interleave, kind="stable")] = np.arange(len(interleave))  # the shards' own orders, one after another
        block = transform[place]
        order = np.argsort(block, kind="stable")
        interleave, block, parted = interleave[order], block[order], parted[order]
        new = np.concatenate([[0], (block[1:] != block[:-1]) | (parted[1:] != parted[:-1])]) if len(block) else block
        parted = np.cumsum(new)
    place = np.empty(len(interleave), np.int64)
    place[np.argsort(interleave, kind="stable")] = np.arange(len(interleave))
    windows = np.concatenate([s.order + starts[i] for i, s in enumerate(shards)]) if shards else place
    return windows[place], parted


def _repeated_windows(group: pd.DataFrame) -> pd.DataFrame:
    """Of contexts that met: runs of windows that some other place holds too. (anchor, whole, begin, end)"""
    group = group.drop_duplicates(["anchor", "whole", "skip"]).sort_values(["shard", "anchor", "whole", "skip"])
    shards, owners, firsts = [], [], []
    for _, rows in group.groupby("shard", sort=True):
        blocks = []
        for i, body, skip in zip(rows.index, rows["body"], rows["skip"], strict=True):
            data = np.frombuffer(body, np.uint8)
            n = len(data) - LENGTH + 1
            at = np.arange(n + LENGTH - BLOCK)
            hashes = mix64(ranges(prefix_sums(BYTE[data]), at, at + BLOCK))
            blocks.append(np.stack([hashes[LENGTH - BLOCK * (h + 1):][:n] for h in range(LENGTH // BLOCK)]))
            owners.append(np.full(n, i))
            firsts.append(np.arange(n) + skip)
        shards.append(Shard(np.concatenate(blocks, axis=1)))
    windows, interval = merge(shards)
    sizes = np.bincount(interval)
    hit = np.zeros(len(windows), np.bool_)
    hit[windows] = sizes[interval] > 1
    owner, first = np.concatenate(owners)[hit], np.concatenate(firsts)[hit]
    order = np.lexsort((first, owner))
    owner, first = owner[order], first[order]
    if not len(owner):
        return pd.DataFrame({"anchor": [], "whole": [], "begin": [], "end": []}).astype("int64")
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (first[1:] != first[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(owner)]]) - 1
    found = group.loc[owner[new]]
    return pd.DataFrame({"anchor": found["anchor"].to_numpy(), "whole": found["whole"].to_numpy(), "begin": first[new], "end": first[last]})


def _meeting(wide: KeyFilter, within: bool):
    """Bodies whose route is a wide one, or those of the other routes."""
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(wide.test(batch.column("route").to_numpy()) == within, pa.bool_()))
    return run


@tidied
def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of each body by two hashes over its blocks: (anchor, whole, place, a, b)."""
    for batch in batches:
        for anchor, whole, skip, body in zip(*(batch.column(k).to_pylist() for k in ("anchor", "whole", "skip", "body")), strict=True):
            data = np.frombuffer(body, np.uint8)
            n = len(data) - LENGTH + 1
            at = np.arange(n + LENGTH - BLOCK)
            hashes = mix64(ranges(prefix_sums(BYTE[data]), at, at + BLOCK))
            a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            for h in range(LENGTH // BLOCK):
                block = hashes[BLOCK * h:][:n]
                a, b = mix64(a + block), mix64((b ^ block) * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, anchor, np.int64)), pa.array(np.full(n, whole, np.int64)), pa.array(np.arange(n) + skip), pa.array(_signed(a)), pa.array(_signed(b))], ["anchor", "whole", "place", "a", "b"])


def _repeats_by_window(bodies: DataFrame) -> DataFrame:
    """What _repeated_windows finds, without a group that holds all bearers of a passage: a window is a repeat if its hashes
    have two places. Counted on the map side; the join back can be split where a window is everywhere."""
    key = ["anchor", "a", "b"]
    windows = cut_lineage(bodies.select("anchor", "whole", "skip", "body").mapInArrow(_single_windows, "anchor long, whole long, place long, a long, b long"), "windows")
    spread = windows.groupBy(*key).agg(*[f(k).alias(f"{k}_{f.__name__}") for k in ("whole", "place") for f in (F.min, F.max)])
    repeated = cut_lineage(spread.where("whole_min <> whole_max OR place_min <> place_max").select(*key), "repeated")
    places = windows.join(repeated, key).groupBy("anchor", "whole").agg(F.collect_set("place").alias("places")).withColumn("places", F.array_sort("places"))
    edge = lambda step: F.filter("places", lambda p: ~F.array_contains(F.col("places"), p + F.lit(step).cast("long")))
    runs = F.arrays_zip(edge(-1).alias("begin"), edge(1).alias("end"))
    return places.select("anchor", "whole", F.inline(runs).alias("begin", "end"))


# --- the operator -------------------------------------------------------------------------------

def _sent(contested: KeyFilter, several: KeyFilter, crowded: KeyFilter):
    """Second reading: where contested contexts stand, and once per task the bytes of those that must be compared."""
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seen = TaskContext.get().partitionId(), set()
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids, keys = _row_keys(batch)
            for found, begins in contexts_of(data, offsets):
                keep = np.flatnonzero(contested.test(_signed(found["whole"])))
                if not len(keep):
                    continue
                found, begins = {k: v[keep] for k, v in found.items()}, begins[keep]
                row, lo, hi, anchor, whole = (found[k] for k in ("row", "lo", "hi", "anchor", "whole"))
                no = pa.nulls(len(keep), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (_signed(anchor), _signed(whole), ids[row], keys[row], lo, hi)] + [pa.nulls(len(keep), pa.int64())] * 2 + [pa.array(np.full(len(keep), shard, np.int32)), no], _SENT_NAMES)
                bodies = []
                crowd = crowded.test(_signed(anchor))
                for i in np.flatnonzero(several.test(_signed(whole))):
                    if (name := (int(anchor[i]), int(whole[i]))) in seen:
                        continue
                    if len(seen) < HELD:
                        seen.add(name)
                    begin, last = begins[i], begins[i] + hi[i] - lo[i]
                    if not crowd[i]:
                        bodies.append((i, 0, _signed(anchor)[i], data[begin:last + LENGTH].tobytes()))
                        continue
                    for step in range((found["at"][i] - last) // STEP, (found["at"][i] - begin) // STEP + 1):
                        near = found["at"][i] - step * STEP  # windows of a step begin at most here
                        one, other = max(begin, near - STEP + 1), min(last, near)
                        common = data[near:near - STEP + 1 + LENGTH].tobytes()  # what each of them holds
                        bodies.append((i, one - begin, _route(common, name[0], step), data[one:other + LENGTH].tobytes()))
                if bodies:
                    at = np.array([b[0] for b in bodies])
                    columns = [_signed(anchor)[at], _signed(whole)[at]], [[b[1] for b in bodies], [b[2] for b in bodies]]
                    columns = [pa.array(x, pa.int64()) for x in columns[0]] + [pa.nulls(len(at), pa.int64())] * 4 + [pa.array(x, pa.int64()) for x in columns[1]]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(at), shard, np.int32)), pa.array([b[3] for b in bodies], pa.binary())], _SENT_NAMES)
    return run


_SENT_NAMES = ["anchor", "whole", "id", "key", "lo", "hi", "skip", "route", "shard", "body"]
_SENT = "anchor long, whole long, id long, key long, lo long, hi long, skip long, route long, shard int, body binary"


def removed_runs(docs: DataFrame) -> DataFrame:
    """(id, key, runs) of rows with repeats: arrays of first and last window. docs: (doc_id, text)."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).head()["n"] or 0
    ranges_n = max(LEAST_RANGES, -(-size // RANGE_BYTES))
    packed = docs.select("text").mapInArrow(_counted(ranges_n), "part int, packed binary")
    known = cut_lineage(packed.groupBy("part").applyInPandas(_contested, "anchor long, whole long, twice boolean, contexts long"), "contested")
    counts = known.agg(F.count("*"), F.sum((F.col("contexts") > 1).cast("int")), F.sum((F.col("contexts") > CROWD).cast("int"))).head()
    contested = KeyFilter.of(known, "whole", counts[0])
    several = KeyFilter.of(known.where("contexts > 1"), "whole", counts[1] or 0)
    crowded = KeyFilter.of(known.where(F.col("contexts") > CROWD), "anchor", counts[2] or 0)
    sent = cut_lineage(docs.mapInArrow(_sent(contested, several, crowded), _SENT), "sent")
    bodies = sent.where("skip IS NOT NULL").select("anchor", "whole", "skip", "route", "shard", "body")
    wide = cut_lineage(bodies.groupBy("route").count().where(F.col("count") > MEETING), "wide")
    wide = KeyFilter.of(wide, "route", wide.count())
    meeting = bodies.mapInArrow(_meeting(wide, False), bodies.schema).withColumn("part", F.pmod(F.xxhash64("route"), F.lit(ranges_n)))
    merged = meeting.groupBy("part").applyInPandas(_repeated_windows, "anchor long, whole long, begin long, end long")
    merged = merged.unionByName(_repeats_by_window(bodies.mapInArrow(_meeting(wide, True), bodies.schema)))
    runs = cut_lineage(merged.groupBy("anchor", "whole").agg(F.collect_list(F.struct("begin", "end")).alias("runs")), "merged")
    # Stored, so that both sides of the next join are dealt out for it and a context found everywhere can be split.
    judged = cut_lineage(known.join(runs, ["anchor", "whole"], "left").where("twice OR runs IS NOT NULL"), "judged")
    places = sent.where("body IS NULL").select("anchor", "whole", "id", "key", "lo", "hi").join(judged.select("anchor", "whole", "twice", "runs"), ["anchor", "whole"])
    whole = F.array(F.struct(F.col("lo").alias("begin"), F.col("hi").alias("end")))
    parts = F.transform("runs", lambda r: F.struct((r["begin"] + F.col("lo")).alias("begin"), (r["end"] + F.col("lo")).alias("end")))
    return places.select("id", "key", F.when(F.col("twice"), whole).otherwise(parts).alias("runs")).groupBy("id", "key").agg(F.flatten(F.collect_set("runs")).alias("runs"))


def _route(common: bytes, anchor: int, step: int) -> int:
    """Where the windows of one step before a crowded anchor meet: equal windows hold equal common bytes."""
    return int.from_bytes(hashlib.blake2b(common, digest_size=8, key=b"%d %d" % (anchor, step)).digest(), "little", signed=True)


def _cut(text: bytes, runs: list[dict]) -> tuple[bytes, int]:
    """What is left, and how many runs of removed bytes there were."""
    edges, kept, at, spans = sorted((r["begin"], r["end"] + LENGTH) for r in runs), [], 0, 0
    reach = -1
    for begin, end in edges:
        if begin > reach:
            spans += 1
            kept.append(text[at:begin])
        reach = max(reach, end)
        at = reach
    return b"".join([*kept, text[at:]]), spans


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (binary, as a cut may fall within a character;
    null if nothing was removed), kept_sha256, text (what is left; the pieces of a character that a cut went through
    read as U+FFFD).

    A null text is empty; texts under LENGTH bytes hold no repeat; very long texts are read whole, in overlapping slices; repeated
    rows are repeats of one another; rows without an id are treated like others; further columns are not looked at; an empty table
    gives an empty result."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    runs = cut_lineage(removed_runs(docs), "runs")
    touched = KeyFilter.of(runs, "key", runs.count())

    def parted(within: bool):
        """Rows that can have a run, or all others. Only the first kind travels to the join."""
        @tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, keys = _row_keys(batch)
                at = np.flatnonzero(touched.test(keys) == within) if len(keys) else []
                if len(at):
                    texts = [(t or "").encode() for t in batch.column("text").take(pa.array(at)).to_pylist()]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(ids[at]), pa.array(keys[at]), pa.array(texts, pa.binary())], ["doc_id", "id", "key", "body"])
        return run

    @tidied
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, body, spans in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "body", "runs")), strict=True):
                kept, n_spans = _cut(body, spans or [])
                rows.append((doc_id, len(body), len(body) - len(kept), n_spans, kept if n_spans else None, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 4 + (pa.binary(), pa.string(), pa.string()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "text"])

    schema = "doc_id long, id long, key long, body binary"
    joined = docs.mapInArrow(parted(True), schema).join(runs, ["id", "key"], "left").select("doc_id", "body", "runs")
    apart = docs.mapInArrow(parted(False), schema).select("doc_id", "body", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs"))
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, text string"
    return joined.mapInArrow(finish, result).unionByName(apart.mapInArrow(finish, result))


def op9_suffix_repeats(spark, sf_dir):
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")
