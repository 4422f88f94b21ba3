"""N-gram Jaccard join: word shingles, prefix filter, and a prefix tree over the sets that are left.

All sets are ordered alike: shingles that many documents share come last, all others by hash. Two sets of
Jaccard similarity t or more share a shingle among the first n - ceil(t n) + 1 of each, so only sets that
share one of those are looked at. Their pairs pass a length bound and a bound on the symmetric difference from
a bit sketch; for those that remain, the partners of a set are stored in a trie, and one traversal with the set
finds the overlaps, counting common beginnings once and leaving subtrees that the remaining lengths can't save.

The work goes in rounds: first between some neighbours within each shared shingle, in an order of its own for
each shingle, which links most of what belongs together; then between sets that share one and are not yet in
one component, at first only the likeliest pairs of two components, at last all pairs; a large shingle is dealt
to cells for that, and a component is not compared with itself. So a group of thousands of
near copies is never paired out, and no link between components is lost.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.llm.common import KeyFilter, mix64, prepare, table, text_bytes, tidied, unused
from merchantry.llm.components import components
from merchantry.llm.rolling import words_by_row
from merchantry.session import cut_lineage

WORDS = 5
#: Similarity as a fraction: 100 * intersection >= 80 * union.
NUM, DEN = 80, 100
#: Shingles at a time whose repeats are counted for the order; shingles found so often in such a block are reported.
BLOCK_SHINGLES, LEAST_REPEATS = 4_000_000, 4
#: From so many reported uses on a shingle goes to the end of the order; at most so many shingles do. The
#: order only steers how much is compared: any order finds all links.
COMMON, MOST_COMMON = 64, 1_000_000
#: Prefix entries to a range of hashes.
RANGE_ENTRIES, LEAST_RANGES = 150_000, 1024
HELD_ENTRIES = 500_000
#: A common shingle's entries are dealt to so many groups in the first round.
SALTS = 64
#: Neighbours of an entry in the first round; shingles of no more than one set above that are done then.
NEIGHBOURS = 2
#: Pairs of two components that a task offers in the second round.
LIKELIEST = 2
#: Entries of a shingle that are compared in one cell; more are dealt to blocks of about that size, and blocks meet in pairs.
CELL = 1024
#: Partners that one trie holds.
TRIE = 512
_FACTORS = mix64(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


# --- sets ---------------------------------------------------------------------------------------

def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of WORDS words, in place; of all words as one run if there are fewer."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(n, WORDS)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out += words[i:n - k + 1 + i] * _FACTORS[i]
    return mix64(out + np.uint64(k))


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1 if n else 0


def least_overlap(nx, ny):
    """The overlap from which two sets of these sizes are similar enough."""
    return -(-NUM * (nx + ny) // (NUM + DEN))


def signature(own: np.ndarray) -> int:
    """64 bits of a set, whatever the order of its elements."""
    total = int(mix64(own ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)) ^ len(own)
    return int(mix64(np.array([total], np.uint64)).view(np.int64)[0])


def sketch_bits(n: int) -> int:
    return max(64, 1 << (2 * n - 1).bit_length()) if n else 64


def sketch(own: np.ndarray) -> bytes:
    """A bit for each hash value modulo the size: whether an odd number of elements has it."""
    bits = sketch_bits(len(own))
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def fold(one: np.ndarray, size: int) -> np.ndarray:
    """A sketch as a smaller one."""
    while len(one) > size:
        one = one[:len(one) // 2] ^ one[len(one) // 2:]
    return one


def may_link(nx: int, ny: int, a: bytes, b: bytes) -> bool:
    """Whether sizes and sketches leave room for the similarity: bits that differ are elements that differ."""
    if DEN * min(nx, ny) < NUM * max(nx, ny):
        return False
    a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(a), len(b))
    differ = int(np.bitwise_count(fold(a, size) ^ fold(b, size)).sum())
    return nx + ny - 2 * least_overlap(nx, ny) >= differ


def in_order(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A set of ascending hashes, the common ones moved to the end."""
    if not len(common) or not len(own):
        return own
    last = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
    return np.concatenate([own[~last], own[last]])


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that repeat within the blocks of the tasks, at most MOST_COMMON of them, ascending."""
    @tidied
    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= LEAST_REPEATS
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], ["h", "n"])

        for batch in batches:
            for _, words in words_by_row(*text_bytes(batch.column(0))):
                held.append(shingles(words))
                n += len(held[-1])
                if n >= BLOCK_SHINGLES:
                    yield counted()
                    held, n = [], 0
        if n:
            yield counted()

    found = docs.select("text").mapInArrow(repeats, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    rows = found.orderBy(F.desc("n"), "h").limit(MOST_COMMON).select("h").toArrow()
    return np.sort(rows.column("h").to_numpy().view(np.uint64))


def sets(docs: DataFrame, common) -> DataFrame:
    """(doc_id, n, sig, prefix, sketch); prefix and sketch once per set and task."""
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            n, sigs, prefixes, sketches = [], [], [], []
            for _, words in words_by_row(*text_bytes(batch.column("text"))):
                own = np.unique(shingles(words))
                n.append(len(own))
                sigs.append(signature(own))
                first = len(own) > 0 and sigs[-1] not in seen
                if first:
                    seen.add(sigs[-1])
                prefixes.append(in_order(own, common.value)[:prefix_length(len(own))].tobytes() if first else None)
                sketches.append(sketch(own) if first else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sigs, pa.int64()), pa.array(prefixes, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "n", "sig", "prefix", "sketch"])
    return docs.mapInArrow(run, "doc_id long, n long, sig long, prefix binary, sketch binary")


# --- which sets share a shingle of their prefixes -----------------------------------------------

def _entries(ranges_n: int, common):
    """Packed (hash, sig, n) of all prefixes by range of the hash; those of common shingles dealt further."""
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def packed():
            rows = np.concatenate(held, axis=1)
            part = (mix64(rows[0]) % np.uint64(ranges_n)).astype(np.int64)
            if len(common.value):
                often = common.value[np.minimum(np.searchsorted(common.value, rows[0]), len(common.value) - 1)] == rows[0]
                part += often * (1 + (rows[1] % np.uint64(SALTS)).astype(np.int64)) * ranges_n
            order = np.argsort(part, kind="stable")
            values, cuts = np.unique(part[order], return_index=True)
            ends = np.concatenate([cuts[1:], [len(order)]])
            return pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array([rows[:, order[a:b]].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())], ["part", "packed"])

        for batch in batches:
            for sig, size, prefix in zip(batch.column("sig").to_numpy(), batch.column("n").to_numpy(), batch.column("prefix").to_pylist(), strict=True):
                hashes = np.frombuffer(prefix, np.uint64)
                held.append(np.stack([hashes, np.full(len(hashes), sig).view(np.uint64), np.full(len(hashes), size, np.uint64)]))
                n += len(hashes)
            if n >= HELD_ENTRIES:
                yield packed()
                held, n = [], 0
        if n:
            yield packed()
    return run


def _shared(ranges_n: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Entries of shingles that two sets share, each with those of its next neighbours whose lengths allow a link."""
        h, sig, n = np.concatenate([np.frombuffer(p, np.uint64).reshape(3, -1) for p in group["packed"]], axis=1)
        sizes = n.astype(np.int64)
        # Sets of like size stand together; among them each shingle has an order of its own, and its own bands.
        shift = (mix64(h ^ np.uint64(7)) >> np.uint64(40)).astype(np.float64) / (1 << 24)
        band = np.floor(np.log(np.maximum(sizes, 1)) / np.log(DEN / NUM) + shift).astype(np.int64)
        order = np.lexsort((mix64(sig ^ h), band, h))
        h, sig, n = h[order], sig[order], sizes[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (sig[1:] != sig[:-1])])
        h, sig, n = h[new], sig[new], n[new]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        m = np.diff(np.concatenate([first, [len(h)]]))
        # Entries of a dealt shingle may have their partners in other groups.
        m = np.repeat(m, m) + np.where(group["part"].iloc[0] >= ranges_n, SALTS, 0)
        out = pd.DataFrame({"h": h.view(np.int64), "sig": sig.view(np.int64), "n": n, "m": m})
        for k in range(1, NEIGHBOURS + 1):
            joins = np.zeros(len(h), np.bool_)
            joins[:-k or None] = (h[k:] == h[:-k]) & (DEN * np.minimum(n[:-k], n[k:]) >= NUM * np.maximum(n[:-k], n[k:])) if len(h) > k else False
            out[f"next{k}"] = pd.array(np.where(joins, np.roll(sig, -k).view(np.int64), 0), dtype="Int64")
            out.loc[~joins, f"next{k}"] = pd.NA
        return out[m > 1]
    return run


# --- the trie -----------------------------------------------------------------------------------

class Trie:
    """Ordered sets by common beginnings. A node is a range of the sorted sets and the depth up to which they agree."""

    def __init__(self, arrays: list[np.ndarray]):
        self.order = sorted(range(len(arrays)), key=lambda i: arrays[i].astype(">u8").tobytes())
        self.sets = [arrays[i] for i in self.order]
        self.agree = [self._lcp(a, b) for a, b in zip(self.sets, self.sets[1:])]

    @staticmethod
    def _lcp(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def overlaps(self, probe: np.ndarray) -> list[tuple[int, int]]:
        """(place of the set, overlap) of the sets that are similar enough to the probe."""
        found, ascending = [], np.sort(probe)
        stack = [(0, len(self.sets), 0, 0)] if self.sets and len(probe) else []
        while stack:
            first, last, depth, overlap = stack.pop()
            here = min(self.agree[first:last - 1]) if last - first > 1 else len(self.sets[first])
            part = self.sets[first][depth:here]
            if len(part):
                at = np.minimum(np.searchsorted(ascending, part), len(ascending) - 1)
                overlap += int((ascending[at] == part).sum())
            lengths = [len(s) for s in self.sets[first:last]]
            # What is left of the probe and of a set bounds what its overlap can still gain.
            if all(overlap + min(len(probe) - overlap, n - here) < least_overlap(len(probe), n) for n in set(lengths)):
                continue
            if last - first == 1:
                if overlap >= least_overlap(len(probe), lengths[0]):
                    found.append((self.order[first], overlap))
                continue
            at = first
            for i in range(first, last):
                if i == last - 1 or self.agree[i] == here:
                    if len(self.sets[at]) == here and i == at:
                        if overlap >= least_overlap(len(probe), here):
                            found.append((self.order[at], overlap))
                    else:
                        stack.append((at, i + 1, here, overlap))
                    at = i + 1
        return found


@tidied
def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, y, body) sorted by x: y null brings the set of x, the others the sets of its partners."""
    x, probe, ys, held = None, None, [], []

    def links():
        if probe is None or not ys:
            return
        near = [ys[i] for i, _ in Trie(held).overlaps(probe)]
        if near:
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(near), pa.int64()), pa.array(near, pa.int64())], ["x", "y"])

    for batch in batches:
        for one, y, body in zip(*(batch.column(k).to_pylist() for k in ("x", "y", "body")), strict=True):
            if one != x or len(held) >= TRIE:
                yield from links()
                ys, held = [], []
                if one != x:
                    x, probe = one, None
            own = np.frombuffer(body, np.uint64)
            if y is None:
                probe = own
            else:
                ys.append(y)
                held.append(own)
    yield from links()


# --- links --------------------------------------------------------------------------------------

class Join:
    """What both rounds need: the documents, the order, and one stored row per set."""

    def __init__(self, docs: DataFrame):
        self.docs, spark = docs, docs.sparkSession
        self.common = spark.sparkContext.broadcast(common_shingles(docs))
        self.rows = cut_lineage(sets(docs, self.common), "sets")
        self.owners = cut_lineage(self.rows.groupBy("sig", "n").agg(F.min("doc_id").alias("low_id")), "owners")
        self.sketches = cut_lineage(self.rows.where("sketch IS NOT NULL").select("sig", "n", "sketch").groupBy("sig", "n").agg(F.first("sketch").alias("sketch")), "sketches")
        n_entries = self.rows.where("prefix IS NOT NULL").agg(F.sum(F.octet_length("prefix") / 8)).head()[0] or 0
        ranges_n = max(LEAST_RANGES, int(n_entries) // RANGE_ENTRIES)
        packed = self.rows.where("prefix IS NOT NULL").select("sig", "n", "prefix").mapInArrow(_entries(ranges_n, self.common), "part long, packed binary")
        self.shared = cut_lineage(packed.groupBy("part").applyInPandas(_shared(ranges_n), "h long, sig long, n long, m long" + "".join(f", next{k} long" for k in range(1, NEIGHBOURS + 1))), "shared")

    def screened(self, pairs: DataFrame) -> DataFrame:
        """Pairs (x, y) of sets that sizes and sketches leave."""
        a, b = (self.sketches.select(F.col("sig").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "xy")

        @tidied
        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fine = [may_link(*v) for v in zip(*(batch.column(k).to_pylist() for k in ("nx", "ny", "sx", "sy")), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], ["x", "y"]).filter(pa.array(fine, pa.bool_()))

        return pairs.join(a, "x").join(b, "y").select("x", "y", "nx", "ny", "sx", "sy").mapInArrow(bound, "x long, y long")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Links among stored pairs (x, y), by the trie of each x. Sets are made again from the texts of those rows
        that can hold them, once per set."""
        pairs = cut_lineage(pairs, "pairs")
        needed = cut_lineage(pairs.select(F.col("x").alias("sig")).unionByName(pairs.select(F.col("y").alias("sig"))).distinct().join(self.owners.where("low_id IS NOT NULL"), "sig").select("sig", "low_id"), "needed")
        n = needed.count()
        by_id, by_sig, common = KeyFilter.of(needed, "low_id", n), KeyFilter.of(needed, "sig", n), self.common

        @tidied
        def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(by_id.test(batch.column("doc_id").fill_null(0).to_numpy()), pa.bool_()))
                own = [np.unique(shingles(words)) for _, words in words_by_row(*text_bytes(batch.column("text")))]
                sigs = np.array([signature(o) for o in own], np.int64)
                keep = np.flatnonzero(by_sig.test(sigs)) if len(own) else []
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(sigs[keep] if len(own) else [], pa.int64()), pa.array([in_order(own[i], common.value).tobytes() for i in keep], pa.binary())], ["low_id", "sig", "body"])

        made = self.docs.mapInArrow(bodies, "low_id long, sig long, body binary").join(needed, ["low_id", "sig"], "left_semi").groupBy("sig").agg(F.first("body").alias("body"))
        made = cut_lineage(made, "bodies")
        partners = pairs.join(made.withColumnRenamed("sig", "y"), "y").select("x", "y", "body")
        probes = pairs.select("x").distinct().join(made.withColumnRenamed("sig", "x"), "x").select("x", F.lit(None).cast("long").alias("y"), "body")
        return cut_lineage(partners.unionByName(probes).repartition("x").sortWithinPartitions(F.col("x"), F.col("y").asc_nulls_first()).mapInArrow(_linked, "x long, y long"), "links")

    def first_round(self) -> DataFrame:
        near = self.shared.select("sig", F.explode(F.array(*[f"next{k}" for k in range(1, NEIGHBOURS + 1)])).alias("next")).where("next IS NOT NULL")
        pairs = near.select(F.least("sig", "next").alias("x"), F.greatest("sig", "next").alias("y")).distinct()
        return self.verified(self.screened(pairs))

    def further_round(self, roots: DataFrame, most: int | None) -> DataFrame:
        """Links between components: for shingles that several components share, pairs across them; the ``most``
        likeliest of two components that a task sees, or all."""
        entries = self.shared.where(F.col("m") > NEIGHBOURS + 1).select("h", "sig", "n")
        placed = cut_lineage(entries.join(roots, F.col("sig") == F.col("node"), "left").select("h", "sig", "n", F.coalesce("root", "sig").alias("root")), "placed")
        several = cut_lineage(component_counts(placed), "several")
        left = in_cells(placed.join(several, "h")).join(self.sketches.select("sig", "sketch"), "sig")
        cell = ["h", "p", "q"]
        pairs = left.select(*cell, "side", "sig", "n", "root", "sketch").repartition(*cell).sortWithinPartitions(*cell, "n", "sig").mapInArrow(_across(most), "x long, y long").distinct()
        return self.verified(pairs)


def component_counts(placed: DataFrame) -> DataFrame:
    """Shingles of several components: their largest one, and into how many blocks its entries and the others go."""
    per = placed.groupBy("h", "root").agg(F.count("*").alias("k"))
    per = per.groupBy("h").agg(F.max_by("root", F.struct("k", "root")).alias("great"), F.max("k").alias("k"), F.sum("k").alias("all"), F.count("*").alias("roots")).where("roots > 1")
    blocks = lambda k: F.when(F.col("all") <= CELL, 0).otherwise(F.ceil(k / CELL)).cast("int")
    return per.select("h", "great", blocks(F.col("k")).alias("great_blocks"), blocks(F.col("all") - F.col("k")).alias("rest_blocks"))


def in_cells(entries: DataFrame) -> DataFrame:
    """Each entry once in every cell (h, p, q) where it is compared. A small shingle is one cell. Of a large one, block p of the
    entries outside the largest component meets each block of that component (q < 0) and each block q >= p of its own kind.
    Entries of a cell are compared if their sides differ, or if side is 2. The largest component is never paired with itself."""
    g, r = F.col("great_blocks"), F.col("rest_blocks")
    own = F.col("root") == F.col("great")
    block = F.pmod(F.xxhash64("sig"), F.greatest(F.when(own, g).otherwise(r), F.lit(1))).cast("int")
    cell = lambda p, q, side: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), F.lit(side).cast("int").alias("side") if isinstance(side, int) else side.cast("int").alias("side"))
    of_great = F.transform(F.sequence(F.lit(0), r - 1), lambda p: cell(p, -1 - block, 0))
    with_great = F.transform(F.sequence(F.lit(0), g - 1), lambda q: cell(block, -1 - q, 1))
    of_rest = F.transform(F.sequence(F.lit(0), r - 1), lambda o: cell(F.least(block, o), F.greatest(block, o), F.when(block == o, 2).when(block < o, 0).otherwise(1)))
    cells = F.when(g == 0, F.array(cell(F.lit(0), F.lit(0), 2))).when(own, of_great).otherwise(F.concat(with_great, of_rest))
    return entries.select("h", "sig", "n", "root", F.inline(cells))


def _across(most: int | None):
    """Pairs of different components within each cell that sizes and sketches leave. Rows come by cell and
    ascending size, so a row meets those of other components before it whose size is in reach; the others are let go."""
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, out, n_out = None, {}, {}, 0
        for batch in batches:
            for h, p, q, side, sig, n, root, marks in zip(*(batch.column(k).to_pylist() for k in ("h", "p", "q", "side", "sig", "n", "root", "sketch")), strict=True):
                if (h, p, q) != cell:
                    cell, held = (h, p, q), {}
                bits, size = int.from_bytes(marks, "little"), 8 * len(marks)
                gone = []
                for (its, at), group in held.items():
                    if its == root or at == side != 2:
                        continue
                    while group and DEN * group[0][0] < NUM * n:
                        group.popleft()
                    if not group:
                        gone.append((its, at))
                    for m, other, theirs, width in group:
                        if other == sig:
                            continue
                        mine, small = bits, size
                        while small > width:
                            small //= 2
                            mine = (mine & (1 << small) - 1) ^ mine >> small
                        differ = (mine ^ theirs).bit_count()
                        if differ <= m + n - 2 * least_overlap(m, n):
                            key = (its, root) if its < root else (root, its)
                            offers, pair = out.setdefault(key, {}), (sig, other) if sig < other else (other, sig)
                            if pair not in offers:
                                offers[pair], n_out = differ, n_out + 1
                                if most and len(offers) > most:
                                    del offers[max(offers, key=lambda p: (offers[p], p))]
                                    n_out -= 1
                for name in gone:
                    del held[name]
                mine = held.setdefault((root, side), deque())
                while mine and DEN * mine[0][0] < NUM * n:
                    mine.popleft()
                mine.append((n, sig, bits, size))
            if n_out >= 200_000:
                yield _pairs([p for offers in out.values() for p in offers])
                out, n_out = {}, 0
        if n_out:
            yield _pairs([p for offers in out.values() for p in offers])
    return run


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["x", "y"])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, n_verified, set_id.

    component_id is the least doc_id reachable by links, n_verified the links of the row's set that were verified to
    find the components (not all links within a component: the number depends on the run), set_id a number
    that rows of one set share. A null or blank text has no shingles, component_id its own doc_id, and links
    with nothing; a row without an id gets no component_id and links with nothing; rows of equal sets are one
    set; rows of one id count as one document; further columns are not looked at; an empty table gives an empty
    result. Sets are told apart by 64-bit sums over their shingle hashes."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    join = Join(docs)
    links = join.first_round()
    for most in (LIKELIEST, None):
        links = cut_lineage(links.unionByName(join.further_round(components(links), most)), "links")
    # Rows of one id with different texts are one document: their sets are linked through it.
    own = join.rows.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "sig").join(join.owners.select("sig", "low_id"), "sig")
    same = own.groupBy("doc_id").agg(F.min("sig").alias("x"), F.max("sig").alias("y"), F.count_distinct("sig").alias("k"))
    twice = own.join(same.where("k > 1").select("doc_id", "x"), "doc_id").select("x", F.col("sig").alias("y")).where("x <> y")
    roots = components(links.unionByName(twice.distinct()))
    placed = join.owners.where("n > 0 AND low_id IS NOT NULL").join(roots, F.col("sig") == F.col("node"), "left").select("sig", "low_id", F.coalesce("root", "sig").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("low_id").alias("component")), "root").select("sig", "component")
    degree = links.select(F.col("x").alias("sig")).unionByName(links.select(F.col("y").alias("sig"))).groupBy("sig").agg(F.count("*").alias("links"))
    labels = cut_lineage(named.join(degree, "sig", "left"), "labels")
    out = join.rows.select("doc_id", "n", "sig").join(labels, "sig", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_verified"), F.col("sig").alias("set_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows of the least id of each component, with all their columns; rows without an id or without
    words are in no component and stay. Columns may have any names."""
    [name] = unused(docs, "gone")
    found = jaccard_components(docs, id_col, text_col)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone[name], "left_anti")


def op1_ngram_jaccard(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
classes AS (SELECT min(doc_id) OVER (PARTITION BY list_sort(s)) AS rep, doc_id FROM sets WHERE len(s) > 0),
one AS (SELECT sets.doc_id, unnest(s) AS g FROM sets JOIN classes USING (doc_id) WHERE classes.rep = sets.doc_id),
shares AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shares JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(node, low) AS (SELECT doc_id, doc_id FROM classes WHERE rep = doc_id UNION SELECT e.y, r.low FROM reach r JOIN edges e ON e.x = r.node WHERE r.low < e.y),
lows AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
SELECT sizes.doc_id, n AS n_shingles, coalesce(low, sizes.doc_id) AS component_id
FROM sizes LEFT JOIN classes USING (doc_id) LEFT JOIN lows ON lows.node = classes.rep
"""
