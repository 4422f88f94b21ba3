"""Hard-negative mining: a vertical scan with branch and bound (BOND).

Vectors lie in blocks of rows, each dimension a column of its own with its least and greatest value. For an anchor
the columns of a block are read in the order of the anchor's descending magnitudes. What the unread columns can still
add is bounded by their extremes, and rows whose bounds no longer reach a wanted window of scores leave the bitmap of
candidates, until the windows hold exact scores only. The best positives are one open window; their scores set the windows
in which an anchor's negatives lie, found by a second scan. The floor of a window rises with its k-th best row, in a block
by lower bounds and from block to block by exact scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantry.llm.common import prepare, table, tidied
from merchantry.session import cut_lineage

BLOCK_ROWS = 8192
#: Bytes of anchor vectors that one scan takes along; more anchors mean more scans, not a larger broadcast.
ANCHOR_BYTES = 8_000_000
#: After which shares of the columns candidates are judged.
STOPS = (0.5, 0.75, 0.875, 1.0)
NO_ID, LEAST, MOST = np.iinfo(np.int64).max, np.iinfo(np.int64).min, np.iinfo(np.int64).max

_BLOCK = "block long, ids array<long>, labels array<long>, kind string, columns array<binary>, least array<long>, most array<long>"
_HIT = "uid long, window int, score long, id long, row long"


# --- blocks and anchors -------------------------------------------------------------------------

@tidied
def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, vector) as blocks in label order, one binary per dimension; short vectors end in zeros."""
    task, n_blocks, held, n = TaskContext.get().partitionId(), 0, [], 0

    def block() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        labels, ids = rows["label"].to_numpy(), rows["id"].fill_null(NO_ID).to_numpy()
        order = np.lexsort((ids, labels))
        vectors = rows["vector"].combine_chunks()
        sizes = vectors.value_lengths().to_numpy()
        dense = np.zeros((int(sizes.max(initial=0)), len(rows)), np.int64)
        values = vectors.flatten().to_numpy()
        starts = np.cumsum(sizes) - sizes
        dense[np.arange(len(values)) - np.repeat(starts, sizes), np.repeat(np.arange(len(rows)), sizes)] = values
        dense = dense[:, order]
        kind = next(k for k in ("<i2", "<i4", "<i8") if not dense.size or (np.iinfo(k).min <= dense.min() and dense.max() <= np.iinfo(k).max))
        return pa.RecordBatch.from_pylist([{
            "block": (task << 20) + n_blocks, "ids": rows["id"].take(pa.array(order)).to_pylist(), "labels": labels[order].tolist(), "kind": kind,
            "columns": [c.astype(kind).tobytes() for c in dense], "least": dense.min(axis=1).tolist(), "most": dense.max(axis=1).tolist()}], schema=_SCHEMA)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= BLOCK_ROWS:
            yield block()
            held, n, n_blocks = [], 0, n_blocks + 1
    if n:
        yield block()


_SCHEMA = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("kind", pa.string()),
                     ("columns", pa.list_(pa.binary())), ("least", pa.list_(pa.int64())), ("most", pa.list_(pa.int64()))])


@dataclass
class Block:
    block: int
    ids: np.ndarray
    unnamed: np.ndarray
    labels: np.ndarray
    columns: np.ndarray  # (dimensions, rows)
    least: np.ndarray
    most: np.ndarray

    def uid(self, at):
        """A number for each stored row; blocks hold fewer than 2 ** 20 rows."""
        return (self.block << 20) + at


def _read(batch: pa.RecordBatch) -> Iterator[Block]:
    for one in range(batch.num_rows):
        row = {k: batch.column(k)[one] for k in batch.schema.names}
        columns = row["columns"].as_py()
        matrix = np.stack([np.frombuffer(c, row["kind"].as_py()) for c in columns]) if columns else np.zeros((0, len(row["ids"])), np.int64)
        ids = row["ids"].values
        yield Block(row["block"].as_py(), ids.fill_null(NO_ID).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), row["labels"].values.to_numpy(), matrix,
                    np.array(row["least"].as_py(), np.int64), np.array(row["most"].as_py(), np.int64))


def _anchors(every: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _read(batch):
                at = np.flatnonzero(~b.unnamed & (b.ids % every == 0))
                vectors = b.columns[:, at].T.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(b.uid(at)), pa.array(b.ids[at]), pa.array(b.labels[at]), pa.array([v.tobytes() for v in vectors], pa.binary())], ["uid", "anchor_id", "label", "vector"])
    return run


# --- the scan -----------------------------------------------------------------------------------

class Best:
    """The k best rows of a window so far: higher scores first, then lesser ids, those without an id last."""

    def __init__(self, low: int, high: int, k: int):
        self.low, self.high, self.k, self.rows = low, high, k, []

    @property
    def floor(self) -> int:
        return max(self.low, -self.rows[-1][0]) if len(self.rows) == self.k else self.low

    def take(self, scores: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        fit = np.flatnonzero((scores >= self.floor) & (scores <= self.high))
        if len(fit) > self.k:
            fit = fit[np.lexsort((uids[fit], ids[fit], -scores[fit]))[:self.k]]
        self.rows = sorted(self.rows + [(-int(scores[i]), int(ids[i]), int(uids[i])) for i in fit])[:self.k]


def exact_type(block: Block, greatest: int):
    """The cheapest number type in which every score of the block is exact."""
    reach = max(np.abs(block.least).max(initial=0), np.abs(block.most).max(initial=0)).item() * greatest * max(len(block.columns), 1)
    if reach >= 1 << 63:
        raise ArithmeticError("vector components are too large: scores would not fit a long")
    return np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64


def scan(block: Block, columns: np.ndarray, vector: np.ndarray, wanted: np.ndarray, windows: list[Best]) -> int:
    """Offer the windows their rows of the block among the wanted ones (a bitmap). Returns how many cells it read."""
    dims = min(len(columns), len(vector))
    order = np.argsort(-np.abs(vector[:dims]), kind="stable")
    query = vector[order].astype(columns.dtype)
    ends = np.stack([vector[order] * block.least[order], vector[order] * block.most[order]])
    rest_low, rest_high = (np.concatenate([np.cumsum(e[::-1])[::-1], [0]]) for e in (ends.min(axis=0), ends.max(axis=0)))
    alive = np.flatnonzero(wanted)
    partial, at, cells = np.zeros(len(alive), columns.dtype), 0, 0
    for stop in sorted({int(np.ceil(dims * s)) for s in STOPS}):
        if stop > at:
            read = columns[order[at:stop]]
            partial = partial + query[at:stop] @ (read if len(alive) == read.shape[1] else read[:, alive])
            cells += (stop - at) * len(alive)
            at = stop
        low, high = rest_low[at], rest_high[at]
        candidate = np.zeros(len(alive), np.bool_)
        for w in windows:
            floor = w.floor
            sure = partial[(partial + low >= floor) & (partial + high <= w.high)] if at < dims else partial[:0]
            if len(sure) >= w.k:  # so many rows are sure to be in the window at this score or above
                floor = max(floor, int(np.partition(sure, len(sure) - w.k)[len(sure) - w.k]) + int(low))
            candidate |= (partial + high >= floor) & (partial + low <= w.high)
        alive, partial = alive[candidate], partial[candidate]
        if not len(alive):
            return cells
    scores = partial.astype(np.int64)
    for w in windows:
        w.take(scores, block.ids[alive], block.uid(alive))
    return cells


@dataclass
class Anchor:
    uid: int
    label: int
    vector: np.ndarray
    windows: list[tuple[int, int]]  # least and greatest score


def _scanned(anchors, k: int, same: bool):
    """The k best rows of each window of each broadcast anchor in a task's blocks, of its own label or the others."""
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {a.uid: [Best(low, high, k) for low, high in a.windows] for a in anchors.value}
        greatest = max((int(np.abs(a.vector).max(initial=0)) for a in anchors.value), default=0)
        for batch in batches:
            for block in _read(batch):
                columns = block.columns.astype(exact_type(block, greatest))
                for a in anchors.value:
                    wanted = (block.labels == a.label) if same else (block.labels != a.label)
                    if same and block.uid(0) <= a.uid < block.uid(len(wanted)):
                        wanted[a.uid - block.uid(0)] = False
                    scan(block, columns, a.vector, wanted, found[a.uid])
        rows = [(uid, i, -score, None if one == NO_ID else one, row) for uid, windows in found.items() for i, w in enumerate(windows) for score, one, row in w.rows]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["uid", "window", "score", "id", "row"])
    return run


def _search(blocks: DataFrame, batches: list[DataFrame], k: int, same: bool) -> DataFrame:
    """(uid, window, score, id, row, rank): each window's k best rows over all blocks. Each batch of anchors is of
    bounded size, is broadcast, and scans the stored blocks once; the blocks don't travel."""
    spark, parts = blocks.sparkSession, []
    for batch in batches:
        rows = batch.collect()
        anchors = [Anchor(r.uid, r.label, np.frombuffer(r.vector, np.int64), [(w.low, w.high) for w in r.windows]) for r in rows]
        parts.append(cut_lineage(blocks.mapInArrow(_scanned(spark.sparkContext.broadcast(anchors), k, same), _HIT), "hits"))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    first = Window.partitionBy("uid", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, every: int = 50, n_positives: int = 5, n_negatives: int = 3, low_pct: int = 50, high_pct: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. vectors: (id long, label long, vector array<long>).

    Anchors are the rows whose id is divisible by ``every``; scores are inner products; higher ones come first, then lesser
    ids. An anchor's positives are its first n_positives other rows of its label, fewer if there are fewer; for each, the first
    n_negatives rows of other labels whose score is low_pct to high_pct percent of the positive's. No row is left out of the search.

    Rows with a null label, vector or component take no part. A row without an id is no anchor and comes after equal scores
    with an id; repeated rows are rows of their own, as anchors too; missing last components count as 0, an empty
    vector as zeros; a positive with a score below 0 has no negatives, as its window is empty; an empty table, one without
    anchors or with a single label gives an empty result; further columns are not looked at. Scores that could exceed a
    long raise ArithmeticError."""
    prepare(vectors.sparkSession)
    whole = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()) & F.col("label").isNotNull()
    rows = vectors.where(whole).select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<long>"))
    blocks = cut_lineage(rows.mapInArrow(_blocks, _BLOCK), "blocks")
    anchors = cut_lineage(blocks.mapInArrow(_anchors(every), "uid long, anchor_id long, label long, vector binary"), "anchors")
    size = anchors.agg(F.sum(F.octet_length("vector") + 64)).head()[0] or 0
    n_batches = -(-size // ANCHOR_BYTES) or 1
    dealt = lambda df: [df.where(F.pmod(F.xxhash64("uid"), F.lit(n_batches)) == i) for i in range(n_batches)]

    def windows(*ends: tuple[Column, Column]) -> Column:
        return F.array(*[F.struct(low.alias("low"), high.alias("high")) for low, high in ends])

    opened = anchors.withColumn("windows", windows((F.lit(int(LEAST)), F.lit(int(MOST)))))
    positives = cut_lineage(_search(blocks, dealt(opened), n_positives, True).select("uid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "rank"), "positives")
    # Exact whole-number ends: 100 * negative between low_pct and high_pct times the positive.
    score = F.col("positive_score")
    low, high = F.ceil(score.cast("decimal(38,0)") * low_pct / 100).cast("long"), F.floor(score.cast("decimal(38,0)") * high_pct / 100).cast("long")
    asked = positives.where(score >= 0).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rank", low.alias("low"), high.alias("high")))).alias("windows"))
    asked = cut_lineage(anchors.join(asked, "uid"), "asked")
    negatives = _search(blocks, dealt(asked), n_negatives, False)
    named = negatives.select("uid", (F.col("window") + 1).alias("of"), F.col("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = positives.withColumnRenamed("rank", "of").join(named, ["uid", "of"]).join(anchors.select("uid", "anchor_id"), "uid")
    return pairs.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    finite = ~F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return hard_negatives(rows.where(F.coalesce(finite, F.lit(True))).select(F.col("vec_id").alias("id"), label.alias("label"), scaled.alias("vector")))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS id, a.label = b.label AS alike,
         CAST(coalesce(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r),
positives AS (
  SELECT a, b, anchor_id, id, score FROM scores WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST, b) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER g AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.a = p.a AND NOT n.alike AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW g AS (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id NULLS LAST, n.b) QUALIFY row_number() OVER g <= 3
"""
