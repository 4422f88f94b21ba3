"""Exact dedup: static binary-fuse filters over immutable snapshots screen incoming digests.

A corpus arrives as snapshots that never change again and an incoming batch. Each snapshot's distinct
digests are dealt to buckets by digest, and each bucket gets a binary-fuse filter (three slots a key,
one byte each). Digests of the batch are first grouped among themselves, then screened by the filter
of their bucket; only positives join the exact buckets. Members of a group are held byte by byte against
the text of the row that stays, so that a digest alone never decides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.llm.common import KeyFilter, mix64, prepare, table, tidied, unused
from merchantry.session import cut_lineage

#: Digests to a filter; the number of buckets follows from it.
BUCKET_KEYS = 200_000
LEAST_BUCKETS = 128
#: Copies of a kept text per group, over which the group's members are dealt for the byte check.
SALTS = 16


# --- binary-fuse filter -------------------------------------------------------------------------

def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> np.ndarray:
    """Three slots a key, in three segments that follow one another."""
    mixed = mix64(keys + np.uint64(seed))
    first = (mixed >> np.uint64(33)) % np.uint64(segments - 2)
    other = mix64(mixed)
    parts = [other & np.uint64(0x1FFFFF), (other >> np.uint64(21)) & np.uint64(0x1FFFFF), (other >> np.uint64(42)) & np.uint64(0x1FFFFF)]
    return np.stack([((first + np.uint64(i)) * np.uint64(segment) + p % np.uint64(segment)).astype(np.int64) for i, p in enumerate(parts)], axis=1)


def _mark(keys: np.ndarray, seed: int) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0x9E3779B97F4A7C15 + seed)) >> np.uint64(56)).astype(np.uint8)


def build_fuse(keys: np.ndarray) -> bytes:
    """A filter over distinct 64-bit keys: header (seed, segment length, segments), then one byte a slot."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = 1 << max(4, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
    size = max(int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3)))) + 32, 3 * segment)
    segments = max(3, -(-size // segment))
    for seed in range(1, 200):
        slots = _slots(keys, seed, segment, segments)
        table, order = np.zeros(segment * segments, np.uint8), _peel(slots, segment * segments)
        if order is None:
            if seed % 10 == 0:
                segments += max(1, segments // 10)
            continue
        marks = _mark(keys, seed)
        for rows, at in reversed(order):  # keys of one round don't touch each other's slot
            others = slots[rows]
            value = marks[rows] ^ table[others[:, 0]] ^ table[others[:, 1]] ^ table[others[:, 2]]
            table[at] = value
        return np.array([seed, segment, segments], np.int64).tobytes() + table.tobytes()
    raise ValueError("no seed gave a filter")


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the slot that each has alone), or None if a core stays."""
    counts = np.bincount(slots.ravel(), minlength=size)
    ids = np.repeat(np.arange(len(slots)), 3)
    sums = np.zeros(size, np.int64)
    np.add.at(sums, slots.ravel(), ids)
    order, left = [], len(slots)
    alone = np.flatnonzero(counts == 1)
    while len(alone):
        rows, first = np.unique(sums[alone], return_index=True)
        order.append((rows, alone[first]))
        left -= len(rows)
        touched = slots[rows].ravel()
        np.subtract.at(counts, touched, 1)
        np.subtract.at(sums, touched, np.repeat(rows, 3))
        touched = np.unique(touched)
        alone = touched[counts[touched] == 1]
    return order if not left else None


def fuse_contains(data: bytes, keys: np.ndarray) -> np.ndarray:
    seed, segment, segments = (int(x) for x in np.frombuffer(data[:24], np.int64))
    table, keys = np.frombuffer(data[24:], np.uint8), keys.astype(np.uint64)
    at = _slots(keys, seed, segment, segments)
    return table[at[:, 0]] ^ table[at[:, 1]] ^ table[at[:, 2]] == _mark(keys, seed)


# --- the operator -------------------------------------------------------------------------------

def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _key(digest: Column) -> Column:
    """The first 60 bits of a hex digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def snapshot_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """(bucket, filter): one binary-fuse filter per bucket of a snapshot's distinct digests."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": group["bucket"].iloc[:1], "filter": [build_fuse(group["key"].to_numpy())]})

    return snapshot.select(F.pmod(_key(F.col("digest")), F.lit(buckets)).cast("int").alias("bucket"), _key(F.col("digest")).alias("key")).groupBy("bucket").applyInPandas(build, "bucket int, filter binary")


def screen(batch: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Rows of the batch whose digest the snapshot may hold."""

    def positives(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or held.empty:
            return rows.iloc[:0][["digest", "low_id", "copies"]]
        return rows[fuse_contains(held["filter"].iloc[0], rows["key"].to_numpy())][["digest", "low_id", "copies"]]

    keyed = batch.select("digest", "low_id", "copies", _key(F.col("digest")).alias("key"), F.pmod(_key(F.col("digest")), F.lit(buckets)).cast("int").alias("bucket"))
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(positives, "digest string, low_id long, copies long")


def exact_groups(digests: DataFrame, arrivals: int) -> DataFrame:
    """(digest, low_id, copies) over all arrivals: the earlier ones are snapshots, each met by the next one.

    digests: (id, digest, arrival), a stored table."""
    held = digests.where("arrival = 0").groupBy("digest").agg(F.min("id").alias("low_id"), F.count("*").alias("copies"))
    for arrival in range(1, arrivals):
        batch = cut_lineage(digests.where(F.col("arrival") == arrival).groupBy("digest").agg(F.min("id").alias("low_id"), F.count("*").alias("copies")), "batch")
        held = cut_lineage(held, "snapshot")
        buckets = max(LEAST_BUCKETS, -(-held.count() // BUCKET_KEYS))
        met = screen(batch, snapshot_filters(held, buckets), buckets).join(held.select("digest"), "digest", "left_semi")
        held = held.unionByName(batch.join(met.select("digest"), "digest", "left_anti")).unionByName(met)
        held = held.groupBy("digest").agg(F.min("low_id").alias("low_id"), F.sum("copies").alias("copies"))
    return held


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", arrivals: int = 2) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after each run of ASCII white space became one space; a null text is
    empty, an empty text is a text like any other. The least id of a group stays; rows without an id never
    stay while the group has a row with one, and rows repeated with one id share their fate. Other
    columns, whatever their names, are not looked at. An empty table gives an empty result."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("body"))
    digests = cut_lineage(rows.select("id", F.sha2("body", 256).alias("digest"), F.pmod(F.xxhash64("id"), F.lit(arrivals)).cast("int").alias("arrival")), "digests")
    groups = cut_lineage(exact_groups(digests, arrivals), "groups")
    shared = groups.where("copies > 1")
    # Texts of groups with several rows: those whose digest a small filter may hold, then the exact join.
    held = KeyFilter.of(shared.select(_key(F.col("digest")).alias("key")), "key", shared.count())

    @tidied
    def maybe(batches):
        for batch in batches:
            hit = held.test(batch.column("key").to_numpy())
            if hit.any():
                yield batch.filter(pa.array(hit)).select(["id", "digest", "body"])

    keyed = rows.withColumn("digest", F.sha2("body", 256)).withColumn("key", _key(F.col("digest")))
    members = keyed.select("id", "digest", "body", "key").mapInArrow(maybe, "id long, digest string, body string")
    stays = members.join(shared.withColumnRenamed("low_id", "id").select("id", "digest"), ["id", "digest"], "left_semi").groupBy("digest").agg(F.first("body").alias("kept_body"))
    stays = stays.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    against = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(stays, ["digest", "salt"])
    odd = against.where(F.col("body") != F.col("kept_body")).select("id", "digest", F.md5("body").alias("variant"))
    odd = cut_lineage(odd, "odd").distinct()  # rows that only share the digest: empty unless SHA-256 collides
    keyed = digests.select("id", "digest").join(odd, [digests.id.eqNullSafe(odd.id), digests.digest == odd.digest], "left").select(digests.id, digests.digest, "variant") if odd.head(1) else None
    if keyed is None:
        out = digests.join(groups, "digest")
    else:
        regrouped = keyed.groupBy("digest", "variant").agg(F.min("id").alias("low_id"), F.count("*").alias("copies"))
        out = keyed.join(regrouped.withColumnRenamed("variant", "v"), [keyed.digest == regrouped.digest, keyed.variant.eqNullSafe(F.col("v"))]).select(keyed.id, keyed.digest, "low_id", "copies")
    return out.select(F.col("id").alias("doc_id"), F.col("low_id").alias("keep_id"), F.col("copies").alias("group_size"), F.col("id").eqNullSafe(F.col("low_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, one for each text, with all their columns; of rows repeated with one id and
    text any one stays. Columns may have any names."""
    digest, own_id, own_digest = unused(docs, "digest", "own_id", "own_digest")
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(own_digest)).distinct()
    rows = docs.withColumn(digest, F.sha2(normalised(F.col(text_col)), 256))
    rows = rows.join(kept, [rows[id_col].cast("long").eqNullSafe(kept[own_id]), rows[digest] == kept[own_digest]], "left_semi")
    return rows.dropDuplicates([digest]).drop(digest)


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
