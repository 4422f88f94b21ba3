"""What several operators share: the input table, batch sizes, and a fixed-size key filter."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python at once; texts may be long.
BATCH_ROWS = 256
#: A key filter never takes more bits than this (16 MB), however many keys there are.
MOST_FILTER_BITS = 1 << 27
SEGMENT_BYTES = 1 << 16


def prepare(spark: SparkSession) -> SparkSession:
    """Batch size; and on one machine the place of this package for Python workers, which a cluster gets with
    the job (--py-files)."""
    if spark.sparkContext.master.startswith("local"):
        spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Column names that the frame does not have, whatever it has."""
    taken, names = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        names.append(stem)
    return names


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tidied(run):
    """A function over Arrow batches that gives freed memory back when its task ends: Python workers live on
    from stage to stage, beside an executor that needs the room."""
    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)
    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and where each row begins (one more
    entry than rows). Null counts as empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]] if len(offsets) else whole[:0], offsets - offsets[0]


def _probes(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    mixed = mix64(keys.astype(np.int64).view(np.uint64))
    step = (mixed >> np.uint64(32)) | np.uint64(1)
    for i in range(3):
        yield (mixed + np.uint64(i) * step) & np.uint64(bits - 1)


class KeyFilter:
    """Which rows can have a key: a Bloom filter of bounded size over 64-bit keys.

    Only a screen ahead of an exact join: false positives cost work, never rows. Its size follows
    the number of keys up to MOST_FILTER_BITS."""

    def __init__(self, spark: SparkSession, bits: int, words: np.ndarray):
        self.bits, self.words = bits, spark.sparkContext.broadcast(words)

    @classmethod
    def of(cls, keys: DataFrame, column: str, n_keys: int) -> KeyFilter:
        """keys: a stored table, read once; each task marks its own bits, equal segments are merged
        by OR, and the driver gets the segments of one filter."""
        bits = 1 << 16
        while bits < min(12 * n_keys, MOST_FILTER_BITS):
            bits *= 2
        segment = min(SEGMENT_BYTES, bits // 8)

        @tidied
        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(bits, np.bool_)
            for batch in batches:
                values = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
                for at in _probes(values, bits):
                    own[at] = True
            packed = np.packbits(own, bitorder="little").reshape(-1, segment)
            for i in np.flatnonzero(packed.any(axis=1)):
                yield pa.RecordBatch.from_arrays([pa.array([int(i)], pa.int32()), pa.array([packed[i].tobytes()], pa.binary())], ["segment", "marks"])

        def merged(group: pd.DataFrame) -> pd.DataFrame:
            out = np.zeros(segment, np.uint8)
            for marks in group["marks"]:
                out |= np.frombuffer(marks, np.uint8)
            return pd.DataFrame({"segment": group["segment"].iloc[:1], "marks": [out.tobytes()]})

        schema = "segment int, marks binary"
        found = keys.select(F.col(column).cast("long")).mapInArrow(marked, schema).groupBy("segment").applyInPandas(merged, schema)
        words = np.zeros((bits // 8 // segment, segment), np.uint8)
        for row in found.collect():
            words[row.segment] = np.frombuffer(row.marks, np.uint8)
        return cls(keys.sparkSession, bits, words.reshape(-1))

    def __reduce__(self):
        return _remade, (self.bits, self.words)

    def test(self, keys: np.ndarray) -> np.ndarray:
        words, hit = self.words.value, np.ones(len(keys), np.bool_)
        for at in _probes(keys, self.bits):
            hit &= (words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
        return hit


def _remade(bits, words):
    one = KeyFilter.__new__(KeyFilter)
    one.bits, one.words = bits, words
    return one
