"""Toxicity: a factorization machine over hashed terms.

A document's terms are its words and their beginnings, hashed into buckets; a bucket's value grows with the logarithm of how many
different words of the text fall into it. Each bucket has a weight and a vector, and two buckets found together add the product of
their vectors, so that an insult counts for more beside a group that it is aimed at, which no sum of weights can say.

The evidence of every bucket is counted over all labelled documents that may teach: its chi-square with the label, less what
the best of so many buckets reaches by chance and what a slight tendency makes of so many documents. Buckets without any left are silent, the others' values are scaled by it. The
machine itself is fitted by gradient steps on a sample of about FIT_ROWS of those documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.llm.common import KeyFilter, prepare, table, tidied
from merchantry.session import cut_lineage

BUCKETS = 1 << 18
ALL = BUCKETS
BEGINNINGS = (3, 4, 5, 6)
FACTORS = 8
#: The machine is fitted on about so many labelled documents; the evidence is counted over all of them.
FIT_ROWS = 10_000
#: Evidence that chance or a slight tendency explains does not count: that much of a correlation.
SLIGHT = 0.03
EPOCHS, BATCH, RATE, DECAY = 40, 1024, 0.1, 1e-5
#: The scale of values, and words whose terms a worker remembers.
SCALE, REMEMBERED = 4.0, 500_000
_WORD = re.compile(r"[^\W\d_]+")


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def buckets_of(word: str) -> tuple[int, ...]:
    return tuple({_bucket(word), *(_bucket(f"^{word[:k]}") for k in BEGINNINGS if len(word) >= k)})


class Terms:
    """How many different words of a text fall into each bucket, of those that speak (all, if not given)."""

    def __init__(self, speaking: dict[int, int] | None = None):
        self.speaking, self.known = speaking, {}

    def _of(self, word: str) -> tuple[int, ...]:
        found = buckets_of(word)
        return found if self.speaking is None else tuple(self.speaking[b] for b in found if b in self.speaking)

    def __call__(self, text: str | None) -> Counter:
        counts: Counter = Counter()
        for word in words_of(text):
            if (found := self.known.get(word)) is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                found = self.known[word] = self._of(word)
            if found:
                counts.update(found)
        return counts


# --- evidence -----------------------------------------------------------------------------------

@tidied
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task (bucket, documents with it, toxic ones); bucket ALL is every document."""
    terms, n, toxic = Terms(), np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            found = np.array([*terms(text), ALL], np.int64)
            n[found] += 1
            if label:
                toxic[found] += 1
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(toxic[at])], ["bucket", "n", "toxic"])


def bucket_counts(taught: DataFrame) -> DataFrame:
    """(bucket, n, toxic) over documents (text, toxic); combined within tasks, at most a row per bucket in the end."""
    counts = taught.select("text", "toxic").mapInArrow(_counted, "bucket int, n long, toxic long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def evidence(counts: DataFrame, n: int, toxic: int) -> DataFrame:
    """(bucket, value) of the buckets that speak, where n documents were counted, so many of them toxic."""
    held, both, total, marked = F.col("n").cast("double"), F.col("toxic").cast("double"), F.lit(float(n)), F.lit(float(toxic))
    gap = total * both - held * marked
    spread = held * (total - held) * marked * (total - marked)
    chi_square = F.when(spread > 0, total * gap * gap / spread).otherwise(0.0)
    left = chi_square - 2 * float(np.log(BUCKETS)) - SLIGHT ** 2 * total
    return counts.where((F.col("bucket") != ALL) & (left > 0)).select("bucket", (SCALE * F.sqrt(left / total)).cast("float").alias("value"))


# --- the machine --------------------------------------------------------------------------------

def _summed(numbers: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rows of numbers added up by their places among n."""
    return np.stack([np.bincount(at, column, n) for column in numbers.T], axis=1)


def raised(weights: np.ndarray, bias: float, at: np.ndarray, values: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n documents, given as entries (row, bucket, value): their log-odds, sums of weights and vectors, and the scaled entries."""
    scaled = weights[at] * values[:, None]
    sums = _summed(scaled, row, n)
    squares = np.bincount(row, (scaled[:, 1:] ** 2).sum(axis=1), n)
    return bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares), sums, scaled


def chance(log_odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, speaking: int, bias: float) -> tuple[np.ndarray, float]:
    """(weights, bias) from documents as (buckets, values): one weight and FACTORS numbers for each bucket that speaks.

    Adaptive gradient steps on the log loss, with a fixed seed."""
    rng = np.random.default_rng(0)
    weights = np.zeros((speaking, 1 + FACTORS))
    weights[:, 1:] = rng.normal(0, 0.05, (speaking, FACTORS))
    seen, seen_bias = np.full(weights.shape, 1e-8), 1e-8
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for begin in range(0, len(order), BATCH):
            part = order[begin:begin + BATCH]
            at, values = (np.concatenate([rows[i][k] for i in part]) for k in (0, 1))
            row = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            log_odds, sums, scaled = raised(weights, bias, at, values, row, len(part))
            error = (chance(log_odds) - labels[part]) / len(part)
            own = (error[row] * values)[:, None]
            step = _summed(np.concatenate([own, own * (sums[row, 1:] - scaled[:, 1:])], axis=1), at, speaking) + DECAY * weights
            seen += step ** 2
            weights -= RATE * step / np.sqrt(seen)
            seen_bias += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(seen_bias)
    return weights, float(bias)


def entries(texts: list[str | None], terms: Terms, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: row, bucket and value of each entry, by rows."""
    counts = [terms(t) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(c) for c in counts])
    at = np.fromiter((b for c in counts for b in c), np.int64, len(row))
    return row, at, scale[at] * np.log2(1.0 + np.fromiter((k for c in counts for k in c.values()), float, len(row)))


def _fitted(speaking: dict[int, int], scale: np.ndarray, bias: float):
    """One task: the machine from the sample's entries, each bucket's row of numbers, the bias last."""
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((key, label, at, values) for batch in batches for key, label, at, values in zip(*(batch.column(c).to_pylist() for c in ("key", "toxic", "at", "values")), strict=True))
        rows = [(np.frombuffer(at, np.int64), np.frombuffer(values, np.float64)) for _, _, at, values in held]
        weights, end = fit(rows, np.array([label for _, label, _, _ in held], float), len(speaking), bias)
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(weights)), len(weights)], pa.int32()), pa.array([*weights.tolist(), [end]], pa.list_(pa.float64()))], ["at", "weights"])
    return run


def _sampled(speaking: dict[int, int], scale: np.ndarray):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(speaking)
        for batch in batches:
            row, at, values = entries(batch.column("text").to_pylist(), terms, scale)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            packed = [pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()) for x in (at, values)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("toxic"), *packed], ["key", "toxic", "at", "values"])
    return run


def _screened(labelled: KeyFilter):
    """Rows that can have a label, each with its different words once: all that is counted, and less to send."""
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = batch.filter(pa.array(labelled.test(batch.column("doc_id").to_numpy())))
                words = [" ".join(sorted(words_of(t))) for t in found.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([found.column("doc_id"), pa.array(words, pa.string())], ["doc_id", "text"])
    return run


def _scored(model):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speaking, scale, weights, bias = model.value
        terms = Terms(speaking)
        for batch in batches:
            if n := batch.num_rows:
                row, at, values = entries(batch.column("text").to_pylist(), terms, scale)
                score = chance(raised(weights, bias, at, values, row, n)[0])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (score of 0.5 or more). labels: (id, label).

    Learns from documents that have a label and aren't held out; only their texts are looked at. Several labels of one id count as
    their greatest; of several rows with one id each counts as evidence, and one is in the sample that the machine is fitted on. A null or empty text has no terms and gets the score of a text that says nothing; a null label or id teaches
    nothing, and a row without an id is not held out; very long texts are read whole; repeated rows get equal scores;
    further columns are not looked at; without labels, or with labels of one kind only, no term speaks and every score is their
    smoothed rate; an empty table gives an empty result."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = cut_lineage(known, "labels")
    # Only texts that can have a label travel to theirs.
    labelled = KeyFilter.of(known, "doc_id", known.count())
    free = rows.where("doc_id IS NOT NULL AND NOT held_out").select("doc_id", "text")
    counts = cut_lineage(bucket_counts(free.mapInArrow(_screened(labelled), free.schema).join(known, "doc_id")), "counts")
    n, toxic = counts.where(F.col("bucket") == ALL).select("n", "toxic").head() or (0, 0)
    bias = float(np.log((toxic + 0.1) / (n - toxic + 0.9)))
    # At most one row per bucket, then as many numbers for each: bounded however many documents there are.
    spoken = sorted((r.bucket, r.value) for r in evidence(counts, n, toxic).collect()) if 0 < toxic < n else []
    speaking, scale = {b: i for i, (b, _) in enumerate(spoken)}, np.array([v for _, v in spoken], float)
    weights = np.zeros((0, 1 + FACTORS))
    if speaking:
        # Labels of the sample are at most twice FIT_ROWS, so they go to the texts.
        share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(FIT_ROWS / n, 1)))
        sample = free.join(F.broadcast(known.where(share).limit(2 * FIT_ROWS)), "doc_id").select(F.col("doc_id").alias("key"), "text", "toxic")
        found = sample.mapInArrow(_sampled(speaking, scale), "key long, toxic int, at binary, values binary").groupBy("key", "toxic").agg(F.min(F.struct("at", "values")).alias("e")).select("key", "toxic", "e.at", "e.values")
        fitted = cut_lineage(found.repartition(1).mapInArrow(_fitted(speaking, scale, bias), "at int, weights array<double>"), "machine")
        numbers = [r.weights for r in sorted(fitted.collect(), key=lambda r: r["at"])]
        weights, bias = np.array(numbers[:-1]), numbers[-1][0]
    model = spark.sparkContext.broadcast((speaking, scale, weights, bias))
    return rows.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double, predicted int")


def op12_toxicity(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)
