"""Best-fit packing: documents into as few sequences as best-fit decreasing finds.

Only lengths matter to the plan, and there are at most as many lengths as a sequence has tokens. So the
pieces are counted by length, and best-fit decreasing runs over those counts: a segment tree over remaining
capacities finds the tightest capacity that has an open bin in logarithmic time, and equal pieces go into
equal bins in one step. What comes out is a short list of runs (length, first rank, count, first bin,
offset, step). Each piece then finds its place from its length and its rank among the pieces of that length,
which is counted per partition, so no piece leaves its task for the plan.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from merchantry.llm.common import prepare, table, tidied
from merchantry.session import cut_lineage

SEQUENCE = 2048
#: Entries that a worker keeps, in two halves: of the words, and half as many of their parts.
MOST_CACHED = 1_000_000


class TwoHalves(dict):
    """A bounded table: when the young half is full it becomes the old one, from which entries still in use
    come back."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most // 2, {}

    def find(self, key):
        """The entry, moved to the young half; None if there is none. Plain get() looks there only."""
        got = self.get(key)
        if got is None and (got := self.old.pop(key, None)) is not None:
            self.add(key, got)
        return got

    def add(self, key, value):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


class WordTable:
    """Ids of a text by its white-space-separated words, each distinct word encoded once.

    The tokenizer drops white space before it cuts words, and its normaliser never joins characters across
    it, so the ids of a text are those of its words in turn. Texts of plain Latin letters are lower-cased
    first, which lets more words share an entry; all others go word by word through the whole tokenizer."""

    _plain = regex.compile(r"[^\t-\r -~¡-ɏ]")

    def __init__(self, path: str, cached: int | None = None):
        cached = cached or MOST_CACHED
        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        splits = [x["pattern"]["Regex"] for x in made["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        self.cut = regex.compile(splits[0])
        self.special = [x["content"] for x in made["added_tokens"]]
        self.words, self.others, self.parts = TwoHalves(cached), TwoHalves(cached // 4), TwoHalves(cached // 2)
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def _part(self, part: str) -> bytes:
        got = self.parts.find(part)
        if got is None:
            marked = part if part.isascii() else self.bytes.pre_tokenize_str(part)[0][0]
            got = array("I", [t.id for t in self.tokenizer.model.tokenize(marked)]).tobytes()
            self.parts.add(part, got)
        return got

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self._plain.search(text) or any(s in text for s in self.special):
            words, known = regex.split(r"[\t-\r ]+", text), self.others
            new = lambda w: np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            words, known = text.lower().split(), self.words
            new = lambda w: b"".join(map(self._part, self.cut.findall(w)))
        got = list(map(known.get, words))
        if None in got:
            for i, one in enumerate(got):
                if one is None:
                    one = known.find(words[i])
                    if one is None:
                        one = new(words[i])
                        known.add(words[i], one)
                    got[i] = one
        return b"".join(got)


_TABLES: dict[tuple[str, int | None], WordTable] = {}


def _table_of(path: str, cached: int | None) -> WordTable:
    if (path, cached) not in _TABLES:
        _TABLES[path, cached] = WordTable(path, cached)
    return _TABLES[path, cached]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, most: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text",
           cached: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, place): the ids of each document and end_id, cut
    where longer than a sequence. place counts the pieces of one length within their task's part."""
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = _table_of(tokenizer, cached), TaskContext.get().partitionId(), np.zeros(most + 1, np.int64)
        end, wide = np.array([end_id], "<u4").tobytes(), 4 * most
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = words.ids(text or "") + end
                for piece, at in enumerate(range(0, len(data), wide)):
                    one = data[at:at + wide]
                    n = len(one) // 4
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(one), part, int(seen[n])))
                    seen[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECE_TYPES, strict=True)], _PIECE_NAMES)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long")


_PIECE_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
_PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


class CapacityTree:
    """A segment tree over remaining capacities 0..most: whether a capacity has open bins."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.open = bytearray(2 * self.leaves)

    def put(self, capacity: int, is_open: bool) -> None:
        at = capacity + self.leaves
        self.open[at] = is_open
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] | self.open[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The least capacity >= need with an open bin."""
        at = need + self.leaves
        while not self.open[at]:
            while at & 1:  # a right child: its subtree ends here
                at //= 2
                if at <= 1:
                    return None
            if at <= 1:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_decreasing(counts: dict[int, int], most: int = SEQUENCE) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first bin, offset, pieces per bin) and the number of bins.

    A run's pieces go to consecutive bins from the first one, so many to each, at offset, offset + length
    and so on. The same as best-fit decreasing piece by piece: within one length, the tightest bins take a piece
    each; a bin that takes one and still has room for another is then the tightest again, so it is filled
    up before the next bin, open or new, is touched."""
    tree, bins, runs, n_bins = CapacityTree(most), {}, [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            first, n = bins[capacity].popleft() if capacity is not None else (n_bins, left)
            room = capacity if capacity is not None else most
            if capacity is not None and not bins[capacity]:
                tree.put(capacity, False)
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, most - room, each))
                _open(tree, bins, room - each * length, first, full, most)
                left, rank, first, n = left - full * each, rank + full * each, first + full, n - full
                if capacity is None:
                    n_bins += full
            if left and (n if capacity is not None else True) and left < each:
                runs.append((length, rank, left, first, most - room, each))
                _open(tree, bins, room - left * length, first, 1, most)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
                if capacity is None:
                    n_bins += 1
            if capacity is not None and n:
                bins[capacity].appendleft((first, n))
                tree.put(capacity, True)
    return runs, n_bins


def _open(tree: CapacityTree, bins: dict[int, deque], capacity: int, first: int, n: int, most: int) -> None:
    if capacity:
        bins.setdefault(capacity, deque()).append((first, n))
        tree.put(capacity, True)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, most: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text",
         cached: int | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone; a document of more than ``most`` ids is cut into full pieces
    and a rest; rows with one id, or with none, are packed each by itself; further columns are not looked
    at; an empty table gives an empty result. ``cached`` bounds a worker's word table (MOST_CACHED by default); it
    only changes memory and time. The driver gets one count for each length (at most ``most``),
    and the runs of the plan, of which there are some for each length."""
    prepare(docs.sparkSession)
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    cut = cut_lineage(pieces(docs, tokenizer, end_id, most, id_col, text_col, cached), "pieces")
    by_part = cut_lineage(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {row.length: row.n for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = best_fit_decreasing(counts, most)
    runs = np.array(sorted(runs), np.int64).reshape(-1, 6)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))

    @tidied
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = runs[:, 0] << 48 | runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            one = runs[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            nth = rank - one[:, 1]
            where = [pa.array(one[:, 3] + nth // one[:, 5], pa.int64()), pa.array(one[:, 4] + nth % one[:, 5] * length, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in _PIECE_NAMES[:5]] + where, [*_PIECE_NAMES[:5], "sequence_id", "offset"])

    ranked = cut.join(ranks, ["part", "length"]).select(*_PIECE_NAMES[:5], (F.col("place") + F.col("earlier")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
