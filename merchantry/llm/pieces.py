"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model has a white-space marker behind another character, so no merge crosses the place before
a marked word, and each marked word can be segmented by itself. A task keeps a table of the distinct marked
words that it has met, segments each once with the sentencepiece library, and joins ids, and decoded texts,
back by position. The table is bounded: full, it is dropped and filled again, which costs time and nothing else.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.llm.common import prepare, table, tidied

MARK = "▁"
MOST_CACHED = 500_000
BLOCK = 100_000


class ChunkTable:
    """ids and decoded text of a whole text, exactly as the library gives them."""

    _marked = re.compile(" +[^ ]*")

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        crossing = [p for p in every if re.search(f"[^{MARK}]{MARK}", p)]
        if crossing or self.model.encode("a  b ", out_type=str)[:1] != [MARK + "a"] or self.model.decode(self.model.encode(" a  b ")) != " a  b ":
            raise ValueError(f"the model's pieces cross white-space markers, or it changes white space: {crossing[:3]}")
        self.lone = self.model.piece_to_id(MARK)
        # Decimal ids by chunk, and the decoded text of those chunks that don't come back as they were.
        self.ids: dict[str, str] = {}
        self.texts: dict[str, str] = {}

    def _segment(self, chunks: list[str], block: list[list[str]]) -> None:
        """Fill the table for new chunks of a block. A chunk is blanks and a word; the library puts one marker
        before what it gets, and drops one again. Nothing comes back for an empty text, so the lone marker
        has its own entry."""
        if len(self.ids) + len(chunks) > MOST_CACHED:
            self.ids, self.texts = {}, {}
            chunks = list(set().union(*block))
        ids = self.model.encode([c[1:] for c in chunks], num_threads=1)
        for chunk, got, text in zip(chunks, ids, self.model.decode(ids, num_threads=1), strict=True):
            self.ids[chunk] = repr(got or [self.lone])[1:-1].replace(" ", "")
            if " " + text != chunk:
                self.texts[chunk] = " " + text

    def chunks(self, text: str) -> list[str]:
        if MARK in text:
            text = text.replace(MARK, " ")  # both are the same marker to the model
        return self._marked.findall(" " + text) if text else []

    def _joined(self, block: list[list[str]]) -> Iterator[tuple[str, str]]:
        """ids and texts of some chunk lists; new chunks are segmented in one call."""
        got = [list(map(self.ids.get, chunks)) for chunks in block]
        if any(None in one for one in got):
            new = {c for chunks, one in zip(block, got, strict=True) if None in one for c, known in zip(chunks, one, strict=True) if known is None}
            self._segment(list(new), block)
            got = [list(map(self.ids.get, chunks)) for chunks in block]
        for chunks, one in zip(block, got, strict=True):
            yield ",".join(one), "".join([self.texts.get(c, c) for c in chunks] if self.texts else chunks)

    def encode_all(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """For each text its decimal ids joined by commas, their number, and the decoded text. Work goes in
        blocks whose chunks the table can hold, a long text in several of them."""
        ids, back = [[] for _ in texts], [[] for _ in texts]
        block, at, held = [], [], 0

        def flush():
            for i, (decimal, text) in zip(at, self._joined(block), strict=True):
                ids[i].append(decimal)
                back[i].append(text)

        for i, text in enumerate(texts):
            chunks = self.chunks(text)
            for k in range(0, len(chunks), BLOCK):
                part = chunks[k:k + BLOCK]
                if held + len(part) > BLOCK:
                    flush()
                    block, at, held = [], [], 0
                block.append(part)
                at.append(i)
                held += len(part)
        flush()
        whole = [(",".join(a), "".join(b)[1:]) for a, b in zip(ids, back, strict=True)]
        return [(decimal, decimal.count(",") + 1 if decimal else 0, text) for decimal, text in whole]

    def encode(self, text: str) -> tuple[str, int, str]:
        return self.encode_all([text])[0]


_TABLES: dict[str, ChunkTable] = {}


def _table_of(path: str) -> ChunkTable:
    if path not in _TABLES:
        _TABLES[path] = ChunkTable(path)
    return _TABLES[path]


def encoded(docs: DataFrame, model: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids and decoded.

    A null text is empty, and an empty text has no ids; very long texts are read whole, word by word; repeated rows give
    repeated results; further columns are not looked at; an empty table gives an empty result."""
    prepare(docs.sparkSession)
    model = model or public_tokenizers.path("piece_bpe_32k.model")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _table_of(model)
        for batch in batches:
            n, ids, back, extra = [], [], [], ([], [])
            for decimal, count, decoded in words.encode_all([t or "" for t in batch.column(1).to_pylist()]):
                n.append(count)
                ids.append(hashlib.sha256(decimal.encode()).hexdigest())
                back.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    extra[0].append([int(x) for x in decimal.split(",")] if decimal else [])
                    extra[1].append(decoded)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(extra[0], pa.list_(pa.int32())), pa.array(extra[1], pa.string())], [*names, "ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, schema)


def op7_sentencepiece(spark, sf_dir):
    return encoded(table(spark, sf_dir, "documents"))
