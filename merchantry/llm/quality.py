"""Quality rules: how far a document's character and word histograms are from its language.

Each document gets two histograms: characters by class, and words by a list of common words of its
language (all other words count as one entry). The references are the summed histograms of all documents
of a language that pass the base rules. A document is rejected by a base rule, or when its
Jensen-Shannon distance to the reference of its language is above a threshold; documents under a minimum
length are not judged by distance, as short texts are far from any reference by chance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.llm.common import prepare, table, tidied
from merchantry.session import cut_lineage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 8
OTHER = "other"

# Frequent function words; a language without a list is judged by characters only.
COMMON_WORDS = {
    "en": "the of and to a in is that for it was on with as by at from an or be this which are not have".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split(),
    "fr": "de la le et les des en un une du est que qui dans pour par sur au pas plus ne se ce il avec".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero".split(),
}

CLASSES = ("vowel", "consonant", "upper", "other letter", "digit", "blank", "line end", "stop", "symbol", "rest")


def _class_table() -> np.ndarray:
    out = np.full(0x10000, CLASSES.index("rest"), np.uint8)
    for code in range(0x10000):
        c = chr(code)
        if c in "aeiou":
            out[code] = 0
        elif "a" <= c <= "z":
            out[code] = 1
        elif "A" <= c <= "Z":
            out[code] = 2
        elif 0xD800 <= code < 0xE000:
            continue
        elif c.isalpha():
            out[code] = 3
        elif c.isdigit():
            out[code] = 4
        elif c in " \t ":
            out[code] = 5
        elif c in "\n\r":
            out[code] = 6
        elif c in ".,;:!?'\"()-":
            out[code] = 7
        elif c.isprintable() and code < 0x3000:
            out[code] = 8
    return out


CLASS_OF = _class_table()


@dataclass
class Rules:
    """Parameters of the verdict."""
    least_words: int = 20
    most_repeated_pct: int = 30
    #: Greatest distance (0 to 1) of the character classes, and of the common words.
    most_char_distance: float = 0.28
    most_word_distance: float = 0.28
    #: Documents under these lengths are not judged by distance.
    least_chars_judged: int = 300
    least_words_judged: int = 120
    common_words: dict[str, list[str]] = field(default_factory=lambda: COMMON_WORDS)

    def group(self, lang: str | None) -> str:
        return lang if lang in self.common_words else OTHER


def repeated_words(words: list[str]) -> int:
    """Words inside 8-word windows that the text has twice or more, each word once."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + ids[i:i + n]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    seen: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(maybe):
        seen.setdefault(tuple(words[i:i + WINDOW]), []).append(i)
    edges = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            edges[places] += 1
            edges[np.array(places) + WINDOW] -= 1
    return int((np.cumsum(edges)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            if line in seen:
                n += 1
            seen.add(line)
    return n


def base(text: str | None) -> dict:
    """The contract's counts of one text; null has no words."""
    text = text or ""
    words = WORD.findall(text)
    return {
        "words": words, "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": duplicate_lines(text), "n_repeat_words": repeated_words(words),
    }


def base_failed(one: dict, rules: Rules) -> bool:
    return one["n_words"] < rules.least_words or 100 * one["n_repeat_words"] > rules.most_repeated_pct * one["n_words"]


def char_histogram(text: str | None) -> np.ndarray:
    codes = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
    return np.bincount(CLASS_OF[np.minimum(codes, 0xFFFF)], minlength=len(CLASSES))


def word_histogram(text: str | None, common: dict[str, int]) -> np.ndarray:
    """Counts of the common words, then of all other words."""
    words = WORD.findall((text or "").lower())
    at = [i for i in map(common.get, words) if i is not None]
    out = np.bincount(at, minlength=len(common) + 1) if at else np.zeros(len(common) + 1, np.int64)
    out[-1] = len(words) - len(at)
    return out


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """Jensen-Shannon distance to base 2; 0 if either histogram is empty."""
    if not a.sum() or not b.sum():
        return 0.0
    p, q = a / a.sum(), b / b.sum()
    m = (p + q) / 2
    part = lambda x: float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum())
    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


FEATURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, chars array<long>, words array<long>"


def _histograms(text: str | None, group: str, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    common = {w: i for i, w in enumerate(rules.common_words.get(group, []))}
    return char_histogram(text), word_histogram(text, common)


def features(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document with its counts and histograms. Stored, so that texts are read once."""
    prepare(docs.sparkSession)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                one, group = base(text), rules.group(lang)
                chars, words = _histograms(text, group, rules)
                rows.append({"doc_id": doc_id, "lang": group, **{k: one[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}, "base_failed": base_failed(one, rules), "chars": chars.tolist(), "words": words.tolist()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_FEATURES_ARROW)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, FEATURES)


_FEATURES_ARROW = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *((k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("chars", pa.list_(pa.int64())), ("words", pa.list_(pa.int64()))])


def references(found: DataFrame, rules: Rules) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Summed histograms by language of the documents that pass the base rules: one pair of short
    arrays for each listed language and one for all others, so the driver gets a bounded number."""
    longest = max([len(CLASSES), *(len(w) + 1 for w in rules.common_words.values())])
    sums = [F.sum(F.try_element_at(c, F.lit(i + 1))).alias(f"{c}{i}") for c in ("chars", "words") for i in range(longest)]
    out = {}
    for row in found.where("NOT base_failed").groupBy("lang").agg(*sums).collect():
        n_words = len(rules.common_words.get(row.lang, [])) + 1
        out[row.lang] = tuple(np.array([row[f"{c}{i}"] or 0 for i in range(n)], np.float64) for c, n in (("chars", len(CLASSES)), ("words", n_words)))
    return out


def distances(chars: np.ndarray, words: np.ndarray, n_words: int, group: str, refs: dict, rules: Rules) -> tuple[float, float]:
    """Distances that count; 0 where the document is too short or its language has no reference."""
    if group not in refs:
        return 0.0, 0.0
    by_chars = distance(np.asarray(chars, float), refs[group][0]) if sum(chars) >= rules.least_chars_judged else 0.0
    by_words = distance(np.asarray(words, float), refs[group][1]) if n_words >= rules.least_words_judged and rules.common_words.get(group) else 0.0
    return by_chars, by_words


def quality(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: the base counts, base_failed, both distances, kept.

    A null or empty text has no words and fails the base rules; a null or unlisted language is judged by
    characters against all such documents; very long texts are read whole; distances equal to a threshold pass; repeated rows
    are judged alike, and each counts in the references; further columns are not looked at; an empty table gives an empty
    result."""
    rules = rules or Rules()
    found = cut_lineage(features(docs, rules, id_col, text_col, lang_col), "quality")
    refs = references(found, rules)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [distances(c, w, n, g, refs, rules) for c, w, n, g in zip(*(batch.column(k).to_pylist() for k in ("chars", "words", "n_words", "lang")), strict=True)]
            fine = [a <= rules.most_char_distance and b <= rules.most_word_distance and not f for (a, b), f in zip(both, batch.column("base_failed").to_pylist(), strict=True)]
            columns = [batch.column(k) for k in names] + [pa.array([a for a, _ in both], pa.float64()), pa.array([b for _, b in both], pa.float64()), pa.array(fine, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "char_distance", "word_distance", "kept"])

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return found.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean")


def keep_good(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The input rows that pass, with all their columns, as quality() judges them: rows with a null or empty text go, as does an
    empty table's nothing. The second reading judges each row in place, so no text is shuffled."""
    rules = rules or Rules()
    refs = references(cut_lineage(features(docs, rules, id_col, text_col, lang_col).select("lang", "base_failed", "chars", "words"), "quality"), rules)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for lang, text in zip(batch.column(lang_col).to_pylist(), batch.column(text_col).to_pylist(), strict=True):
                one, group = base(text), rules.group(lang)
                a, b = (0.0, 0.0) if base_failed(one, rules) else distances(*_histograms(text, group, rules), one["n_words"], group, refs, rules)
                fine.append(not base_failed(one, rules) and a <= rules.most_char_distance and b <= rules.most_word_distance)
            yield batch.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_divergence(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"))
