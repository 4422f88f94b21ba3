"""run() against plain loops over the smallest tables."""

from __future__ import annotations

import re

import corpus_pipeline
from merchantry.llm import ngram_join, pii, quality
from merchantry.session import configure
from tests.llm.test_corpus_operators import plain_components
from tests.llm.test_text_operators import WHOLE, plain_best_fit

SF = "/root/testdata/sf0.001"


def test_pipeline(session):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "n-gram Jaccard join", "PII", "best-fit packing"]
    docs = session.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in quality.quality(docs).collect() if r.kept}
    assert 0 < len(kept) < len(rows)
    first = {}
    for d in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[d].text or ""), d)
    left = [(d, rows[d].text) for d in sorted(first.values())]
    ends = [d for d, _, c in plain_components(left) if d == c]
    net = pii.Feistel(pii.key_of(session))
    lengths = {}
    for d in ends:
        ids = [*WHOLE.encode(pii.pseudonymise(rows[d].text, net)[0] or "", add_special_tokens=False).ids, 0]
        lengths[d] = [min(2048, len(ids) - at) for at in range(0, len(ids), 2048)]
    got = corpus_pipeline.run(configure(session), SF).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in got) == sorted((d, k, n) for d in ends for k, n in enumerate(lengths[d]))
    assert len({r.sequence_id for r in got}) == len(plain_best_fit([n for x in lengths.values() for n in x], 2048))


def test_stages_take_odd_tables(documents, session):
    text = " ".join(f"the house of stone {i} and" for i in range(60))
    rows = [(1, text), (2, text), (2, text), (None, text + " x"), (3, None), (4, ""), (5, text + " call +1 (499) 555-6503 now")]
    for table in (documents(rows), documents([])):
        docs, columns = table, table.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(session, docs, SF)
            assert name == "best-fit packing" or out.columns == columns
            out.collect()
            docs = out
    assert ngram_join.keep_one(documents(rows)).count() >= 3
