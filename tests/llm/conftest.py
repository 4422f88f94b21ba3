from __future__ import annotations

import pytest
from pyspark.sql import types as T

from merchantry.llm.common import prepare

#: Columns of documents, and further ones whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key long, n long, sig long, digest string, body string, kept boolean, `at` int"


@pytest.fixture(scope="session")
def session(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def documents(session):
    """Rows (doc_id, text[, lang, source]) as a documents table with further columns of clashing names."""
    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or ""), 7, None, 5, 1, "x", None, True, 3) for r in rows]
        return session.createDataFrame(full, T._parse_datatype_string(SCHEMA)).repartition(parts)
    return make


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
