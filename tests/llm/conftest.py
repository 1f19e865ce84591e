from __future__ import annotations

import pytest

ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\n",
    "word",
    "Repeated row of some words that says a thing",
    "Repeated row of some words that says a thing",
    "tab\tand\x0bfeed\x0c end ",
    "Ünïcode ▁ ß 日本語 😀 text",
    "x" * 5_000,
    " ".join(f"w{i % 37}" for i in range(30_000)),
]


@pytest.fixture
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns whose names clash."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or ""), i, "kept", 1.5, 7) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[5], (None, "no id at all", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, start double, node int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
