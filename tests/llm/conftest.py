from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, size string, key string, shard string, label string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank and very long texts, ties, repeated rows, a null id, and columns whose names clash."""
    long_text = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
    rows = [
        (2**60 + 1, "The first text of some words, as it is read.", "en", "b"),
        (2, None, None, None),
        (3, "", "en", "b"),
        (4, " \t\n ", "de", None),
        (5, long_text, "en", "a"),
        (6, "equal words in this text, again and again", "en", "a"),
        (7, "equal words in this text, again and again", "en", "b"),
        (7, "equal words in this text, again and again", "en", "b"),
        (None, "a row without an id", "en", "ä"),
        (9, "x" * 50_000, "fr", "a"),
        (10, "Ünïcödé 漢字 🙂 <|endoftext|> don't  stop", "fr", "😀"),
    ]
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), "other", "1", "k", "s", "q") for i, t, lang, source in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
