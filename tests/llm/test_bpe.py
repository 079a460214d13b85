from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.bpe import Automaton, decode_ids, encode_texts, load, round_trip

SOURCE = load(public_tokenizers.path("byte_bpe_50k.json"))
OURS, THEIRS = Automaton(SOURCE), Tokenizer.from_str(SOURCE)


def same(text):
    ids = OURS.encode(text)
    assert ids == THEIRS.encode(text, add_special_tokens=False).ids
    assert OURS.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False) == text


@given(st.text(max_size=60))
@settings(max_examples=500, deadline=None)
def test_any_text(text):
    same(text)


@given(st.lists(st.sampled_from(["a", "aa", "the", " ", "  ", "\n", "'s", "'S", "12", "é", "漢", "🙂", "<|endoftext|>", "<|endof", "ing", "\x1c", "\x85", "ization", "²", "՘"]), max_size=30))
@settings(max_examples=500, deadline=None)
def test_runs_of_pieces(parts):
    same("".join(parts))


def test_long_words_and_small_memories(monkeypatch):
    same("a" * 30_000)
    same("abcdefgh" * 2000)
    import tessera.llm.bpe as bpe

    for limit in ("KEPT_WORDS", "KEPT_STEPS"):
        monkeypatch.setattr(bpe, limit, 2)
    for t in ("tokenization of unusual words", "another unusual tokenization"):
        same(t)


def test_every_token_reads_back():
    for label in OURS.labels.values():
        try:
            same(label.decode())
        except UnicodeDecodeError:
            pass


def test_odd_documents(spark, odd_docs, no_docs):
    rows = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    encoded = encode_texts(odd_docs, SOURCE)
    for r in encoded.collect():
        assert r["ids"] == THEIRS.encode(rows[r["doc_id"]], add_special_tokens=False).ids
    assert {r["doc_id"]: r["text"] for r in decode_ids(encoded, SOURCE).collect()} == rows
    for r in round_trip(odd_docs, SOURCE).collect():
        ids = THEIRS.encode(rows[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest()
    assert round_trip(no_docs, SOURCE).count() == encode_texts(no_docs, SOURCE).count() == 0


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        Automaton(SOURCE.replace('"ByteLevel"', '"Other"', 1))
