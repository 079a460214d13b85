"""The rows of the registered queries against plain Python, over the whole tables of a small folder."""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from test_mixing import targets
from test_secrets import slow
from test_simhash import slow_components, slow_hash
from tokenizers import Tokenizer

from tessera.llm.queries import QUERIES
from tessera.llm.winnowing import GRAM, TOKEN, WINDOW

FOLDER = os.environ.get("TESSERA_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()}


def rows_of(spark, name):
    got = [r.asDict() for r in QUERIES[name](spark, FOLDER).collect()]
    return {r["doc_id"]: r for r in got}, len(got)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def fold_longs(values, seed=42):
    """Spark's xxhash64 of an array of longs."""
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return seed


def fingerprint(text):
    """Winnowing as it is defined, over cyclic-polynomial hashes rolled along the text."""
    tokens = [signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in re.findall(rf"[^\x20\x09-\x0D]{{1,{TOKEN}}}", text)]
    turn = lambda x, by: (x << by | x >> (64 - by)) & (2**64 - 1) if by else x
    if len(tokens) < GRAM:
        grams = [signed(fold_longs(tokens))] if tokens else []
    else:
        h, grams = 0, []
        for i, t in enumerate(tokens):
            h = turn(h, 1) ^ (t % 2**64)
            if i >= GRAM:
                h ^= turn(tokens[i - GRAM] % 2**64, GRAM)
            if i >= GRAM - 1:
                grams.append(signed(h))
    places = []
    for i in range(max(1, len(grams) - WINDOW + 1)) if grams else []:
        part = grams[i : i + WINDOW]
        at = i + max(k for k, g in enumerate(part) if g == min(part))
        if at not in places:
            places.append(at)
    return [(grams[p], p) for p in places]


def name_of(chosen):
    seed = 42
    for h, pos in chosen:
        seed = xxhash.xxh64_intdigest(struct.pack("<i", pos), xxhash.xxh64_intdigest(struct.pack("<q", h), seed))
    return f"{seed:016x}"


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a or b else 1.0


def test_winnowing(spark, docs):
    got, n = rows_of(spark, "op2_winnow")
    assert n == len(docs)
    order = sorted(docs, reverse=True)
    for k, i in enumerate(order):
        text, after = docs[i]["text"] or "", docs[order[(k + 1) % len(order)]]["text"] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, following = fingerprint(text), fingerprint(edited), fingerprint(after)
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(edited))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (name_of(own), name_of(other)), i
        assert r["near_edited"] == pytest.approx(likeness(own, other)) and r["near_next"] == pytest.approx(likeness(own, following))


def test_simhash(spark, docs):
    got, n = rows_of(spark, "op4_simhash")
    fps = {i: slow_hash(r["text"]) for i, r in docs.items()}
    want = slow_components(sorted(docs), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert n == len(docs) and {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{fps[i]:016x}", want[i]) for i in docs}


def test_secrets(spark, docs):
    got, n = rows_of(spark, "op5_secrets")
    assert n == len(docs)
    for i, r in docs.items():
        spans = slow(r["text"] or "")
        kinds = ["assign", "access", "hex"]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], kinds.index(s[0]))))
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in spans) for k in kinds]
        assert got[i]["base_sha256"] == sha(listed) and ",".join(s for s in got[i]["spans"].split(",") if not s.startswith("novel")) == listed


def test_bpe(spark, docs):
    got, n = rows_of(spark, "op6_bpe")
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    assert n == len(docs)
    for i, r in docs.items():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_mix(spark, docs):
    got, n = rows_of(spark, "op7_mix_sources")
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, r in docs.items():
        size = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] += size
        taken[r["source"]] += got[i]["taken"]
        assert got[i]["size"] == size and 0 <= got[i]["taken"] <= 2 * size
    want = targets(dict(sizes))
    assert n == len(docs) and all((got[i]["source_size"], got[i]["target"]) == (sizes[r["source"]], pytest.approx(want[r["source"]])) for i, r in docs.items())
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)


def test_shards(spark, docs):
    got, n = rows_of(spark, "op8_shard")
    slots, sizes = defaultdict(list), [0] * 16
    for i, r in docs.items():
        raw = (r["text"] or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["law"], got[i]["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        slots[got[i]["shard"]].append(got[i]["slot"])
        sizes[got[i]["shard"]] += len(raw) + 1
    assert n == len(docs) and set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    longest = max(r["size"] for r in got.values())
    assert max(sizes) - min(sizes) <= 2 * longest + 0.02 * sum(sizes) / 16


def crc(i):
    return zlib.crc32(str(i).encode())


def test_quality(spark, docs):
    got, n = rows_of(spark, "op9_quality")
    assert n == len(docs) and all(r["held_out"] == (crc(i) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for i, r in got.items())
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{FOLDER}/labels.parquet").to_pylist()}
    known = [i for i in labels if crc(i) % 3 == 1 and labels[i] in (0, 1)]
    assert np.mean([got[i]["predicted"] == labels[i] for i in known]) > 0.75


def test_language(spark, docs):
    got, n = rows_of(spark, "op10_language")
    learned = {r["lang"] for i, r in docs.items() if r["lang"] and crc(i) % 4 != 2}
    assert n == len(docs)
    for i, r in docs.items():
        told = got[i]["lang_pred"]
        assert got[i]["held_out"] == (crc(i) % 4 == 2) and 0 <= got[i]["score"] <= 1
        assert told in learned if any(c.isalpha() for c in r["text"] or "") else told == "und"
    known = [i for i, r in docs.items() if r["lang"] and crc(i) % 4 == 2 and got[i]["lang_pred"] != "und"]
    assert np.mean([got[i]["lang_pred"] == docs[i]["lang"] for i in known]) > 0.9
