from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np

from tessera.llm.common import pick
from tessera.llm.sharding import find_splitters, shard_by_bytes


def check(df, shards=16, spread=None, **more):
    rows, got = pick(df, doc_id="doc_id", text="text").collect(), shard_by_bytes(df, shards, **more).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows)
    slots, sizes = defaultdict(list), [0] * shards
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    if spread:
        assert max(sizes) - min(sizes) <= spread, sizes
    return got


def test_odd_documents(odd_docs, no_docs):
    check(odd_docs)
    assert shard_by_bytes(no_docs).count() == 0


def test_sizes_are_near_equal_with_a_hot_text(spark):
    random.seed(4)
    rows = [(i, "x" * random.randrange(400)) for i in range(3000)] + [(10_000 + i, "copy " * 40) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    total = sum(len(t) + 1 for _, t in rows)
    check(df, spread=0.02 * total / 16 + 400)
    check(df, spread=0.02 * total / 16 + 400, part_rows=50, most_parts=5)


def test_small_groups_stay_together(spark):
    rows = [(i, f"text {i // 3}") for i in range(6000)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    at = defaultdict(set)
    for r in got:
        at[r["doc_id"] // 3].add(r["shard"])
    assert all(len(s) == 1 for s in at.values())


def test_splitters(spark):
    keys = np.random.default_rng(1).integers(0, 1 << 62, 5000)
    df = spark.createDataFrame([(int(k), 10) for k in keys], "key long, size long")
    found = find_splitters(df, 50_000, 8, np.full(7, 10.0), probes=16)
    below = [10 * int((keys < f).sum()) for f in found]
    assert all(abs(b - 6250 * (i + 1)) <= 10 for i, b in enumerate(below))
