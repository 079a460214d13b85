from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.topk import Shard, top_k

SCHEMA = "vec_id long, embedding array<float>, score int, rank string"


def brute(rows, k):
    kept = [(i, [int(np.floor(np.float64(x) * 256)) for x in np.array(v, dtype=np.float32)]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in kept:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in kept if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0, k).collect())


def test_equals_brute_force_with_ties_and_bad_rows(spark):
    random.seed(3)
    rows = [(i, [random.gauss(0, 0.2) for _ in range(8)]) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 420)]  # one very common vector
    rows += [(None, [1.0] * 8), (500, None), (550, [1.0, None] * 4), (600, [float("nan")] * 8), (650, [float("inf")] * 8), (700, [0.0] * 8)]
    assert run(spark, rows) == brute(rows, 5)


def test_fewer_rows_than_k_and_an_empty_table(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    assert run(spark, rows) == [(0, 1, 1, 128 * 256), (0, 2, 2, -256 * 256)]
    assert run(spark, []) == []


def test_sums_beyond_a_double_are_exact(spark):
    rows = [(0, [3.0e6, 1.0]), (1, [3.0e6, 0.25]), (2, [3.0e6, 0.5]), (3, [1.0, 2.0])]
    assert run(spark, rows) == brute(rows, 5)


def test_pruned_search_finds_what_a_full_one_finds():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.standard_exponential((2000, 16)) * rng.integers(0, 2, (2000, 16)) * rng.integers(-1, 2, (2000, 16)))
    shard = Shard(np.arange(2000), x)
    for q in range(0, 200, 10):
        ids, scores = shard.search(q, x[q], 5)
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(2000), -s))[:5]
        assert list(ids) == list(best) and scores == [int(v) for v in s[best]]


def test_huge_components_and_lengths_that_differ(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, -2.0, 4.0]), (50, [2.0]), (3, []), (4, [0.5, 0.25, 1.0, -1.0])]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows] + [(100, [1e307, 1.0]), (7, [-1e307, 1.0])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k(df, F.col("vec_id") % 50 == 0).collect()}
    top = lambda q: [got[q, r] for r in (1, 2, 3)]
    assert (top(0), top(50), top(100)) == tuple([(i, 2**63 - 1) for i in ids] for ids in ((1, 4, 50), (0, 1, 100), (0, 1, 4))) and len(got) == 15
    assert got[100, 4] == (50, 2**63 - 1) and got[100, 5] == (3, 0) and got[50, 4] == (4, 512 * 128)


def test_blocks_that_cannot_hold_a_best_vector_are_skipped():
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (40, 32))
    x = np.floor(256 * (centres[rng.integers(0, 40, 8000)] + rng.normal(0, 0.1, (8000, 32))))
    shard = Shard(np.arange(8000), x)
    for q in range(0, 8000, 400):
        ids, scores = shard.search(q, x[q], 5)
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(8000), -s))[:5]
        assert list(ids) == list(best) and scores == [int(v) for v in s[best]]
    assert shard.read < 0.25 * shard.all
