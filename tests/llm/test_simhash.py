from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm.common import pick
from tessera.llm.components import components
from tessera.llm.simhash import REACH, WIDE, allocate, likeness, near_copies, near_links, probe_rows, simhash_groups, simhash_text, wide_candidates


def slow_hash(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {n: root(n) for n in nodes}


def test_fingerprints():
    for t in (None, "", " \n", "One", "one two", "A b\tC d e A B c", "é É ß\x1cx\x85y z", "x" * 5000, "many words " * 3000):
        assert simhash_text(t) == slow_hash(t), t


def test_links_equal_brute_force_in_sparse_and_dense_buckets(spark):
    random.seed(1)
    fps = [random.getrandbits(64) for _ in range(150)]
    for _ in range(150):  # near others
        fps.append(random.choice(fps) ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)))
    centre = random.getrandbits(64)
    fps += [centre ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for _ in range(200)]
    fps = sorted(set(fps))
    known = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, node long")
    want = slow_components(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    for parts, dense in ((None, 64), (2, 4), (3, 1), (3, 1000)):
        found = {r["id"]: r["component"] for r in components(near_links(known, 2, parts, dense)).collect()}
        assert {i: found.get(i, i) for i in want} == want, (parts, dense)


def test_groups_of_odd_documents(spark, odd_docs, no_docs):
    rows = pick(odd_docs, doc_id="doc_id", text="text").collect()
    got = simhash_groups(odd_docs).collect()
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64) for r in got) == sorted((str(r["doc_id"]), slow_hash(r["text"])) for r in rows)
    by_id = {r["doc_id"]: r["component_id"] for r in got}
    assert by_id[2] == by_id[3] == by_id[4] == 2 and by_id[6] == by_id[7] == 6 and by_id[None] is None and by_id[2**60 + 1] == 2**60 + 1
    assert simhash_groups(no_docs).count() == 0


def test_thresholds_are_the_cheapest_that_suffice():
    rng = np.random.default_rng(0)
    cost = np.cumsum(rng.random((50, 3, 4)), axis=2)
    got = allocate(cost, 2)
    assert (got.sum(axis=1) == 0).all()
    options = [(a, b, c) for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3) if a + b + c == 0]
    for row, g in zip(cost, got):
        price = lambda o: sum(row[i, 1 + t] for i, t in enumerate(o))
        assert np.isclose(price(g), min(map(price, options)))


def test_long_chains_become_one_component(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in components(links).collect()} == {0}


def test_wide_search_meets_all_pairs_within_its_bits(spark):
    random.seed(2)
    fps = [random.getrandbits(64) for _ in range(200)]
    for _ in range(200):
        f = random.choice(fps[:200])
        for bit in random.sample(range(64), random.randrange(1, 16)):
            f ^= 1 << bit
        fps.append(f)
    fps = sorted(set(fps))
    known = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, node long")
    got = {(r["a"], r["b"]) for r in wide_candidates(known).collect()}
    far = {(i, j): (fps[i] ^ fps[j]).bit_count() for i in range(len(fps)) for j in range(i + 1, len(fps))}
    assert {p for p, d in far.items() if d <= WIDE} <= got <= {p for p, d in far.items() if d <= REACH}


def test_wide_search_holds_a_dense_group_together(spark):
    random.seed(3)
    centre = random.getrandbits(64)
    fps = {centre}
    while len(fps) < 600:
        f = centre
        for bit in random.sample(range(64), 3):
            f ^= 1 << bit
        fps.add(f)
    known = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(sorted(fps))], "fp long, node long")
    pairs = wide_candidates(known, dense=16)
    assert pairs.count() <= 2 * probe_rows(known, WIDE, most=2).count()
    assert {r["component"] for r in components(pairs).collect()} == {0} and components(pairs).count() == 600


def edited(words, n):
    out = list(words)
    for at in random.sample(range(len(out)), n):
        out[at] = f"new{random.randrange(10**9)}"
    return out


def test_near_copies_at_a_likeness_of_four_fifths_are_found_and_others_stay(spark, odd_docs, no_docs):
    random.seed(4)
    rows, near = [], {}
    for k in range(60):
        words = [f"w{random.randrange(3000)}" for _ in range(300)]
        rows.append((10 * k, " ".join(words)))
        rows.append((10 * k + 1, " ".join(edited(words, 5))))
        rows.append((10 * k + 2, " ".join(words[:150] + [f"w{random.randrange(3000)}" for _ in range(150)])))
        assert likeness(rows[-3][1], rows[-2][1]) >= 0.8 > likeness(rows[-3][1], rows[-1][1])
        near |= {10 * k: 10 * k, 10 * k + 1: 10 * k, 10 * k + 2: 10 * k + 2}
    got = {r["doc_id"]: r["component_id"] for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() == near.keys()
    right = sum(got[i] == c for i, c in near.items() if i % 10 == 1)
    assert right >= 57 and all(got[i] == i for i in near if i % 10 != 1)
    by_id = {r["doc_id"]: r["component_id"] for r in near_copies(odd_docs).collect()}
    assert by_id[2] == by_id[3] == by_id[4] == 2 and by_id[6] == by_id[7] == 6 and by_id[None] is None
    assert near_copies(no_docs).count() == 0


def test_likeness_of_short_and_missing_texts():
    assert likeness(None, "") == 1.0 and likeness("a", None) == 0.0 and likeness("A b", "a  B") == 1.0
    assert likeness("a b c d e f", "a b c d e g") == 1 / 3
