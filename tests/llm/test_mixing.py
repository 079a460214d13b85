from __future__ import annotations

import random
import re
from collections import defaultdict

from tessera.llm.common import pick
from tessera.llm.mixing import mix_documents, mix_sources


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        part = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] > cap * sizes[s]]
        if not over:
            return out | part
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def check(df):
    rows, got = pick(df, doc_id="doc_id", text="text", source="source").collect(), mix_sources(df).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    want, taken = targets(dict(sizes)), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, r["target"])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 2, s
    assert sorted(map(str, mix_sources(df).collect())) == sorted(map(str, got))


def test_odd_documents(odd_docs, no_docs):
    check(odd_docs)
    assert mix_sources(no_docs).count() == 0


def test_random_sources(spark):
    random.seed(2)
    rows = [(i, "w " * int(random.paretovariate(1) * 5), random.choice(["a", "b", "c", "ä", "Z", None])) for i in range(400)] + [(1000 + i, "x y z", "hot") for i in range(800)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_a_source_of_one_and_of_no_words(spark):
    check(spark.createDataFrame([(1, "one two three", "a"), (2, "", "b"), (3, None, "c")], "doc_id long, text string, source string"))
    check(spark.createDataFrame([(1, "", "a")], "doc_id long, text string, source string"))


def test_documents_of_the_mix(spark, odd_docs):
    copies = {(r["doc_id"]): r["copies"] for r in mix_sources(odd_docs).collect()}
    got = mix_documents(odd_docs)
    assert got.columns == odd_docs.columns
    n = defaultdict(int)
    for r in got.select("doc_id").collect():
        n[r[0]] += 1
    assert n[7] == 2 * copies[7] and all(n[i] == c for i, c in copies.items() if i != 7)


def test_smaller_mixes_are_nested(spark):
    rows = [(i, "w " * (i % 9 + 1), "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    small, large = ({r["doc_id"] for r in mix_sources(df, share=s).where("copies > 0").collect()} for s in (0.3, 0.6))
    assert small < large
