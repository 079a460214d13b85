from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tessera.llm.winnowing import GRAM, WINDOW, edited_likeness, fingerprint_documents, gram_hashes, winnow


def chosen(hashes, window):
    """Winnowing as it is defined: the rightmost smallest of each window."""
    out = []
    for i in range(max(1, len(hashes) - window + 1)) if hashes else []:
        part = hashes[i : i + window]
        at = i + max(k for k, h in enumerate(part) if h == min(part))
        if at not in out:
            out.append(at)
    return [(hashes[p], p) for p in out]


def test_windows_equal_brute_force(spark):
    texts = ["", "one", "one two three", "a b c d", "a a a a a a a a a a a a", "the quick brown fox jumps over the lazy dog again and again and again " * 5, "x" * 100]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", gram_hashes(F.col("text")).alias("h"), winnow(F.col("text")).alias("w")).collect():
        assert [(x["hash"], x["pos"]) for x in r["w"]] == chosen(list(r["h"]), WINDOW), r["text"]


def test_equal_runs_share_a_fingerprint(spark):
    run = " ".join(f"tok{i}" for i in range(GRAM + WINDOW - 1))
    df = spark.createDataFrame([(0, f"q w e {run} r t"), (1, f"{run} z u i o p")], "doc_id long, text string")
    a, b = ({x["hash"] for x in r["fingerprint"]} for r in fingerprint_documents(df).orderBy("doc_id").collect())
    assert a & b


def test_edited_texts(spark, odd_docs, no_docs):
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(docs.collect(), key=lambda r: -r["doc_id"])
    found = {r["doc_id"]: r for r in edited_likeness(docs).collect()}
    for i, r in enumerate(rows):
        text, after = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        got = found[r["doc_id"]]
        assert got["n_chars"] == len(text)
        assert got["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got["near_edited"] <= 1 and 0 <= got["near_next"] <= 1
    assert found[6]["fingerprint"] == found[7]["fingerprint"] and found[7]["near_next"] == 1.0
    assert edited_likeness(no_docs).count() == 0
    assert edited_likeness(odd_docs).count() == odd_docs.count()


def test_many_ranges_keep_the_order(spark):
    from tessera.llm.winnowing import with_next

    df = spark.range(500).select((F.col("id") * 7 % 1000).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    rows, _ = with_next(df, range_rows=20)
    got = {r["doc_id"]: r["next_text"] for r in rows.where("not guard").collect()}
    want = sorted(((r["doc_id"], r["text"]) for r in df.collect()), reverse=True)
    assert got == {want[i][0]: want[(i + 1) % len(want)][1] for i in range(len(want))}
