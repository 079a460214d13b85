from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.language import FAMILY_OF
from tessera.llm.stages import language_stage

SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi xo zu an er is ol um".split()


def test_gibberish_goes_and_short_clean_texts_stay_for_few_and_many_languages(spark):
    for codes in (["en", "de", "fr", "es"], [c for c in FAMILY_OF if c != "no"][:16]):
        rng = random.Random(8)
        words = {c: ["".join(rng.sample(SYLLABLES, rng.randrange(1, 4))) for _ in range(60)] for c in codes}
        text = lambda c, n: " ".join(rng.choice(words[c]) for _ in range(n))
        rows = [(i, text(c := codes[i % len(codes)], rng.randrange(20, 80)), c) for i in range(40 * len(codes))]
        short = [(10_000 + i, text(c := codes[i % len(codes)], 6), c) for i in range(32)]
        junk = [(20_000 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(400)), codes[i % len(codes)]) for i in range(32)]
        junk += [(30_000, "안전한 문장은 여기에 있습니다", None), (30_001, "12 %%", None)]
        docs = spark.createDataFrame(rows + [(i, t, None) for i, t, _ in short + junk], "doc_id long, text string, lang string")
        kept = {r["doc_id"] for r in language_stage(spark, docs, "").select(F.col("doc_id")).collect()}
        assert not kept & {i for i, *_ in junk}, len(codes)
        assert {i for i, *_ in rows + short} <= kept, len(codes)


def test_stages_on_odd_and_on_no_documents(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        kept, none = stage(spark, odd_docs, ""), stage(spark, no_docs, "")
        assert none.count() == 0
        if name == "tokens":
            assert kept.columns == none.columns == ["doc_id", "n_tokens", "ids"] and kept.count() == odd_docs.count()
        else:
            assert kept.columns == none.columns == odd_docs.columns
            assert {str(r) for r in kept.collect()} <= {str(r) for r in odd_docs.collect()}
            if name == "dedup":
                assert kept.count() == 7  # of 2, 3 and 4 one, of 6, 7 and 7 one
