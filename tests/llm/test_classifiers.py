from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.language import features, fit_language, has_letter, identify, keep_identified
from tessera.llm.quality import QualityModel, build_dictionary, fit_quality, score_quality
from tessera.llm.training import sample_by_label

WORDS = {
    "en": "the of and to in that with for was this from have which their would there about other into more people could than first been its who now find long down day did get come made may part",
    "de": "der die und das nicht mit sich des auf für ist dem eine als auch nach wie aus bei werden einer hat dass sie über noch einem sein wurde vor zur haben war wenn durch",
    "fr": "les des est une que dans qui pour pas sur plus avec son par mais comme tout fait cette bien être sont deux même nous leur ces entre sans aussi autre peut très",
    "es": "los las una por con para como más pero sus este entre cuando muy sin sobre también hasta hay donde quien desde todo nos durante todos uno ni contra otros ese eso",
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n)).capitalize() + "."


def corpus(spark, rows=320, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, (lang := rng.choice(sorted(WORDS))), sentence(rng, lang, rng.randrange(8, 60))) for i in range(rows)], "doc_id long, label string, text string")


def test_language_on_unseen_texts(spark, odd_docs, no_docs):
    model = fit_language(corpus(spark))
    assert sorted(model.families) == ["germanic", "romance"] and sorted(model.pair_lines) == [("de", "en"), ("es", "fr")]
    unseen = corpus(spark, 200, seed=2)
    got = {r["doc_id"]: r["lang_pred"] for r in identify(unseen, model).collect()}
    assert np.mean([got[r["doc_id"]] == r["label"] for r in unseen.collect()]) > 0.97
    rows = {r["doc_id"]: r for r in identify(odd_docs, model).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (2, 3, 4)) and rows[2**60 + 1]["lang_pred"] in WORDS
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    kept = keep_identified(odd_docs, model, 0.0)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == set(rows) - {2, 3, 4}
    assert identify(no_docs, model).count() == 0
    assert {r["lang_pred"] for r in identify(odd_docs, fit_language(corpus(spark, 0))).collect()} == {"und"}


def test_one_and_many_languages(spark):
    only = fit_language(corpus(spark).where("label = 'fr'"))
    assert {r["lang_pred"] for r in identify(corpus(spark, 20), only).collect()} == {"fr"}
    other = corpus(spark).withColumn("label", F.when(F.col("label") == "en", "xx").otherwise(F.col("label")))
    assert "xx" in fit_language(other).families


def test_features_count_whole_texts(monkeypatch):
    text = "some text, some more. " * 50
    whole = features(text)
    import tessera.llm.language as language

    monkeypatch.setattr(language, "BLOCK", 7)
    assert np.allclose(features(text), whole) and np.isclose((whole**2).sum(), 1)


def test_quality_on_unseen_texts(spark, odd_docs, no_docs):
    rng = random.Random(3)

    def made(i):
        good = rng.random() < 0.7
        text = " ".join(sentence(rng, "en", 12) for _ in range(rng.randrange(1, 12)))
        return (i, int(good), text if good else text.upper().replace(" ", "!! ") if rng.random() < 0.5 else " ".join(["spam"] * rng.randrange(10, 200)))

    df = spark.createDataFrame([made(i) for i in range(600)], "doc_id long, label int, text string")
    model = fit_quality(df.where("doc_id < 400").select("doc_id", "label"), df.select("doc_id", "text"))
    unseen = df.where("doc_id >= 400")
    got = {r["doc_id"]: r["score"] for r in score_quality(unseen, model).collect()}
    assert np.mean([(got[r["doc_id"]] >= 0.5) == (r["label"] == 1) for r in unseen.collect()]) > 0.95
    rows = {r["doc_id"]: r["score"] for r in score_quality(odd_docs, model).collect()}
    assert len(rows) == 10 and all(0 <= s <= 1 for s in rows.values()) and rows[2] == rows[3]
    assert score_quality(no_docs, model).count() == 0
    none = fit_quality(df.where("false").select("doc_id", "label"), df.select("doc_id", "text"))
    assert none == QualityModel() and {r["score"] for r in score_quality(odd_docs, none).collect()} == {0.5}


def test_samples_are_bounded_and_repeatable(spark):
    df = corpus(spark, 300)
    a = sorted(r["doc_id"] for r in sample_by_label(df.select("doc_id", "label"), df.select("doc_id", "text"), 10).collect())
    b = sorted(r["doc_id"] for r in sample_by_label(df.repartition(3).select("doc_id", "label"), df.select("doc_id", "text"), 10).collect())
    assert a == b and len(a) == 40


def test_one_document_does_not_fill_a_sample(spark):
    rows = [(i, "x", f"text {i}") for i in range(200)] + [(500, "x", "again")] * 5000 + [(501, "y", f"of one id {k}") for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, label string, text string")
    got = sample_by_label(df.select("doc_id", "label"), df.select("doc_id", "text"), 50).collect()
    assert len({r["doc_id"] for r in got if r["label"] == "x"}) == 50 == sum(r["label"] == "x" for r in got)
    assert sum(r["label"] == "y" for r in got) == 50
    small = sample_by_label(df.select("doc_id", "label"), df.select("doc_id", "text"), 50, most_rows=20).collect()
    assert len(small) == 20
    few = sample_by_label(df.select("doc_id", "label"), df.select("doc_id", "text"), 50, most_bytes=200).collect()
    assert 2 <= len(few) <= 42 and {r["label"] for r in few} == {"x", "y"}


def test_a_hundred_languages_are_all_learned(spark):
    rng = random.Random(4)
    words = {f"q{k:02d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(12)] for k in range(100)}
    text = lambda c: " ".join(rng.choices(words[c], k=30))
    rows = [(100 * n + k, c, text(c)) for k, c in enumerate(words) for n in range(12 - k // 12)]
    model = fit_language(spark.createDataFrame(rows, "doc_id long, label string, text string"))
    assert len(model.families) == 100
    unseen = [(k, text(c)) for k, c in enumerate(words)]
    got = {r["doc_id"]: r["lang_pred"] for r in identify(spark.createDataFrame(unseen, "doc_id long, text string"), model).collect()}
    assert np.mean([got[k] == c for k, c in enumerate(words)]) > 0.95


def test_only_letters_are_letters():
    assert not any(map(has_letter, "² ½ Ⅷ ① 12 _ 🙂 \u0301 \n".split(" "))) and all(map(has_letter, "a é 漢 ª ʰ ا ß".split(" ")))


def test_labels_that_show_at_the_end_of_long_texts_only(spark):
    """The whole of a text counts, in fitting and in scoring."""
    rng = random.Random(6)
    shared = " ".join(rng.choices(WORDS["en"].split(), k=18_000))
    end = lambda good: " ".join(rng.choices((WORDS["fr"] if good else WORDS["de"]).split(), k=900))
    rows = [(i, i % 2, shared[i : 90_000 + i] + end(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, label int, text string")
    model = fit_quality(df.where("doc_id < 40").select("doc_id", "label"), df.select("doc_id", "text"))
    got = {r["doc_id"]: r["score"] for r in score_quality(df.where("doc_id >= 40"), model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(i % 2) for i in range(40, 60)]) > 0.9
    kinds = df.select("doc_id", F.when(F.col("label") == 1, "fr").otherwise("de").alias("label"), "text")
    language = fit_language(kinds.where("doc_id < 40"))
    told = {r["doc_id"]: r["lang_pred"] for r in identify(kinds.where("doc_id >= 40"), language).collect()}
    assert np.mean([told[i] == ("fr" if i % 2 else "de") for i in range(40, 60)]) > 0.9


def test_dictionaries_are_drawn_from_all_parts_of_texts():
    texts = ["".join(chr(97 + k % 26) * 64 for k in range(26)) for _ in range(400)]
    found = build_dictionary(texts, 64 * 520)
    counts = [found.count(bytes([97 + k]) * 64) for k in range(26)]
    assert len(found) == 64 * 520 and min(counts) > 5 and build_dictionary(["ab", "cd"]) == b"ab\ncd"
