from __future__ import annotations

import random
from itertools import count

from pyspark.sql import functions as F

from tessera.llm import alike
from tessera.llm.alike import HUBS, alike_links, describe, gram_set, node_of
from tessera.llm.components import components
from tessera.llm.simhash import likeness, near_copies, simhash_text
from tessera.llm.stages import dedup_stage


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def edited(rng, text, n):
    out = list(text)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**9)}"
    return out


def slow_groups(rows, least=0.8):
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, x) in enumerate(rows):
        for j, y in rows[k + 1 :]:
            if root(i) != root(j) and likeness(x, y) >= least:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in parent}


def test_interleaved_groups_in_one_crowded_bucket_are_all_found(spark):
    """Many texts of the same passage, so that they crowd the same places, in groups whose ids interleave."""
    rng = random.Random(5)
    passage = words(rng, 120)
    heads = [words(rng, 60) for _ in range(12)]
    rows = []
    for i in range(96):
        rows.append((i, " ".join(edited(rng, heads[i % 12], 1) + edited(rng, passage, i % 2))))
    rows += [(100 + i, " ".join(words(rng, 40) + passage)) for i in range(60)]  # unrelated but for the passage
    want = slow_groups(rows)
    assert 60 < len(set(want.values())) < 130
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = describe(df)
    doc = {r["node"]: r["doc_id"] for r in known.where("at is null").collect()}
    assert len(doc) == len(rows)
    for crowd in (1, 4, 1000):
        found = {doc[r["id"]]: r["component"] for r in components(alike_links(df, known, 0.8, crowd)).collect()}
        least = {c: min(i for i, k in found.items() if k == c) for c in found.values()}
        assert {i: least[found[i]] if i in found else i for i in want} == want, crowd


def test_a_large_group_is_not_compared_pair_by_pair(spark):
    rng = random.Random(6)
    base = words(rng, 300)
    rows = [(i, " ".join(edited(rng, base, 1))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links = alike_links(df, describe(df), 0.8, 8)
    assert links.count() < 20 * len(rows)
    assert components(links).agg(F.countDistinct("component"), F.count("*")).first() == (1, 300)


def test_texts_of_one_fingerprint_are_compared_too(spark):
    """A line that repeats drowns the rest of a fingerprint, not of a set of shingles."""
    rng = random.Random(7)
    line = " ".join(words(rng, 11) + ["\n"])
    rows = [(i, line * 60 + " ".join(words(rng, 100))) for i in range(3)]
    rows.append((9, rows[1][1] + " more"))
    assert len({simhash_text(t) for _, t in rows}) < len(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 9: 1}


def test_recall_at_four_fifths_is_whole_however_many_bits_apart(spark):
    rng = random.Random(9)
    rows, far = [], 0
    for k in range(60):
        text = words(rng, 300)
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(edited(rng, text, 6)))]
        far += (simhash_text(rows[-2][1]) ^ simhash_text(rows[-1][1])).bit_count() > 7
        assert likeness(rows[-2][1], rows[-1][1]) >= 0.8
    assert far > 10
    got = {r["doc_id"]: r["component_id"] for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_no_pair_is_left_out_where_a_passage_is_most_of_many_texts(spark):
    """Texts that share 70 to 95 of 100 parts with many others, so that likeness lies on both sides of 0.8, of all sizes."""
    rng = random.Random(12)
    passage = words(rng, 400)
    rows = []
    for i in range(150):
        n = rng.randrange(60, 400)
        rows.append((i, " ".join(words(rng, rng.randrange(1, 40)) + passage[:n] + words(rng, rng.randrange(1, 20)))))
    want = slow_groups(rows)
    assert 3 < len(set(want.values())) < 140
    got = {r["doc_id"]: r["component_id"] for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_rows_of_one_id_with_different_texts_both_stay(spark):
    rng = random.Random(13)
    one, two = (" ".join(words(rng, 50)) for _ in range(2))
    rows = [(1, one, "a"), (1, two, "b"), (1, two, "c"), (2, one + " more", "d"), (None, one, "e"), (None, "alone in the world, and without an id", "f"), (4, None, "g"), (5, "", "h")]
    docs = spark.createDataFrame([(i, t, "en", s, 0, "clash", "x") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, MARK string, node string")
    got = dedup_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got.collect()) == sorted([("1", one), ("1", two), ("None", "alone in the world, and without an id"), ("4", "")])
    assert dedup_stage(spark, docs.where("false"), "").count() == 0


def test_two_that_meet_alone_are_compared_however_many_others_each_meets(spark):
    """A text and its continuation have one shingle in common among their rarest; each meets a text of its own at all others."""
    shingles = lambda t: {int(gram_set(" ".join(t[i : i + 5]))[0]): t[i : i + 5] for i in range(len(t) - 4)}
    for seed in count():
        rng = random.Random(seed)
        short = words(rng, 84)
        own = shingles(short)
        longer = list(short)
        while len(longer) < 104:  # what is added comes before all that both have
            word = f"w{rng.randrange(10**9)}"
            if int(gram_set(" ".join([*longer[-4:], word]))[0]) < min(own):
                longer.append(word)
        others = [" ".join(shingles(longer)[t]) for t in sorted(set(shingles(longer)) - set(own))] + [" ".join(own[t]) for t in sorted(own)[1:17]]
        nodes = sorted(node_of(gram_set(t)) for t in others)
        x, y = (node_of(gram_set(" ".join(t))) for t in (short, longer))
        own_hubs = lambda of: sorted(node_of(gram_set(t)) for t in others if set(gram_set(t)) <= set(gram_set(" ".join(of))))
        if own_hubs(short)[HUBS - 1] < y and own_hubs(longer)[HUBS - 1] < x:
            break
    assert len(nodes) == 36
    rows = [(0, " ".join(short)), (1, " ".join(longer)), *enumerate(others, 2)]
    assert likeness(rows[0][1], rows[1][1]) == 0.8
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [tuple(r) for r in alike_links(df, describe(df), 0.8).collect()] == [(min(x, y), max(x, y))]


def test_copies_that_resemble_the_least_edited_only_are_linked_at_once(spark, monkeypatch):
    """Copies of one text, most of them edited so that two are rarely alike: all are met at the text itself."""
    rng = random.Random(3)
    base = words(rng, 300)
    rows = [(i, " ".join(edited(rng, base, 6 if i else 0))) for i in range(200)]
    assert sum(likeness(rows[k][1], rows[0][1]) >= 0.8 for k in range(200)) > 150
    assert not any(likeness(rows[k][1], rows[k + 1][1]) >= 0.8 for k in range(1, 20))
    asked = []
    monkeypatch.setattr(alike, "may_share", lambda pairs, *a, f=alike.may_share: asked.append(pairs.count()) or f(pairs, *a))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = components(alike_links(df, describe(df), 0.8))
    want = slow_groups(rows)
    assert groups.count() == sum(list(want.values()).count(c) for c in set(want.values()) if list(want.values()).count(c) > 1)
    assert sum(asked) < 20 * len(rows)
