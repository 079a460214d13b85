from __future__ import annotations

from collections import Counter, defaultdict

import public_tokenizers
from test_alike import slow_groups
from test_mixing import targets
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    rows = [(i, f"The text number {i} is about the {i * 7} things that people of the town have made, and what they did with them in year {1900 + i}.", "en", f"s{i % 3}") for i in range(60)]
    rows += [(i, f"Der Text Nummer {i} ist über die {i * 5} Dinge, die sich in der Stadt nicht ändern, und was mit ihnen auf der Straße geschah.", "de", f"s{i % 3}") for i in range(60, 120)]
    rows += [(200 + i, rows[i][1], "en", "s0") for i in range(10)]  # copies
    rows += [(300, "1234 5678 !!!", "en", "s0"), (301, None, None, "s1"), (302, 'The people of the harbour keep all of their boats in this place over winter. token = "0123456789abcdef0123"', "en", "s1"), (303, rows[2][1] + " Again.", "en", "s1")]
    docs = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(f"file://{tmp_path}/{name}")
        out = spark.read.parquet(f"file://{tmp_path}/{name}")
        if name != "tokens":
            assert out.columns == docs.columns
        kept.append(out.collect())
        docs = out
    language, dedup, secrets, mixing, tokens = kept
    assert {r["doc_id"] for r in language} == {i for i, *_ in rows} - {300, 301}
    groups = slow_groups(sorted((r["doc_id"], r["text"]) for r in language))
    assert sorted(r["doc_id"] for r in dedup) == sorted(i for i, g in groups.items() if i == g) and not {r["doc_id"] for r in dedup} & {*range(200, 210), 303}
    said, before = ({r["doc_id"]: r["text"] for r in x} for x in (secrets, dedup))
    assert said == before | {302: before[302].replace("0123456789abcdef0123", "[assign]")} and all(r["n_chars"] == len(r["text"]) for r in secrets)
    size, taken = defaultdict(int), defaultdict(int)
    for part, sums in ((secrets, size), (mixing, taken)):
        for r in part:
            sums[r["source"]] += len(r["text"].split())
    longest = max(len(t.split()) for t in said.values())
    want = targets(dict(size))
    assert all(r["text"] == said[r["doc_id"]] for r in mixing) and all(want[s] - longest < taken[s] <= want[s] for s in size)
    assert max(Counter(r["doc_id"] for r in mixing).values()) <= 2
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    ids = sorted((r["doc_id"], library.encode(r["text"], add_special_tokens=False).ids) for r in mixing)
    assert sorted((r["doc_id"], list(r["ids"])) for r in tokens) == ids and all(r["n_tokens"] == len(r["ids"]) for r in tokens)
