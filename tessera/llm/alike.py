"""All pairs of texts that share most of their word shingles, met at their rarest shingles: nothing is left to chance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import discard, give_back, pieces, settle, written
from tessera.llm.components import components

#: Shingles are counted in 2 ** SKETCH_BITS counters in each task, whatever the number of texts.
SKETCH_BITS = 23
#: Nodes that are the most central, the smallest or the greatest at a shingle, those that share most of a set's rarest
#: shingles, that it is compared with first.
HUBS = 8
#: A shingle that more texts meet at is searched by size of their sets, and between groups only.
CROWD = 32
#: Ratio of the sizes that fall together there.
STEP = 1.02
#: Bits of a set's signature.
SIGNATURE = 2048
#: Texts that a task remembers; rows of a table that are broadcast at most, and else joined by shuffles.
SEEN, FEW = 50_000, 250_000


def gram_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The XXH64 hashes of a text's different word shingles, sorted; words and short texts as in simhash_text."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes, these see ASCII only
    if not words:
        return np.zeros(0, dtype="<i8")
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a : b - 1]) for a, b in zip([0, *ends[: n - 1]], ends[-n:], strict=True)], dtype="<u8").view("<i8"))


def node_of(grams: np.ndarray) -> int:
    """What a set of shingles is called: n different sets share a name with a chance of n * n / 2 ** 65."""
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def signature(grams: np.ndarray) -> np.ndarray:
    """A bit for each value of the lowest bits that the set's hashes have, as longs."""
    bits = np.zeros(SIGNATURE, dtype=np.uint8)
    bits[grams.view(np.uint64) & np.uint64(SIGNATURE - 1)] = 1
    return np.packbits(bits).view("<i8")


def _counter(grams: np.ndarray) -> np.ndarray:
    return (grams.view(np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int32)


def _longs(values: list[int]) -> pa.Array:
    return pa.array(values, type=pa.int64())


def describe(texts: DataFrame, fingerprint: Callable[[str | None], int] = lambda text: 0) -> DataFrame:
    """(doc_id, mark, node, fp, size, bits, at, n), written, of (doc_id, text): a row for each text, with a hash of it, the name of its
    set of five-word shingles, its fingerprint as a long, and the size and signature of the set; and from each task, with `at` and n only, the
    counters of shingles that stand out, which are those of shingles that many texts have. All texts are counted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
        for b in pieces(batches, 2):
            texts, none = b.column(2).to_pylist(), pa.nulls(b.num_rows)
            sets = [gram_set(t) for t in texts]
            for g in sets:
                sums[_counter(g)] += 1  # two of a text's shingles in one counter count once
            fps = pa.array(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))
            width = SIGNATURE // 64
            bits = pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(sets) + 1, width, dtype=np.int32)), pa.array(np.concatenate([signature(g) for g in sets])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _longs([node_of(g) for g in sets]), fps, pa.array(map(len, sets), type=pa.int32()), bits, none.cast(pa.int32()), none.cast(pa.int64())], names=names)
        usual = sums.mean()
        at = np.flatnonzero(sums > usual + 4 * usual**0.5 + 0.5).astype(np.int32)
        empty = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, empty.cast(pa.int32()), pa.nulls(len(at), pa.list_(pa.int64())), pa.array(at), pa.array(sums[at].astype(np.int64))], names=names)
        del sums
        give_back()

    names = ["doc_id", "mark", "node", "fp", "size", "bits", "at", "n"]
    return written(_marked(texts).mapInArrow(work, "doc_id long, mark long, node long, fp long, size int, bits array<bigint>, at int, n long"), "alike-texts")


def _marked(texts: DataFrame) -> DataFrame:
    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def needed(size: float | Column, least: float, ceil=np.ceil):
    """How many of a text's `size` shingles another must have to be alike to `least`."""
    return ceil(size * least - 1e-9)


def levels(known: DataFrame) -> np.ndarray:
    """A level from 0 to 255 for each counter of shingles: the more texts have them, the higher. It only orders shingles, so
    that counters which many shingles share do no harm but to speed."""
    level = F.least(F.floor(F.log2("n") * 4).cast("int") + 1, F.lit(255))
    found = known.where("at is not null").groupBy("at").agg(F.sum("n").alias("n")).where("n >= 8").select("at", level.alias("level")).toArrow()  # up to 2 ** SKETCH_BITS
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    out[found["at"].to_numpy()] = found["level"].to_numpy()
    return out


def rarest(texts: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(token, node, rest, size, common) for each shingle of a set by which it can meet another: so many of its rarest that
    two sets alike to `least` have one of them in common. rest: how many of its shingles come from this one on. common: the
    set's place by the mean level of its shingles, then by name; of the copies of one text, the least edited has the highest.
    Of equal texts in a task one is looked at, save for every SEEN others."""
    sent = texts.sparkSession.sparkContext.broadcast(levels(known))  # a byte for each counter

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = sent.value, set()
        for b in pieces(batches, 2):
            held, count = [], 0
            for mark, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if mark in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(mark)
                grams = gram_set(text)
                if (n := len(grams)) == 0:
                    continue
                first = n - int(needed(n, least)) + 1
                own, node = level[_counter(grams)], node_of(grams)
                tokens = grams[np.lexsort((grams, own))[:first]]
                common = int(own.mean() * 16) << 19 | node & (1 << 19) - 1
                held.append((tokens, np.full(first, node), np.arange(n, n - first, -1, dtype=np.int32), np.full(first, n, dtype=np.int32), np.full(first, common, dtype=np.int32)))
                count += first
                if count > 1 << 16:
                    yield _columns(held)
                    held, count = [], 0
            if held:
                yield _columns(held)
        del seen
        give_back()

    return _marked(texts).mapInArrow(work, "token long, node long, rest int, size int, common int")


def _columns(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=["token", "node", "rest", "size", "common"])


def may_share(pairs: DataFrame, firsts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b), written, without those whose signatures show that they are not alike to `least`: each bit that only one of
    two sets has is a shingle, at least, that the other lacks. Of sets much larger than SIGNATURE it shows nothing."""
    of = lambda x: firsts.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}"))
    lacks = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda n, k: n + k)
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    most = F.least(F.col("size_a") - lacks("bits_a", "bits_b"), F.col("size_b") - lacks("bits_b", "bits_a"))
    return written(both.where(most >= needed(F.col("size_a") + F.col("size_b"), least / (1 + least), F.ceil)).select("a", "b"), "alike-pairs")


def share_enough(pairs: DataFrame, texts: DataFrame, firsts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are alike to `least` or more, written. `firsts` (node, first: doc_id, mark) tells which text
    is a node's. Only sets of nodes that occur in a pair are made and shuffled."""
    asked = firsts.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node")
    asked = written(asked.select("node", F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark")), "alike-asked")
    to = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    found = _marked(texts).join(F.broadcast(asked) if asked.count() <= FEW else asked, to).select("node", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            sets = [gram_set(t) for t in b.column(1).to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, sets)]), type=pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))], names=["node", "grams"])
        give_back()

    made = written(found.mapInArrow(work, "node long, grams array<bigint>"), "alike-some")
    some = made.dropDuplicates(["node"]) if made.count() > asked.count() else made  # rows that repeat
    both = pairs.join(some.toDF("a", "left"), "a").join(some.toDF("b", "right"), "b")
    enough = needed(F.size("left") + F.size("right"), least / (1 + least), F.ceil)
    links = written(both.where(F.size(F.array_intersect("left", "right")) >= enough).select("a", "b"), "alike-links")
    discard(asked, made)
    return links


def alike_links(texts: DataFrame, known: DataFrame, least: float, crowd: int = CROWD, proposed: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between the nodes, which are the different sets of shingles of `texts` (doc_id, text), as `known` describes
    them. Two nodes are linked, or linked through others, if and only if they are alike to `least`, or are so through
    others. No pair is left out, however many sets meet.

    Two sets alike to `least` have one of their rarest shingles in common, in an order that all share. First each set is
    compared with the most central, the smallest and the greatest nodes at its shingles, HUBS of them, with any that it alone meets
    somewhere, and with those with which it is `proposed` (a, b), as by fingerprints; what is alike makes groups, so that a
    large group costs about one comparison for each set: copies that are edited much are often alike to the least edited
    only, which is the central one. Then sets of
    different groups that meet are compared, all of them. A pair is left out of a comparison at a shingle only where its
    place leaves too few shingles behind it for the likeness: if it is the first that both have in common, they can't be
    alike, and else they meet at an earlier one. Where over `crowd` sets meet, those whose sizes allow it meet only.

    Sets are made from the texts where they are needed, rather than stored: they are twice as large.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    firsts = written(known.where("at is null").groupBy("node").agg(F.min(order).alias("first"), F.max("size").alias("size"), F.first("bits").alias("bits")), "alike-firsts")
    ratio = least / (1 + least)
    tokens = rarest(texts, known, least)
    met = tokens.groupBy("token").agg(F.count("*").alias("n"), F.min("node").alias("hub"), F.max("node").alias("last"), F.max_by("node", "common").alias("centre")).where("hub <> last")
    met = written(tokens.drop("common").join(met, "token"), "alike-met")
    settle(texts.sparkSession)

    hubs = F.explode(F.array_distinct(F.array("centre", "hub", "last")))
    star = met.select(hubs.alias("a"), F.col("node").alias("b"), "n").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("n").alias("fewest"))
    closest = W.partitionBy("b").orderBy(F.desc("shared"), "a")  # three times as many as a set has shingles, at most
    star = star.withColumn("_n", F.row_number().over(closest)).where((F.col("_n") <= HUBS) | (F.col("fewest") == 2))  # two that meet alone meet here only
    star = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if proposed is not None:
        star = star.union(proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    star = may_share(star, firsts, least)
    linked = share_enough(star, texts, firsts, least)
    settle(texts.sparkSession)
    groups = components(linked).toDF("node", "group")
    known = met.where("n > 2").drop("hub", "last", "centre").distinct().join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))

    # the larger of two sets probes the sizes that the smaller one can have; `rest` of both must reach what they need
    step = lambda size: F.floor(F.log(size) / float(np.log(STEP))).cast("int")
    crowded = F.col("n") > crowd
    top = F.least(F.col("size"), F.floor(F.col("rest") / ratio - F.col("size") + 1e-6))
    known = written(known.withColumn("top", top).withColumn("bottom", needed(F.col("size"), least, F.ceil)), "alike-known")
    smaller = known.where(F.col("rest") >= needed(F.col("size") * 2, ratio, F.ceil)).select("token", F.when(crowded, step(F.col("size"))).otherwise(0).alias("band"), F.col("group").alias("group2"), F.col("node").alias("node2"), F.col("rest").alias("rest2"), F.col("size").alias("size2"))
    bands = F.when(crowded, F.sequence(step(F.col("bottom")), step(F.col("top")))).otherwise(F.array(F.lit(0)))
    larger = known.where("top >= bottom").select("token", "group", "node", "rest", "size", F.explode(bands).alias("band"))
    at = smaller.select("token", "band", "group2").distinct()
    both = larger.join(at, ["token", "band"]).where(F.col("group") != F.col("group2")).join(smaller, ["token", "band", "group2"])
    fits = F.least("rest", "rest2") >= needed(F.col("size") + F.col("size2"), ratio, F.ceil)
    both = both.where(((F.col("size2") < F.col("size")) | (F.col("size2") == F.col("size")) & (F.col("node2") < F.col("node"))) & fits)
    pairs = both.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    pairs = may_share(pairs, firsts, least)
    discard(met, known)
    more = share_enough(pairs, texts, firsts, least)
    settle(texts.sparkSession)
    return linked.union(more)
