"""Near-duplicates by SimHash, linked by a generalised pigeonhole search in Hamming space."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.alike import alike_links, describe
from tessera.llm.common import map_texts, pick, written
from tessera.llm.components import components

BITS = 64
#: A bucket of more fingerprints than this is not searched pair by pair, but through midpoints.
DENSE = 64
#: What one probe costs, in candidates.
PROBE_COST = 1.0
#: Fingerprints for each value of a part that are aimed at; more make the parts wider.
AIM = 8
#: Bits within which a wide search finds all pairs outside crowded buckets, bits up to which it pairs what it meets, and the
#: share of five-word shingles that makes texts near copies, which near_copies finds without fingerprints.
WIDE, REACH, LIKE = 7, 12, 0.8


def simhash_text(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of a text, unsigned: a bit is 1 if it is set in over half of the shingles' XXH64 hashes."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes, these see ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    n = max(1, len(words) - shingle + 1)
    starts = [0, *ends[: n - 1]]
    last = ends[-n:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, last, strict=True)], dtype=">u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long; see simhash_text."""

    def work(texts: list[str | None]) -> list[list]:
        return [np.array([simhash_text(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)]

    return map_texts(docs, id_col, text_col, {"fp": "long"}, lambda: work)


def _bits(fp: np.ndarray) -> np.ndarray:
    """One row of 0 and 1 for each fingerprint, the highest bit first."""
    return np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def _values(bits: np.ndarray, columns: list[int]) -> np.ndarray:
    """The number that the given bits make, for each row."""
    return bits[:, columns].astype(np.int64) @ (1 << np.arange(len(columns), dtype=np.int64))


def bit_pairs(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have both of two bits set; 4096 sums reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS), dtype=np.int64)
        n = 0
        for b in batches:
            x = _bits(b["fp"].to_numpy().view(np.uint64)).astype(np.float64)
            total += (x.T @ x).astype(np.int64)
            n += len(b)
        yield pd.DataFrame({"at": np.arange(BITS * BITS + 1), "n": np.append(total.ravel(), n)})

    sums = np.zeros(BITS * BITS + 1, dtype=np.int64)
    for r in distinct.select("fp").mapInPandas(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        sums[r["at"]] = r["n"]
    return int(sums[-1]), sums[:-1].reshape(BITS, BITS)


def group_bits(n: int, pairs: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` parts of about equal width, correlated bits together: each part starts with the bit that is
    correlated most with all that are left, and takes in the bit correlated most with its own."""
    p = np.diag(pairs) / max(n, 1)
    cov = pairs / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    left, found = list(range(BITS)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        part = [max(left, key=lambda i: (corr[i, left].sum(), -i))]
        left.remove(part[0])
        while len(part) < width:
            part.append(max(left, key=lambda i: (corr[i, part].sum(), -i)))
            left.remove(part[-1])
        found.append(sorted(part))
    return found


def near_shares(distinct: DataFrame, n: int, halves: list[list[int]], radius: int) -> list[np.ndarray]:
    """For each half part, the share of all fingerprints at distance 0 to radius from each of its values. The histograms
    have 2 ** width counts each, whatever the number of fingerprints."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros(1 << len(h), dtype=np.int64) for h in halves]
        for b in batches:
            bits = _bits(b["fp"].to_numpy().view(np.uint64))
            for s, h in zip(sums, halves, strict=True):
                s += np.bincount(_values(bits, h), minlength=len(s))
        for k, s in enumerate(sums):
            at = np.flatnonzero(s)
            yield pd.DataFrame({"half": np.full(len(at), k), "value": at, "n": s[at]})

    sums = [np.zeros(1 << len(h)) for h in halves]
    for r in distinct.select("fp").mapInPandas(count, "half int, value int, n long").groupBy("half", "value").agg(F.sum("n").alias("n")).collect():
        sums[r["half"]][r["value"]] = r["n"] / max(n, 1)
    out = []
    for s, h in zip(sums, halves, strict=True):
        v = np.arange(len(s))
        out.append(np.stack([sum(s[v ^ sum(1 << b for b in c)] for c in combinations(range(len(h)), e)) if e else s for e in range(radius + 1)], axis=1))
    return out


def allocate(cost: np.ndarray, tau: int) -> np.ndarray:
    """Thresholds of least cost for each fingerprint, by dynamic programming: cost[f, i, 1 + t] is what threshold t
    (-1: skipped) costs in part i. They sum up to tau - parts + 1, which is what the generalised pigeonhole principle
    asks for: of two fingerprints within tau, some part differs by its threshold at most."""
    n, parts, options = cost.shape
    goal = tau + 1  # each threshold plus 1
    best = np.full((n, goal + 1), np.inf)
    best[:, 0] = 0
    choice = np.zeros((parts, n, goal + 1), dtype=np.int64)
    for i in range(parts):
        new = np.full((n, goal + 1), np.inf)
        for s in range(goal + 1):
            for t in range(min(s, options - 1) + 1):
                c = best[:, s - t] + cost[:, i, t]
                choice[i, :, s] = np.where(c < new[:, s], t, choice[i, :, s])
                new[:, s] = np.minimum(new[:, s], c)
        best = new
    out, s = np.zeros((n, parts), dtype=np.int64), np.full(n, goal)
    for i in range(parts - 1, -1, -1):
        out[:, i] = choice[i, np.arange(n), s]
        s = s - out[:, i]
    return out - 1


def probe_rows(distinct: DataFrame, tau: int, parts: int | None = None, most: int | None = None) -> DataFrame:
    """(part, value, fp, node, probe), written: for the table (fp, node) of different fingerprints, each one's value in
    each part, and the values that it probes. Parts are as many as leave about AIM fingerprints or fewer to a value. Two
    fingerprints within `tau` meet in some part, one by its own value and the other by a probe. `most`: the largest
    threshold of a part.
    """
    most = tau if most is None else most
    n, pairs = bit_pairs(distinct)
    parts = parts or max([-(-(tau + 1) // (most + 1)), 2, *(m for m in range(2, tau + 2) if n / 2 ** (BITS // m) <= AIM)])
    groups = group_bits(n, pairs, parts)
    halves = [h for g in groups for h in (g[: len(g) // 2], g[len(g) // 2 :])]
    shares = near_shares(distinct, n, halves, most)
    masks = [[sum(1 << b for b in c) for e in range(most + 1) for c in combinations(range(len(g)), e)] for g in groups]
    sizes = [list(accumulate(len(list(combinations(range(len(g)), e))) for e in range(most + 1))) for g in groups]

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = [np.array(m, dtype=np.int64) for m in masks]
        for b in batches:
            fp = b["fp"].to_numpy()
            bits = _bits(fp.view(np.uint64))
            cost = np.zeros((len(fp), parts, most + 2))
            own = []
            for i, g in enumerate(groups):
                own.append(_values(bits, g))
                x, y = (shares[2 * i + k][_values(bits, halves[2 * i + k])] for k in (0, 1))
                found = np.cumsum([sum(x[:, a] * y[:, e - a] for a in range(e + 1)) for e in range(most + 1)], axis=0).T * n
                cost[:, i, 1:] = found + PROBE_COST * np.array(sizes[i])
            radius = allocate(cost, tau)
            for i in range(parts):
                rows = [pd.DataFrame({"part": i, "value": own[i], "fp": fp, "node": b["node"].to_numpy(), "probe": False})]
                for r in range(most + 1):
                    q = np.flatnonzero(radius[:, i] == r)
                    m = at[i][: sizes[i][r]]
                    rows.append(pd.DataFrame({"part": i, "value": (own[i][q][:, None] ^ m).ravel(), "fp": np.repeat(fp[q], len(m)), "node": np.repeat(b["node"].to_numpy()[q], len(m)), "probe": True}))
                yield pd.concat(rows)

    return written(distinct.select("fp", "node").mapInPandas(keys, "part int, value long, fp long, node long, probe boolean"), "simhash-keys")


def near_links(distinct: DataFrame, tau: int = 2, parts: int | None = None, dense: int = DENSE) -> DataFrame:
    """Links (a, b) between nodes of the table (fp, node) of different fingerprints; two fingerprints are linked, or
    linked through others, if and only if they are within `tau` bits, or within it through others.

    Parts are as many as leave about AIM fingerprints or fewer to a value. Each fingerprint is indexed by its value in
    each part, and probes all values within its threshold of its own. What is found in a bucket of up to `dense`
    fingerprints is verified. For larger buckets, which near copies of one text fill, all fingerprints that lie in one
    or probe one go to their midpoints instead (tau 2: all values that differ in one bit or none): two are within 2 if
    and only if they meet at a midpoint, where at most 65 can meet, so links to the smallest node there leave out no
    link and grow with the number of fingerprints, not its square.
    """
    rows = probe_rows(distinct, tau, parts)
    index, probes = rows.where("not probe").drop("probe"), rows.where("probe").drop("probe")
    crowded = written(index.groupBy("part", "value").count().where(F.col("count") > dense).select("part", "value"), "simhash-dense")
    sparse = probes.join(crowded, ["part", "value"], "left_anti").withColumnsRenamed({"fp": "fp2", "node": "node2"})
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2")))
    verified = index.join(sparse, ["part", "value"]).where((F.col("fp") != F.col("fp2")) & (distance <= tau)).select(F.col("node").alias("a"), F.col("node2").alias("b"))
    thick = rows.join(crowded, ["part", "value"], "left_semi").select("fp", "node").distinct()
    return verified.union(midpoint_links(thick, tau))


def likeness(left: str | None, right: str | None, shingle: int = 5) -> float:
    """The share of the different word shingles of two texts that both have; words and short texts as in simhash_text."""
    sets = []
    for t in (left, right):
        w = (t or "").encode("utf-8", "replace").lower().split()
        sets.append({b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    x, y = sets
    return len(x & y) / len(x | y) if x or y else 1.0


def wide_candidates(distinct: DataFrame, tau: int = WIDE, reach: int = REACH, dense: int = DENSE) -> DataFrame:
    """Pairs (a, b) of nodes, a < b, to compare by their texts: all within `tau` bits outside crowded buckets, and what the
    same probes meet up to `reach`. A proposal only, which near_copies doesn't rest on. In a bucket of over `dense` fingerprints each one is paired with the smallest node there and with the
    smallest of those that have its value in the next part too, in place of all: the members of a large group then hang
    together over the many buckets that they share, and pairs grow with the fingerprints."""
    rows = probe_rows(distinct, tau, most=2)
    index, probes = rows.where("not probe").drop("probe"), rows.where("probe").drop("probe")
    crowded = written(index.groupBy("part", "value").count().where(F.col("count") > dense).select("part", "value"), "simhash-dense")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= reach
    pair = [F.col("node").alias("a"), F.col("node2").alias("b")]
    sparse = probes.join(crowded, ["part", "value"], "left_anti").withColumnsRenamed({"fp": "fp2", "node": "node2"})
    found = index.join(sparse, ["part", "value"]).where((F.col("fp") != F.col("fp2")) & near).select(*pair)
    other = index.select("fp", F.col("part").alias("part2"), F.col("value").alias("value2"))
    parts = F.expr("part + 1")
    thick = rows.join(crowded, ["part", "value"], "left_semi").select("part", "value", "fp", "node").withColumn("part2", parts)
    last = index.agg(F.max("part")).first()[0]
    fine = thick.withColumn("part2", F.when(F.col("part2") > F.lit(last), 0).otherwise(F.col("part2"))).join(other, ["fp", "part2"])
    for keys, members in ((["part", "value"], thick), (["part", "value", "value2"], fine)):
        least = members.groupBy(*keys).agg(F.min(F.struct("node", "fp")).alias("least"))
        met = members.join(least.select(*keys, F.col("least.node").alias("node2"), F.col("least.fp").alias("fp2")), keys)
        found = found.union(met.where((F.col("node") != F.col("node2")) & near).select(*pair))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def midpoint_links(thick: DataFrame, tau: int) -> DataFrame:
    """Links from each node to the smallest at each of its midpoints; for a tau of 2 or 3, or 1 or 0."""
    if tau > 3:
        raise ValueError("midpoints are for a tau of up to 3")
    one = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    near = F.concat(F.array("fp"), one) if tau > 1 else F.array("fp")
    meets = thick.select("node", F.explode(near).alias("middle"))
    least = F.min("node").over(W.partitionBy("middle"))
    return meets.select("node", least.alias("least")).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, tau: int = 2, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents by near-duplicate group: doc_id, fp (signed long), component_id (the smallest id reachable over links
    between fingerprints of `tau` or fewer differing bits, itself included).

    Texts of one fingerprint are one node, so copies make no pairs. Null and empty texts, and texts of white space, have
    fingerprint 0 and are linked like any other. A null id takes no part as a smallest id; a group of null ids only has
    a null component. Rows that repeat come back each. An empty table gives no rows. Other columns are ignored.
    """
    marked = written(fingerprints(docs, shingle, id_col=id_col, text_col=text_col), "simhash")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-distinct")
    known = distinct.where("node is not null")
    labels = components(near_links(known, tau)).withColumnRenamed("id", "node")
    grouped = written(distinct.join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "simhash-groups")
    return marked.join(grouped, "fp").select("doc_id", "fp", "component_id")


def copy_groups(docs: DataFrame, least: float = LIKE, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, component_id, first) for each row: mark is the XXH64 of its text, component_id the smallest id of its
    group of near copies, and first tells the row of each group with the smallest id, then the smallest mark.

    Linked are all texts whose five-word shingles have a likeness of `least` or more, and no others. Fingerprints propose:
    the pigeonhole search of near_links meets those within 2 bits, and texts of one fingerprint are met at one of them.
    What is alike among those is one group, whatever its fingerprints say; alike_links meets the rest, of which copies of
    `least` are often over 10 bits apart, at their rarest shingles, and leaves out no pair. Texts with the same set of
    shingles are one node, so copies make no pairs.
    """
    texts = pick(docs, doc_id=id_col, text=text_col)
    known = describe(texts, simhash_text)
    rows = known.where("at is null")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    firsts = written(rows.groupBy("node").agg(F.min(order).alias("first"), F.min("fp").alias("fp")), "alike-nodes")
    distinct = written(firsts.groupBy("fp").agg(F.min("node").alias("node")), "alike-fingerprints")
    same = firsts.select("fp", F.col("node").alias("b")).join(distinct.withColumnRenamed("node", "a"), "fp").where("a <> b").select("a", "b")
    labels = components(alike_links(texts, known, least, proposed=near_links(distinct).union(same))).withColumnRenamed("id", "node")
    grouped = written(firsts.join(labels, "node", "left").select("node", "first", F.coalesce("component", "node").alias("group")), "alike-components")
    best = grouped.groupBy("group").agg(F.min("first").alias("best"))
    named = grouped.join(best, "group").select("node", F.col("best.doc_id").alias("component_id"), F.col("best.mark").alias("_mark"))
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("mark") == F.col("_mark"))
    return rows.select("doc_id", "mark", "node").join(named, "node").select("doc_id", "mark", "component_id", first.alias("first"))


def near_copies(docs: DataFrame, least: float = LIKE, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents by group of near copies: doc_id, component_id (the smallest id of the group); see copy_groups.

    Null and empty texts are copies of each other. Null ids come after all others: a group of null ids only has a null
    component. Rows that repeat come back each, as do rows of one id with different texts, each in the group of its text.
    An empty table gives no rows. Other columns are ignored.
    """
    return copy_groups(docs, least, id_col=id_col, text_col=text_col).select("doc_id", "component_id")
