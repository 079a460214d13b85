"""Exact top-k search with MaxScore over quantised vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import let_workers_import, pick

#: Factor of the quantisation floor(SCALE * x).
SCALE = 256
#: Vectors of a shard, by how many there are, and bytes of a shard's numbers at most.
SHARD_ROWS, SHARD_BYTES = (4096, 262_144), 64 << 20
#: Vectors of a block of postings, blocks that a query visits first, and blocks after which thresholds are raised.
BLOCK, VISIT, RAISE = 64, 2, 8
#: Terms after which partial scores are compared with the threshold again, and queries that are searched together.
STRIDE, TOGETHER = 16, 512
LONG = (-(2**63), 2**63 - 1)


def quantised(rows: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of each component; as Python's whole numbers if a double can't hold one exactly."""
    with np.errstate(over="ignore"):
        out = np.floor(rows.astype(np.float64) * SCALE)
    if not out.size or np.abs(out).max() < 2**53:
        return out
    whole = [int(x) * SCALE if math.isinf(SCALE * x) else math.floor(SCALE * x) for x in rows.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(rows.shape)


class Shard:
    """Postings of a shard's vectors, in blocks. A term is a dimension; its posting of a vector is the vector's weight there,
    positive or negative. Vectors that are alike share a block, by cuts at the median of the most varied dimension, so that
    the most and the least of a block's weights say much about each of them."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.whole = rows.dtype == object or (rows.size and float(np.abs(rows).max()) ** 2 * rows.shape[1] >= 2**53)
        #: Postings that were read, and that a full search would have read.
        self.read = self.all = 0
        if self.whole:  # sums don't fit a double
            self.ids, self.rows = ids, np.array([[int(x) for x in r] for r in rows.tolist()], dtype=object).reshape(rows.shape)
            return
        parts, done = [np.argsort(ids, kind="stable")], []
        while parts:
            part = parts.pop()
            if len(part) <= BLOCK:
                done.append(part)
                continue
            x = rows[part]
            axis = int(x.var(axis=0).argmax())
            order = np.argsort(x[:, axis], kind="stable")
            parts += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
        order = np.concatenate(done)
        self.starts = np.cumsum([0, *map(len, done)])
        self.ids, self.rows = ids[order], np.ascontiguousarray(rows[order])
        if len(ids):
            self.most, self.least = (f.reduceat(self.rows, self.starts[:-1], axis=0) for f in (np.maximum, np.minimum))

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        """Ids and scores of the k best vectors for one query; see search_all."""
        _, ids, scores = self.search_all(np.array([query_id]), q[None, :], k)
        return ids, list(scores)

    def search_all(self, asked: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(place of the query, id, score) of the k best vectors of each query, but those with the query's own id; ties go to
        the smaller id.

        A query visits blocks in the order of the most that one of their vectors can score: first those where that is the
        most, which gives a threshold, the k-th best score so far; then the others, until it is under the threshold, which
        rises as better scores are found. In a block the terms are ordered by how much they can add. The essential ones, at
        the front, are those without which no vector reaches the threshold; these are traversed, and the others are
        probed while a vector can still reach it: after every STRIDE terms, queries and vectors for which what is ahead
        can't make up what is missing are left out.
        """
        self.all += len(asked) * self.rows.size
        if self.whole or queries.dtype == object or float(np.abs(queries).max(initial=0)) * float(np.abs(self.rows).max(initial=0)) * queries.shape[1] >= 2**53:
            found = [(n, *self._search_whole_numbers(i, q, k)) for n, (i, q) in enumerate(zip(asked.tolist(), queries, strict=True))]
            return np.array([n for n, ids, _ in found for _ in ids], dtype=np.int64), np.array([i for _, ids, _ in found for i in ids], dtype=np.int64), [s for *_, scores in found for s in scores]
        top, best = np.full((len(asked), k), np.iinfo(np.int64).max), np.full((len(asked), k), -np.inf)
        if len(self.ids):
            up, down = np.maximum(queries, 0), np.minimum(queries, 0)
            bound = up @ self.most.T + down @ self.least.T
            visits = np.zeros(bound.shape, dtype=bool)
            first = np.argpartition(-bound, min(VISIT, bound.shape[1]) - 1, axis=1)[:, :VISIT]
            np.put_along_axis(visits, first, True, axis=1)
            rest, order = ~visits, np.argsort(-bound.max(axis=0), kind="stable")
            for wanted in (visits, rest):
                for at in range(0, len(order), RAISE):
                    found = [self._in_block(b, sel, asked, queries, best[:, -1]) for b in order[at : at + RAISE] if len(sel := np.flatnonzero(wanted[:, b] & (bound[:, b] >= best[:, -1])))]
                    if found := [f for f in found if len(f[0])]:
                        _raise(top, best, *(np.concatenate(x) for x in zip(*found, strict=True)))
        real = np.isfinite(best)
        return np.nonzero(real)[0], top[real], [int(s) for s in best[real]]

    def _in_block(self, b: int, sel: np.ndarray, asked: np.ndarray, queries: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place of the query, id, score) of a block's vectors that reach the queries' thresholds."""
        rows, ids = self.rows[self.starts[b] : self.starts[b + 1]], self.ids[self.starts[b] : self.starts[b + 1]]
        q, limit = queries[sel], limits[sel]
        terms = np.argsort(-np.abs(q).sum(axis=0) * (self.most[b] - self.least[b]), kind="stable")
        q, rows = q[:, terms], rows[:, terms]
        most = np.maximum(q, 0) * self.most[b][terms] + np.minimum(q, 0) * self.least[b][terms]
        ahead = np.cumsum(most[:, ::-1], axis=1)[:, ::-1]  # what the terms from each on can add at most
        score = np.zeros((len(sel), len(ids)))
        for j in range(0, len(terms), STRIDE):
            some = slice(j, j + STRIDE)
            score += q[:, some] @ rows[:, some].T
            self.read += score.size * len(terms[some])
            need = limit - ahead[:, j + STRIDE] if j + STRIDE < len(terms) else limit
            fit = score >= need[:, None]
            queried, held = fit.any(axis=1), fit.any(axis=0)
            if not held.any():
                return sel[:0], ids[:0], score[0, :0]
            if queried.mean() < 0.8:
                sel, q, limit, ahead, score, fit = (x[queried] for x in (sel, q, limit, ahead, score, fit))
            if held.mean() < 0.8:
                rows, ids, score, fit = rows[held], ids[held], score[:, held], fit[:, held]
        a, v = np.nonzero(fit & (ids[None, :] != asked[sel][:, None])) if len(terms) else np.nonzero(ids[None, :] != asked[sel][:, None])
        return sel[a], ids[v], score[a, v]

    def _search_whole_numbers(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        """The same with whole numbers of any size; scores beyond a long stop at its ends."""
        big = [int(v) for v in q.tolist()]
        scores = [sum(a * int(b) for a, b in zip(big, row, strict=True)) for row in self.rows.tolist()]
        best = sorted((i for i in range(len(scores)) if self.ids[i] != query_id), key=lambda i: (-scores[i], self.ids[i]))[:k]
        self.read += self.rows.size
        return self.ids[best], [min(max(scores[i], LONG[0]), LONG[1]) for i in best]


def _raise(top: np.ndarray, best: np.ndarray, places: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
    """Puts what was found among the best of each query, with which thresholds rise."""
    k, some = top.shape[1], np.unique(places)
    places = np.concatenate([np.repeat(some, k), places])
    ids, scores = np.concatenate([top[some].ravel(), ids]), np.concatenate([best[some].ravel(), scores])
    order = np.lexsort((ids, -scores, places))
    starts = np.searchsorted(places[order], some)
    kept = order[(starts[:, None] + np.arange(k)).ravel()]
    top[some], best[some] = ids[kept].reshape(-1, k), scores[kept].reshape(-1, k)


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """One row for each list, filled up with zeros."""
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    if (np.diff(ends) == dims).all():
        return values[ends[0] : ends[-1]].reshape(len(lists), dims)
    out = np.zeros((len(lists), dims), dtype=values.dtype)
    for row, a, b in zip(out, ends[:-1], ends[1:], strict=True):
        row[: b - a] = values[a:b]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best rows by inner product for each row that `is_query`, a condition on vec_id, chooses: query_id, rank
    (from 1), vec_id, score. Components x count as floor(256 * x); ties go to the smaller vec_id; a row is not compared
    with rows of its own id. Fewer rows than k give all of them.

    MaxScore in each shard; see Shard.search_all. The best of all shards are merged. Vectors are dealt to shards, of
    SHARD_ROWS rows and SHARD_BYTES bytes at most; queries go to all shards, as rows that follow a shard's vectors in its
    partition, so that each shard's postings are made once, and queries stream past them.

    Rows with a null id or vector, or a component that is null or not finite, take no part. Vectors of different
    lengths count as filled up with zeros. Rows of one id are all candidates, but one query: that of the least vector.
    Scores beyond a long stop at its ends, where they are ties. An empty table gives no rows. Other
    columns are ignored.
    """
    let_workers_import(vectors.sparkSession)
    base = pick(vectors, vec_id=id_col, vector=vector_col)
    kind = "array<float>" if base.schema["vector"].dataType.simpleString() == "array<float>" else "array<double>"
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    base = base.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast(kind).alias("vector")).where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    n, dims = base.select(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    most = min(SHARD_ROWS[1], max(1, SHARD_BYTES // (8 * max(1, dims))))
    shards = -(-n // min(most, max(SHARD_ROWS[0], n // 48))) or 1
    indexed = base.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "vec_id", "vector")
    queries = base.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "vector")
    dealt = indexed.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "asks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, index = None, [], None
        for b in batches:
            shard, asks, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (asks[1:] != asks[:-1])) + 1), b.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue
                if shard[start] != number:
                    number, held, index = shard[start], [], None
                rows = quantised(_matrix(b.column(3).slice(start, end - start), dims))
                if not asks[start]:
                    held.append((ids[start:end].copy(), rows))
                    continue
                if index is None:
                    index = Shard(np.concatenate([i for i, _ in held]), np.concatenate([r for _, r in held])) if held else Shard(np.zeros(0, dtype=np.int64), np.zeros((0, dims)))
                    held = []
                for at in range(start, end, TOGETHER):
                    some = ids[at : min(end, at + TOGETHER)]
                    places, found, scores = index.search_all(some, rows[at - start : at - start + len(some)], k)
                    yield pa.RecordBatch.from_arrays([pa.array(some[places]), pa.array(found), pa.array(scores, type=pa.int64())], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(search, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
