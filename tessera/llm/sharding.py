"""Sharding by histogram sort: splitters from exact counts below probed keys, then one exchange."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import pick, written

#: Keys have KEY_BITS bits; the last DOC_BITS come from the document's id, the others from its text.
KEY_BITS, DOC_BITS = 62, 22
#: Probes for each open splitter and round, and of all splitters together, but for 4 each.
PROBES, MOST_PROBES = 64, 1 << 18


def shard_key(doc_id: Column, text: Column) -> Column:
    """A key that sorts equal texts side by side, and within them by a hash of the id, so that a large group of equal
    texts can still be split."""
    of_text = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 64 - (KEY_BITS - DOC_BITS))
    of_doc = F.shiftrightunsigned(F.xxhash64(doc_id), 64 - DOC_BITS)
    return F.shiftleft(of_text, DOC_BITS).bitwiseOR(of_doc)


def bytes_below(keyed: DataFrame, probes: np.ndarray) -> np.ndarray:
    """Exact bytes of all rows (key, size) with a key below each of the sorted `probes`. Each task sums its rows by
    probe interval first; at most len(probes) + 1 sums reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(len(probes) + 1, dtype=np.int64)
        for b in batches:
            np.add.at(sums, np.searchsorted(probes, b["key"].to_numpy(), side="right"), b["size"].to_numpy())
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"at": at, "bytes": sums[at]})

    rows = keyed.select("key", "size").mapInPandas(count, "at long, bytes long").groupBy("at").agg(F.sum("bytes").alias("bytes")).collect()
    sums = np.zeros(len(probes) + 1, dtype=np.int64)
    for r in rows:
        sums[r["at"]] = r["bytes"]
    return np.cumsum(sums)[:-1]


def find_splitters(keyed: DataFrame, total: int, parts: int, tolerance: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """parts - 1 keys that cut the rows (key, size) into parts of about total / parts bytes.

    Each round probes keys inside the interval that is known to hold a splitter, for all open splitters in one pass
    over the rows, and narrows the interval to two neighbouring probes. A splitter is done when one end of its interval
    meets its tolerance in bytes, or the interval holds one key. Probes stay on the edges of groups of equal texts
    while the interval holds several, so a group is cut only if no edge near it is within tolerance.
    """
    n = parts - 1
    goal = total * np.arange(1, parts) / parts
    lo, hi = np.zeros(n, dtype=np.int64), np.full(n, 1 << KEY_BITS, dtype=np.int64)
    at_lo, at_hi = np.zeros(n), np.full(n, float(total))
    while True:
        opened = np.flatnonzero((np.minimum(goal - at_lo, at_hi - goal) > tolerance) & (hi - lo > 1))
        if not len(opened):
            return np.where(goal - at_lo <= at_hi - goal, lo, hi)
        inner = []
        for i in opened:
            a, width = int(lo[i]), int(hi[i] - lo[i])
            grain = 1 << DOC_BITS if width > 1 << DOC_BITS else 1
            x = np.array([(a + width * j // (probes + 1)) // grain * grain for j in range(1, probes + 1)] + [a + grain], dtype=np.int64)
            inner.append(x[(x > a) & (x < int(hi[i]))])
        asked = np.unique(np.concatenate(inner))
        found = bytes_below(keyed, asked)
        for i in opened:
            own = slice(np.searchsorted(asked, lo[i], side="right"), np.searchsorted(asked, hi[i], side="left"))
            keys, sums = asked[own], found[own]
            k = int(np.searchsorted(sums, goal[i], side="right"))
            if k > 0:
                lo[i], at_lo[i] = keys[k - 1], sums[k - 1]
            if k < len(keys):
                hi[i], at_hi[i] = keys[k], sums[k]


def shard_by_bytes(docs: DataFrame, shards: int = 16, tolerance: float = 0.005, part_rows: int = 200_000, most_parts: int = 2048, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals documents into `shards` shards of near equal bytes: doc_id, size (UTF-8 bytes plus 1), text_crc32, key,
    shard (from 0), slot (gapless from 0 in each shard, in the order of the key).

    Equal texts have neighbouring keys, so they share a shard unless their group lies across a boundary and moving the
    boundary to the group's edge would miss `tolerance`, a part of a shard's bytes. A shard of many rows is itself dealt
    out as ranges of about `part_rows` rows, `most_parts` at most, so that no task holds a whole shard. The rows move
    once, to their range.

    A null text counts as empty. Rows that repeat in full share a key and stay together. A null id is a value like any
    other. An empty table gives no rows. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    base = pick(docs, doc_id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    keyed = written(base.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), shard_key(F.col("doc_id"), F.col("text")).alias("key")), "shard")
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    per_shard = max(1, min(most_parts, rows // (shards * part_rows)))
    parts = shards * per_shard
    loose = np.full(parts - 1, 0.25 * total / parts)
    loose[per_shard - 1 :: per_shard] = tolerance * total / shards
    splitters = np.maximum.accumulate(find_splitters(keyed, int(total), parts, loose, max(4, min(PROBES, MOST_PROBES // parts)))) if rows else np.zeros(parts - 1, dtype=np.int64)

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, key.to_numpy(), side="right").astype(np.int32))

    dealt = keyed.withColumn("part", part_of("key"))
    counts = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row for each part
    first, starts = 0, []
    for p in range(parts):
        first = 0 if p % per_shard == 0 else first
        starts.append((p, p // per_shard, first))
        first += counts.get(p, 0)
    offsets = spark.createDataFrame(starts, "part int, shard int, start long")
    order = W.partitionBy("part").orderBy("key", "doc_id", "text_crc32")
    slots = dealt.withColumn("row", F.row_number().over(order))
    return slots.join(F.broadcast(offsets), "part").select("doc_id", "size", "text_crc32", "key", "shard", (F.col("start") + F.col("row") - 1).cast("long").alias("slot"))
