"""Bounded training samples, taken the same way on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a sample at most, but for one of each label, and bytes of their texts, but for the last row of each label.
MOST_ROWS, MOST_BYTES = 8000, 64 << 20


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample_by_label(keys: DataFrame, texts: DataFrame, per_label: int, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows (doc_id, label, text) of every label of `keys` (doc_id, label), with whole texts from `texts` (doc_id, text):
    up to `per_label` of each, those whose ids have the smallest hashes, and fewer of each where there are so many labels,
    or texts so long, that all together would be over `most_rows` rows or `most_bytes` bytes. Rows that repeat count once,
    so that one document can't fill a sample.

    The ids are found first, on rows without texts, through the number of different ids of each label and a threshold on
    the hash that leaves a few more than asked for; only those are ranked. A bounded number of ids is then sent to the
    texts, which are not shuffled, and what they bring back is ranked and bounded again, as an id can have many texts."""
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double").alias("hash")
    ids = keys.where("label is not null").select("doc_id", "label", hashed)
    counts = [(r["label"], float(r["n"])) for r in ids.groupBy("label").agg(F.approx_count_distinct("doc_id").alias("n")).collect()]
    if not counts:
        return keys.join(texts, "doc_id").limit(0)
    per_label = min(per_label, max(1, most_rows // len(counts)))
    cuts = keys.sparkSession.createDataFrame([(label, 2.0**53 * min(1.0, 2.0 * (per_label + 50) / n)) for label, n in counts], keys.select("label", F.lit(0.0).alias("cut")).schema)
    few = ids.join(F.broadcast(cuts), "label").where(F.col("hash") <= F.col("cut")).select("doc_id", "label", "hash").distinct()
    first = W.partitionBy("label").orderBy("hash", "doc_id")
    found = few.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_label).drop("_n")
    rows = texts.join(F.broadcast(found), "doc_id").withColumn("mark", F.xxhash64("text")).dropDuplicates(["doc_id", "label", "mark"])
    order = W.partitionBy("label").orderBy("hash", "doc_id", "mark")
    rows = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_label)
    before = F.coalesce(F.sum(F.octet_length("text")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_before", before).where(F.col("_before") <= most_bytes // len(counts)).select("doc_id", "label", "text")
