"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import WORD, pick, written

#: Hash keys have 60 bits: LEVELS histograms, each on the next LEVEL_BITS.
LEVELS, LEVEL_BITS = 4, 15


def word_count(text: Column) -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeats: float = 2.0) -> DataFrame:
    """(source, source_size) with a target for each source.

    Sources in the order of their code points, null last, weigh `weights`, repeating. They divide `share` times the sum
    of all sizes by weight; a target stops at `repeats` times its source's size, and the excess is shared again by
    weight among those below. The end of that sharing is one level L with target = min(cap, L * weight): sources
    that cap first, by cap / weight, are taken off one after the other until L fits the rest. The windows run over one
    row for each source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.select("source", "source_size", (F.col("source_size") * float(repeats)).alias("cap"), F.row_number().over(by_name).alias("n"))
    s = s.withColumn("weight", F.element_at(cycle, (F.col("n") - 1) % len(weights) + 1))
    by_cap = W.orderBy((F.col("cap") / F.col("weight")).asc(), "n")
    everything = W.partitionBy()
    s = s.withColumn("goal", F.sum("source_size").over(everything) * float(share)).withColumns(
        {
            "left": F.col("goal") - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
            "heft": F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing)),
        }
    )
    fits = F.col("left") / F.col("heft") * F.col("weight") <= F.col("cap")
    level = F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), F.col("n"), (F.col("left") / F.col("heft")).alias("level")))).over(everything)
    target = F.least(F.col("cap"), F.coalesce(level["level"] * F.col("weight"), F.col("cap")))
    return s.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeats: float = 2.0, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How much of each document a mix takes: doc_id, source, size, source_size, target, copies (long: whole copies),
    taken (long: words, repeats counted).

    A source takes each of its documents floor(target / source_size) times, and of the rest of its budget those whose
    hash lies under a threshold. The threshold comes from histograms, without a sort: words by source and hash bucket;
    the bucket where the running sum passes the budget is the boundary, and only its documents enter the next, finer
    histogram, LEVELS times, until the boundary is one hash. Its documents, one unless rows repeat, give the words that
    are still missing, in proportion to their sizes, so that a source's taken words miss its target by less than one
    word for each row with that hash. The threshold grows with the budget, so a smaller mix is a subset of a larger.

    Null and empty texts have size 0 and take 0. A null source is a source. Rows that repeat count each. A null id is a
    value like any other. An empty table gives no rows. Other columns are ignored.
    """
    compact = _compact(docs, id_col, text_col, source_col)
    e = _renamed(mix_budgets(compact, weights, share, repeats))
    below, edge = F.col("key") < F.col("prefix"), (F.col("key") == F.col("prefix")) & (F.col("tied") > 0)
    extra = F.when(below, F.col("size")).when(edge, F.floor(F.col("size") * F.col("rest") / F.col("tied")).cast("long")).otherwise(F.lit(0))
    return compact.join(e, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "source", "size", "source_size", "target", _copies().alias("copies"), (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeats: float = 2.0, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, all columns: each as many times as the mix takes it whole; see mix_sources. Of the
    document on a source's boundary only whole copies come, so that texts stay whole. Texts are not shuffled."""
    names = docs.columns
    e = _renamed(mix_budgets(_compact(docs, id_col, text_col, source_col), weights, share, repeats))
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    id_at, source_at = (f"_c{names.index(c)}" for c in (id_col, source_col))
    marked = plain.withColumn("key", mix_key(F.col(id_at))).join(e, F.col(source_at).eqNullSafe(F.col("_source"))).withColumn("copies", _copies()).where("copies > 0")
    return marked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*plain.columns).toDF(*names)


def mix_key(doc_id: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit("mix")), 64 - LEVELS * LEVEL_BITS)


def _compact(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    base = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    return written(base.select("doc_id", "source", word_count(F.col("text")).alias("size"), mix_key(F.col("doc_id")).alias("key")), "mix")


def _renamed(budgets: DataFrame) -> DataFrame:
    return budgets.withColumnRenamed("source", "_source")


def _copies() -> Column:
    """Whole copies of a document that a mix takes; one that is taken twice in full has no use for the threshold."""
    return (F.col("whole") + F.when(F.col("key") < F.col("prefix"), 1).otherwise(0)).cast("long")


def mix_budgets(compact: DataFrame, weights: Sequence[float], share: float, repeats: float) -> DataFrame:
    """One row for each source of the table (source, size, key): source_size, target, whole (copies of all documents),
    prefix (the threshold: keys below it come once more), and rest and tied (words still missing there, and words of
    documents with that key)."""
    targets = source_targets(compact.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(repeats)))).otherwise(F.lit(0)).cast("long")
    edge = targets.withColumn("whole", whole).withColumns({"rest": F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"), "prefix": F.lit(0).cast("long"), "tied": F.lit(0).cast("long")})
    edge = written(edge, "mix-edge")
    for level in range(1, LEVELS + 1):
        edge = written(_refined(compact, edge, level), "mix-edge")
    return edge


def _refined(compact: DataFrame, edge: DataFrame, level: int) -> DataFrame:
    """The boundary of each source after the histogram of one more level; `edge` has one row for each source."""
    e = edge.select(F.col("source").alias("_source"), "prefix")
    inside = compact.join(e, F.col("source").eqNullSafe(F.col("_source")) & (F.shiftrightunsigned("key", (LEVELS - level + 1) * LEVEL_BITS) == F.col("prefix")))
    buckets = inside.groupBy("source", F.shiftrightunsigned("key", (LEVELS - level) * LEVEL_BITS).alias("bucket")).agg(F.sum("size").alias("words"))
    # sums below each bucket, by groups of buckets first, so that no task has all buckets of a source
    buckets = buckets.withColumn("group", F.shiftright("bucket", LEVEL_BITS // 2))
    before = lambda keys, by: F.coalesce(F.sum("words").over(W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = buckets.groupBy("source", "group").agg(F.sum("words").alias("words")).select(F.col("source").alias("_of"), F.col("group").alias("_group"), before(["source"], "group").alias("_under"))
    below = buckets.withColumn("_inside", before(["source", "group"], "bucket")).join(groups, F.col("source").eqNullSafe(F.col("_of")) & (F.col("group") == F.col("_group")))
    below = below.select("source", "bucket", "words", (F.col("_under") + F.col("_inside")).alias("below"))
    found = below.join(edge.select(F.col("source").alias("_source"), "rest"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("below") <= F.col("rest")) & (F.col("rest") < F.col("below") + F.col("words")))
    found = found.select(F.col("source").alias("_source"), "bucket", "below", "words")
    out = edge.join(found, F.col("source").eqNullSafe(F.col("_source")), "left")
    return out.select("source", "source_size", "target", "whole", (F.col("rest") - F.coalesce("below", F.lit(0))).alias("rest"), F.coalesce("bucket", F.lit(-1)).alias("prefix"), F.coalesce("words", F.lit(0)).alias("tied"))
