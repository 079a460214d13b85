"""The stages of the corpus pipeline. All but the last return the columns of their docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import encode_texts, load
from tessera.llm.common import pick, written
from tessera.llm.language import fit_language, keep_identified
from tessera.llm.mixing import mix_documents
from tessera.llm.secrets import redact
from tessera.llm.simhash import copy_groups
from tessera.llm.training import fold


def language_model(docs: DataFrame):
    """Learned from the texts and known languages of three folds of four."""
    return fit_language(pick(docs, doc_id="doc_id", label="lang", text="text").where("label is not null").where(fold(F.col("doc_id"), 4) != 2), chances=True)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter, or that resemble the language that they are told to be in no more than letters at random
    do, however many languages there are. Null, empty and blank texts have no letter. The language is told from the whole text;
    `lang` is learned from where it isn't null, and where no row has one, no language is known and nothing stays. Rows that
    repeat stay each. An empty table gives no rows. Columns are kept, whatever their names."""
    return keep_identified(docs, language_model(docs), 0.0)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles alike to 0.8): that with the smallest id; see
    copy_groups. Null and empty texts are copies of each other. Rows without an id take part, and come last. Rows of one
    id with different texts are different documents. Of rows that repeat id and text one stays. An empty table gives no
    rows. Columns are kept, whatever their names."""
    groups = written(copy_groups(docs), "alike-groups")  # read twice
    keep = groups.where("first").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    repeated = not groups.groupBy("doc_id", "mark").count().where("count > 1").isEmpty()
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    key, text = (f"_c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    marked = plain.withColumn("_m", F.xxhash64(text))
    kept = marked.join(keep, F.col(key).eqNullSafe(F.col("_id")) & (F.col("_m") == F.col("_mark")), "left_semi")
    return (kept.dropDuplicates([key, "_m"]) if repeated else kept).drop("_m").toDF(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With secrets redacted from the whole texts, and n_chars brought up to date; all rows stay, also those that repeat. Null and
    empty texts stay as they are. An empty table gives no rows. Columns are kept, whatever their names."""
    return redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mix of the sources: documents that it takes twice come twice, those that it doesn't take go. Null and empty texts
    have no words, and come as often as their source's budget takes them. A null source is a source. Rows that repeat count
    each. An empty table gives no rows. Columns are kept, whatever their names; texts stay whole."""
    return mix_documents(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids: the token ids of each whole text. Null and empty texts have none. Rows that repeat come back each; an
    empty table gives no rows; other columns are ignored."""
    import public_tokenizers

    encoded = encode_texts(docs, load(public_tokenizers.path("byte_bpe_50k.json")))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
