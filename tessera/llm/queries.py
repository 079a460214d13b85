"""The queries of this subpackage, by name, and the SQL that gives the same rows where there is such SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import pick, table
from tessera.llm.training import fold

Query = Callable[[SparkSession, str], DataFrame]


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.winnowing import edited_likeness

    return edited_likeness(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import pages_through_warc

    return pages_through_warc(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.secrets import find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"))
    listed = lambda keep: F.array_join(F.transform(F.filter("spans", keep), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(listed(lambda s: s["kind"] != "novel").cast("binary"), 256).alias("base_sha256"), listed(lambda s: F.lit(True)).alias("spans"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.bpe import load, round_trip

    return round_trip(table(spark, sf_dir, "documents"), load(public_tokenizers.path("byte_bpe_50k.json")))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import shard_by_bytes

    out = shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import fit_quality, score_quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.where("quality in (0, 1)").where(fold(F.col("doc_id"), 3) != 1).select("doc_id", F.col("quality").alias("label"))
    model = fit_quality(known, pick(docs, doc_id="doc_id", text="text"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.language import identify
    from tessera.llm.stages import language_model

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, language_model(docs))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Query] = {
    "op1_topk": op1_topk,
    "op2_winnow": op2_winnow,
    "op3_warc": op3_warc,
    "op4_simhash": op4_simhash,
    "op5_secrets": op5_secrets,
    "op6_bpe": op6_bpe,
    "op7_mix_sources": op7_mix_sources,
    "op8_shard": op8_shard,
    "op9_quality": op9_quality,
    "op10_language": op10_language,
}

#: The others rest on hashes, tokenizers or models that SQL doesn't have; their tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
        p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM p)
        SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5""",
    "op3_warc": """
        WITH d AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        m AS (SELECT *, payload_bytes >= 100 AND page_id <> min(page_id) OVER (PARTITION BY payload_digest) AS again, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN least END AS refers_to, true AS intact FROM m""",
}
