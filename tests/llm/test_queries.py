"""The registered queries: their columns, and the rows that SQL gives where there is SQL."""

from __future__ import annotations

import os

import duckdb
import pytest

from tessera.llm.queries import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("TESSERA_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
COLUMNS = {
    "op1_topk": "query_id:bigint rank:int vec_id:bigint score:bigint",
    "op2_winnow": "doc_id:bigint n_chars:bigint edited_sha256:string fingerprint:string edited_fingerprint:string near_edited:double near_next:double",
    "op3_warc": "page_id:bigint payload_bytes:bigint payload_digest:string record_type:string refers_to:bigint",
    "op4_simhash": "doc_id:bigint fingerprint:string component_id:bigint",
    "op5_secrets": "doc_id:bigint n_assign:bigint n_access:bigint n_hex:bigint base_sha256:string spans:string",
    "op6_bpe": "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string",
    "op7_mix_sources": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint",
    "op8_shard": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    "op9_quality": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op10_language": "doc_id:bigint held_out:boolean lang_pred:string score:double",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    got = QUERIES[name](spark, FOLDER)
    kinds = dict(got.dtypes)
    assert {c: kinds.get(c) for c in (x.split(":")[0] for x in COLUMNS[name].split())} == dict(x.split(":") for x in COLUMNS[name].split())
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in ("embeddings", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        found = con.execute(ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in got.select(*names).collect())
    else:
        assert got.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_every_operator_has_a_query():
    assert set(QUERIES) == set(COLUMNS)
