"""Queries against their SQL, and the columns that the contracts name."""

from __future__ import annotations

import duckdb
import pytest

from tidemark.llm.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: The first columns of each result.
COLUMNS = {
    "op2_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op3_substrings": "doc_id n_words n_removed kept_sha256",
    "op4_ann": "query_id rank vec_id score",
    "op6_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op8_toxicity": "doc_id held_out score predicted",
    "op9_urls": "page_id host path rule verdict",
    "op10_shards": "doc_id size text_crc32 law shard slot grown_shard",
}


@pytest.mark.parametrize("name", ORACLES)
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    rel = con.sql(ORACLES[name])
    df = QUERIES[name](spark, SF).select(*rel.columns)
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    want = COLUMNS[name].split()
    assert QUERIES[name](spark, SF).columns[: len(want)] == want


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
