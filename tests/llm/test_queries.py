"""The registered queries: those with SQL against DuckDB, the others for their columns and whole results."""

import os

import duckdb
import pytest

from quillspark.llm import queries as Q

from ..test_queries import SF, TABLES, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

COLUMNS = {
    "op1_lm": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op2_embeddings": "vec_id n_links component_id kept",
    "op3_language": "doc_id held_out lang_pred score",
    "op4_substrings": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op6_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op9_minhash": "doc_id n_shingles component_id kept",
    "op10_quality": "doc_id held_out score predicted",
}


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, name):
    got = Q.QUERIES[name](spark, SF).toPandas()
    assert not set(COLUMNS.get(name, "").split()) - set(got.columns)
    if name in Q.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(Q.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    elif name != "op6_packing":
        assert len(got) == duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet'").df().shape[0]
