"""The registered queries over whole tables: against their SQL, or the columns that they owe."""

import os

import duckdb
import pytest

from millrace.llm import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

COLUMNS = {
    "op1": "page_id url text n_chars",
    "op2": "doc_id size source_size target taken",
    "op3": "doc_id held_out score predicted",
    "op4": "doc_id piece start length ids_crc32 sequence_id offset",
    "op5": "page_id payload_bytes payload_digest record_type refers_to",
    "op6": "doc_id n_shingles component_id",
    "op7": "doc_id n_words n_removed kept_sha256",
    "op8": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op9": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op10": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_ten_operators():
    assert sorted(q.split("_")[0] for q in registry.QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    want = COLUMNS[name.split("_")[0]].split()
    assert df.columns[: len(want)] == want
    rows = df.collect()
    table = "pages" if name.split("_")[0] in ("op1", "op5") else "documents"
    n = duck.sql(f"SELECT count(*) FROM {table}").fetchall()[0][0]
    assert len(rows) == n or name.startswith("op4_") and len(rows) >= n
    if name in registry.ORACLES:
        rel = duck.sql(registry.ORACLES[name])
        assert sorted(rel.columns) == sorted(df.columns)
        at = [rel.columns.index(c) for c in df.columns]
        show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
        assert sorted(tuple(show(r[c]) for c in df.columns) for r in rows) == sorted(tuple(show(r[i]) for i in at) for r in rel.fetchall())
