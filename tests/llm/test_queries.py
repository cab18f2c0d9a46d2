"""The registered queries: names, columns of their contracts, and the SQL where there is some."""

import os

import duckdb
import pytest
from lakeloom.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
CONTRACT = {
    "op1": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op3": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op4": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op6": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op7": {"query_id", "rank", "vec_id", "score"},
    "op9": {"doc_id", "fingerprint", "component_id"},
}


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_on_whole_tables(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert CONTRACT.get(name.split("_")[0], set()) <= set(df.columns)
    got = df.collect()
    if name != "op7_ann":
        assert len(got) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    if name in SQL:
        con = duckdb.connect()
        p = f"{FOLDER}/documents.parquet"
        con.sql(f"create view documents as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
        cols = sorted(df.columns)
        want = con.sql(f"select {','.join(cols)} from ({SQL[name]})").fetchall()
        assert sorted(map(str, (tuple(r[c] for c in cols) for r in got))) == sorted(map(str, want))
