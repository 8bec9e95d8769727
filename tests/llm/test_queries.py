"""Registered queries of this subpackage beside their SQL, and their shapes."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from fleetlens.llm.queries import LLM_ORACLES, LLM_QUERIES

SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="driver tables are not here")

COLUMNS = {
    1: ["query_id", "rank", "vec_id", "score"],
    2: ["page_id", "host", "path", "rule", "verdict"],
    3: ["doc_id", "held_out", "score", "predicted"],
    4: ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    5: ["doc_id", "n_words", "n_removed", "kept_sha256"],
    6: ["doc_id", "held_out", "score", "predicted"],
    7: ["doc_id", "mix_copy"],
    8: ["vec_id", "n_links", "component_id", "kept"],
    9: ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    10: ["doc_id", "fingerprint", "component_id"],
    11: ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    12: ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    13: ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
}


def test_every_operator_has_a_query():
    registered = entry_point.queries()
    assert {n: sum(q.startswith(f"op{n}_") for q in registered) for n in COLUMNS} == dict.fromkeys(COLUMNS, 1)
    assert "pipeline" in registered


@pytest.mark.parametrize("name", list(LLM_QUERIES))
def test_columns_and_rows(spark, name):
    df = LLM_QUERIES[name](spark, str(SF_DIR))
    number = int(name[2:].split("_")[0])
    assert set(COLUMNS[number]) <= set(df.columns)
    table = {1: "embeddings", 8: "embeddings", 2: "pages"}.get(number, "documents")
    rows = df.collect()
    if number not in (1, 4, 7, 11, 12):
        assert len(rows) == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
    if name in LLM_ORACLES:
        con = duckdb.connect()
        for file in SF_DIR.glob("*.parquet"):
            con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
        columns = sorted(df.columns)
        cursor = con.execute(LLM_ORACLES[name])
        theirs = [d[0] for d in cursor.description]
        assert sorted(theirs) == columns
        place = [theirs.index(c) for c in columns]
        expected = sorted(tuple(str(r[i]) for i in place) for r in cursor.fetchall())
        assert sorted(tuple(str(r[c]) for c in columns) for r in rows) == expected
