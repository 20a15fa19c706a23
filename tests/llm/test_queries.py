"""The queries over the smallest tables, against SQL where there is any."""

import glob
import os

import duckdb
import pytest

from mnemolake.llm.queries import QUERIES
from mnemolake.llm.sql import ORACLE

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
FORMS = {
    "p1_found": {"memory_id": "string", "group_id": "string"},
    "p2_found": {"memory_id": "string", "note_field": "string", "pii_type": "string", "nth": "int"},
    "p3_found": {"graph_id": "string", "name_a": "string", "name_b": "string"},
    "p4_found": {"memory_id_a": "string", "memory_id_b": "string"},
    "p5_found": {"chunk_id": "string"},
    "p6_found": {"memory_id_a": "string", "memory_id_b": "string"},
    "p9_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DATA)
    if name in FORMS:
        assert dict(got.dtypes) == FORMS[name]
    found = [tuple(r) for r in got.collect()]
    if name.endswith("_found"):
        assert len(found) == len(set(found))
    if name in ORACLE:
        c = duckdb.connect()
        for p in glob.glob(f"{DATA}/*.parquet"):
            c.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
        want = c.sql(ORACLE[name])
        order = [got.columns.index(x) for x in want.columns]
        assert sorted(tuple(r[i] for i in order) for r in found) == sorted(want.fetchall())
