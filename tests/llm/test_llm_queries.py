"""The pN_ queries on whole small tables, against SQL or brute force."""

import pytest
from helpers import rows_of

from blockmill.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "p1_found": ["block_id", "line_no"],
    "p2_found": ["rec", "rec_id"],
    "p4_found": ["chunk_id"],
    "p5_found": ["chunk_id_a", "chunk_id_b"],
    "p6_ids": ["doc_id", "ids"],
    "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, tables, name):
    df = QUERIES[name](spark, data)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    got = df.toPandas()
    assert len(got) > 0
    if name != "p6_ids":
        assert not got.duplicated().any()
    if name in ORACLES:
        assert rows_of(got) == rows_of(tables.sql(ORACLES[name]).df())


def test_first_query_of_each_problem(data):
    first = {}
    for name in QUERIES:
        first.setdefault(name.split("_")[0], name)
    assert first["p3"] == "p3_containers" and first["p7"] == "p7_mixture"
