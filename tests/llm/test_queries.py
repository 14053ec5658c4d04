"""The registered text queries run over the smallest tables, and match their SQL where there is one."""

import pytest

from lexmill.llm import queries as Q
from tests.compare import connect, same

COLUMNS = {
    "p1_found": ["document_id", "line_no"], "p4_found": ["item_table", "item_id", "line_no", "kind"], "p6_found": ["item_table", "item_id", "boundary"],
    "p7_found": ["id_a", "id_b"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "kind"],
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(name, spark, sf_dir, duck):
    df = Q.queries()[name](spark, sf_dir)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name in Q.oracle_sql():
        same(df, duck, Q.oracle_sql()[name])
    else:
        assert df.count() > 0
