import pytest

from stocklore.llm import queries
from tests.conftest import same_rows

COLUMNS = {"p1_found": ["group_id", "material_id"], "p2_found": ["first_id", "copy_id"], "p4_found": ["first_id", "listing_id"], "p6_found": ["entry_id", "reference_entry"], "p7_found": ["corpus_id"], "p10_found": ["doc_id", "end_char"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    assert df.count() > 0
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, folder, duck, name):
    assert same_rows(queries.QUERIES[name](spark, folder).toPandas(), duck.execute(queries.ORACLES[name]).df())
