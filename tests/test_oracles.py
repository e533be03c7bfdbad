"""Every query with SQL gives the SQL's rows; the others run and keep a stable schema."""

import pytest

import stocklore.plans.registry as registry
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, folder, duck, name):
    ours = registry.QUERIES[name](spark, folder).toPandas()
    assert same_rows(ours, duck.execute(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, folder, name):
    df = registry.QUERIES[name](spark, folder)
    assert df.columns
    df.count()


def test_entry_lists_everything(spark, folder):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries()["p5_found"](spark, folder).columns == ["row_id", "check_code"]


def test_core_does_not_import_the_subpackage():
    import pathlib

    root = pathlib.Path(registry.__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            text = p.read_text()
            assert "stocklore.llm" not in text and "from ..llm" not in text and "from .llm" not in text, p
