import pytest

from keepstream.plans import core_queries, eval_queries, io_queries, selection_queries
from tests.conftest import same_as_sql

PARTS = (core_queries, selection_queries, eval_queries, io_queries)
QUERIES = {n: f for p in PARTS for n, f in p.queries().items()}
SQL = {n: s for p in PARTS for n, s in p.oracle_sql().items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, folder, name):
    same_as_sql(spark, folder, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert df.columns and df.count() > 0


def test_entry(spark, folder):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_library_does_not_need_llm():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "keepstream"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "keepstream.llm" not in p.read_text()
