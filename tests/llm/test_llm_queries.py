import pytest

from keepstream.llm import queries
from tests.conftest import same_as_sql

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, folder, name):
    same_as_sql(spark, folder, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, folder, name):
    """What SQL cannot say of these is held by the checked queries and the tests of the operators; here, that there is a row per key."""
    df = QUERIES[name](spark, folder)
    keys = {"p2_sample": ["id"], "p2_report": ["task"], "p5_found": ["record_id"], "p5_workers": ["worker"], "p6_found": ["src", "pair_id"], "p7_ids": ["doc_id"], "p8_mix": ["doc_id"], "p8_shares": ["source"], "p9_pieces": ["doc_id", "piece_no"], "p9_found": ["doc_id"]}.get(name, df.columns)
    n = df.count()
    assert n > 0 and df.select(*keys).distinct().count() == n


def test_fixed_columns(spark, folder):
    assert QUERIES["p5_found"](spark, folder).dtypes == [("record_id", "bigint")]
    assert QUERIES["p6_found"](spark, folder).dtypes == [("src", "string"), ("pair_id", "bigint"), ("defect", "string")]
    assert QUERIES["p7_ids"](spark, folder).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert QUERIES["p9_found"](spark, folder).dtypes == [("doc_id", "bigint")]


def test_ids_of_every_document(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert QUERIES["p7_ids"](spark, folder).count() == docs.count()


def test_found_pairs_have_named_defects(spark, folder):
    found = QUERIES["p6_found"](spark, folder)
    assert {r[0] for r in found.select("defect").distinct().collect()} <= {"empty", "truncated", "refusal", "copies_question", "other_language"}
    # a cut record is cut in both queries, unless another defect names the pair
    cut = QUERIES["p5_found"](spark, folder).withColumnRenamed("record_id", "pair_id")
    named = found.filter("src = 'run_records'")
    assert cut.join(named, "pair_id", "left_anti").isEmpty()
    assert named.filter("defect = 'truncated'").join(cut, "pair_id", "left_anti").isEmpty()
