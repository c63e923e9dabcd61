import pytest

from arzyab.llm import queries
from tests.test_queries import duck, same  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, small, name):  # noqa: F811
    same(spark, duck, small, queries.QUERIES[name], queries.SQL[name])


COLUMNS = {
    "p2_found": ["source_row_id", "field_name"], "p3_found": ["source_row_id", "pii_type"], "p7_found": ["row_id_a", "row_id_b"], "p10_found": ["doc_id", "lang_code"],
}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_other_queries_run(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    assert df.columns == COLUMNS.get(name, df.columns) and df.count() > 0
    if name in COLUMNS:
        assert df.distinct().count() == df.count()
