import pytest
from compare import same

from lexiscope.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, oracle, root, name):
    same(spark, oracle, QUERIES[name], SQL[name], root)


@pytest.mark.parametrize("name,columns", [
    ("p1_found", ["repo_full_name", "artifact_id"]), ("p2_found", ["artifact_type", "matched_expression"]), ("p3_found", ["repo_full_name", "artifact_type", "artifact_id", "matched_expression"]),
    ("p5_found", ["item_id"]), ("p7_found", ["repo_a", "repo_b"]), ("p8_ids", ["doc_id", "ids"]), ("p10_found", ["doc_id"]),
])
def test_columns(spark, root, name, columns):
    df = QUERIES[name](spark, root)
    assert df.columns == columns and df.count() == df.distinct().count()
