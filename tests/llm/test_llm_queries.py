import pytest

from lakeseek.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(same, name):
    same(Q.queries()[name], Q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_others_run(spark, data, name):
    assert Q.queries()[name](spark, data).count() > 0


def test_columns(spark, data):
    want = {
        "p1_found": ["col_name", "key"], "p2_found": ["table_index", "key_col_index", "key"], "p4_found": ["table_index_a", "key_col_index_a", "table_index_b", "key_col_index_b"],
        "p6_found": ["field", "table_index", "text_a", "text_b"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
    }
    assert {k: Q.queries()[k](spark, data).columns for k in want} == want
