import subprocess
import sys
from pathlib import Path

import pytest

from lakeseek.plans import queries as Q

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(same, name):
    same(Q.queries()[name], Q.oracle_sql()[name])


#: Queries without SQL: what must hold for their rows.
OTHERS = {
    "combined_features": lambda rows: {r["base_col"] for r in rows} >= {"o_totalprice", "o_orderstatus"} and all(r["value"] is not None for r in rows),
    "forward_selection_regression": lambda rows: sorted(r["step"] for r in rows) == [*range(len(rows))] != [],
    # one table may be met over two key columns, so its features may be chosen twice
    "forward_selection_classification": lambda rows: sorted(r["step"] for r in rows) == [*range(len(rows))] and (by := [r["score"] for r in sorted(rows, key=lambda r: r["step"])]) == sorted(by) != [],
    "backward_elimination": lambda rows: sorted(r["step"] for r in rows) == [*range(len(rows))] != [],
    "incremental_selection": lambda rows: sorted(r["step"] for r in rows) == [*range(len(rows))],
    "augment_customers": lambda rows: len({r["key"] for r in rows}) == len(rows) == 150,
    "union_peer": lambda rows: {r["q_col"] for r in rows} <= {"s_suppkey", "s_nationkey"} and len({r["table_name"] for r in rows}) == 1,
    "column_embedding_topk": lambda rows: ("part.p_brand", 1.0) in {(r["set_id"], r["similarity"]) for r in rows} and len(rows) == 5,
    "random_forest_score": lambda rows: "r2" in {r["metric"] for r in rows},
    "profile_search": lambda rows: "facts.length" in {r["feature"] for r in rows} and all(r["gain"] > 0 for r in rows),
    "rank_correlation_augment": lambda rows: 0 < len(rows) <= 5 and all(0 <= r["score"] <= 1 for r in rows),
    "random_injection": lambda rows: all(0 <= r["share"] <= 1 for r in rows),
    "path_search": lambda rows: len({r["feature"] for r in rows}) == len(rows),
    "label_sketch_augment": lambda rows: len(rows) == 150,
}


def test_queries_without_sql_are_these():
    assert set(OTHERS) == set(Q.queries()) - set(Q.oracle_sql())


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_others(spark, data, name):
    assert OTHERS[name](Q.queries()[name](spark, data).collect())


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_llm():
    for f in (ROOT / "lakeseek").rglob("*.py"):
        if "llm" not in f.parts:
            assert "lakeseek.llm" not in f.read_text(), f


def test_works_without_llm():
    code = "import sys; sys.modules['lakeseek.llm'] = None; import __spark_entry__ as e; assert e.queries() and not [q for q in e.queries() if q.startswith('p7')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
