import datetime

from lakeseek.operators import state
from lakeseek.plans import queries as Q


def test_whole_states_are_merged(spark, tmp_path):
    day = datetime.date(2024, 1, 1)
    row = lambda key, values, d=day, total=None: (1, 0, key, "x", len(values), sum(values) if total is None else total, min(values), max(values), values, d)
    rows = [row("a", [1.0, 2.0, 9.0]), row("a", [1.0, 2.0, 9.0]), row("a", [1.0, 5.0, 9.0]), row("a", [0.5], datetime.date(2024, 1, 2)), row("b", [3.0]), row("b", [3.0], total=4.0), row(None, [7.0])]
    schema = "table_index int, key_col_index int, key string, col_name string, count_ bigint, sum_ double, min_ double, max_ double, values_ array<double>, state_day date"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/num_state.parquet")
    shown = {r["key"]: (r["count_"], r["min_"], r["max_"], r["values_"]) for r in Q.queries()["lake_state_merge"](spark, str(tmp_path)).collect()}
    merged = state.merge_numeric([spark.read.parquet(f"{tmp_path}/num_state.parquet").distinct()], ["key"]).collect()
    got = {r["key"]: (r["count_"], r["sum_"], r["min_"], r["max_"], r["values_"]) for r in merged}
    assert shown == {k: (v[0], *v[2:]) for k, v in got.items()}
    assert got == {"a": (7, 27.5, 0.5, 9.0, [0.5, 1.0, 1.0, 2.0, 5.0, 9.0, 9.0]), "b": (2, 7.0, 3.0, 3.0, [3.0, 3.0]), None: (1, 7.0, 7.0, 7.0, [7.0])}
