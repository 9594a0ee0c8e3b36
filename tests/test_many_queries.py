import random

import duckdb
import pytest

from lakeseek.plans import queries as Q


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    """Tables 0 to 400 in steps of 50, of two key columns each; one hot key, blanks, digits and repeats."""
    rnd, d = random.Random(6), str(tmp_path_factory.mktemp("lake"))
    rows = []
    for t in range(0, 401, 50):
        for c in range(2):
            keys = [f"k{rnd.randrange(60)}" for _ in range(rnd.randrange(5, 50))]
            rows += [(t, c, k, i) for i, k in enumerate([*keys, "hot", " k1 ", "", "12", None])]
    spark.createDataFrame(rows, "table_index int, key_col_index int, key string, row_index bigint").write.parquet(f"{d}/overlap_table.parquet")
    return d, rows


def test_every_query_table_is_asked(spark, lake):
    d, rows = lake
    sets, tables = {}, {}
    for t, c, k, _ in rows:
        if k and k.strip() and not k.strip().isdigit():
            sets.setdefault(f"{t}.{c}", set()).add(k.strip())
        if k:
            tables.setdefault((t, c), set()).add(k)
    tokens = {t: sets[f"{t}.0"] | sets[f"{t}.1"] for t in range(0, 401, 100)}
    keys = {t: tables[t, 0] | tables[t, 1] for t in range(0, 401, 100)}
    top = {(q, s, n) for q, v in tokens.items() for n, s in sorted(((len(v & w), s) for s, w in sets.items()), key=lambda x: (-x[0], x[1]))[:10]}
    got = Q.queries()["exact_set_overlap_topk"](spark, d).collect()
    assert {(r["query_id"], r["set_id"], r["overlap"]) for r in got} == top and len(got) == 50
    near = {(q, *p, n, round(n / len(v), 6)) for q, v in keys.items() for n, p in sorted(((len(v & w), p) for p, w in tables.items()), key=lambda x: (-x[0], x[1]))[:20]}
    got = Q.queries()["overlap_topk_lake"](spark, d).collect()
    assert {(r["query_id"], r["table_index"], r["key_col_index"], r["n"], r["ratio"]) for r in got} == near
    paths = set()
    for q in (s for s in sets if int(s.split(".")[0]) % 100 == 0):
        held = sorted(((len(sets[q] & w), s) for s, w in sets.items() if s != q and 10 * len(sets[q] & w) >= len(sets[q])), key=lambda x: (-x[0], x[1]))
        paths |= {(q, s, n) for n, s in held[:20]}
    got = Q.queries()["containment_join_paths"](spark, d).collect()
    assert {(r["query_id"], r["set_id"], r["shared"]) for r in got} == paths and len({p[0] for p in paths}) == 10


@pytest.mark.parametrize("name", ["exact_set_overlap_topk", "overlap_topk_lake", "containment_join_paths"])
def test_as_the_sql(spark, lake, name):
    c = duckdb.connect()
    c.sql(f"create view overlap_table as select * from '{lake[0]}/overlap_table.parquet/*.parquet'")
    df, rel = Q.queries()[name](spark, lake[0]), c.sql(Q.oracle_sql()[name])
    assert sorted(tuple(r) for r in df.select(*rel.columns).collect()) == sorted(rel.fetchall())
