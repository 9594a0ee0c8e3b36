import random

import pytest

from lakeseek.baselines import set_search as S
from lakeseek.plans import queries as Q


def brute(rows, least):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, set()).add(t)
    return {(a, b, len(x & y)) for a, x in sets.items() for b, y in sets.items() if a != b and 10 * len(x & y) >= 10 * least * len(x) - 1e-6}


@pytest.mark.parametrize("least", [0.8, 0.5, 1.0])
def test_every_containing_set(spark, least):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = [(f"wide{k}", t) for k in range(4) for t in ["hot", *rnd.sample(words, 1500)]]
    rows += [(f"one{k}", "hot") for k in range(3)]
    for k, n in enumerate([1, 2, 4, 5, 10, 40, 200, 700] * 3):
        inside = [t for i, t in rows if i == f"wide{k % 4}"]
        kept = rnd.choice([n, -(-n * 8 // 10), n * 7 // 10])
        rows += [(f"part{k}", t) for t in [*rnd.sample(inside, kept), *[f"own{k}.{j}" for j in range(n - kept)]]]
    sets = spark.createDataFrame(rows, "set_id string, token string").distinct()
    got = {(r["query_id"], r["set_id"], r["shared"]) for r in S.containing_sets(sets, least).collect()}
    assert got == brute(rows, least) and len(got) > 20


def test_lake_pairs(spark, data, sql):
    from lakeseek.plans.queries_baselines import lake_sets

    want = brute([(r["set_id"], r["token"]) for r in lake_sets(spark, data).collect()], 0.8)
    got = {(r["query_id"], r["set_id"], r["shared"]) for r in Q.queries()["ensemble_candidates"](spark, data).collect()}
    assert got == want
