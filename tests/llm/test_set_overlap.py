import random

import pytest

from lakeseek.llm import set_overlap as S


def brute(rows, share, least):
    sets = {}
    for a, b, x in rows:
        if x:
            sets.setdefault((a, b), set()).add(x)
    sets = {s: v for s, v in sets.items() if len(v) >= least}
    out = set()
    for s in sets:
        for t in sets:
            n = len(sets[s] & sets[t])
            if (s[0] is not None and t[0] is not None) and s < t and n >= share * min(len(sets[s]), len(sets[t])) and n:
                out.add((s, t, len(sets[s]), len(sets[t]), n))
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    hot = [f"hot{i}" for i in range(6)]
    pool = [f"k{i}" for i in range(80)]
    out = []
    for t in range(30):
        for c in range(2):
            mine = rnd.sample(pool, rnd.randrange(3, 30)) + rnd.sample(hot, rnd.randrange(7))
            out += [(t, c, x) for x in mine for _ in range(rnd.randrange(1, 3))]
    out += [(90, c, x) for c in range(3) for x in hot]  # sets of nothing but frequent ids
    out += [(91, 0, None), (91, 0, ""), (91, 0, "k1"), (92, 0, "k1")]
    return out


def got(df, *args, **kw):
    p = S.overlapping_pairs(df, ["t", "c"], "x", *args, **kw)
    return {(tuple(r["set_a"]), tuple(r["set_b"]), r["n_a"], r["n_b"], r["shared"]) for r in p.collect()}


@pytest.mark.parametrize("common", [0, 3, 64])
@pytest.mark.parametrize(("share", "least"), [(0.5, 4), (0.3, 1), (0.9, 2), (1.0, 1)])
def test_no_pair_is_lost(spark, rows, share, least, common):
    df = spark.createDataFrame(rows, "t int, c int, x string").repartition(5)
    assert got(df, share, least, common=common) == brute(rows, share, least)


def test_clashing_columns_and_single_set(spark, rows):
    df = spark.createDataFrame([(1, 0, "a", 5, 6), (1, 0, "b", 5, 6)], "t int, c int, x string, n int, set int")
    assert got(df, 0.5, 1) == set()
    df = spark.createDataFrame([(1, 0, "a", 5, 6), (2, 0, "a", 5, 6)], "t int, c int, x string, id int, held int")
    assert got(df, 0.5, 1) == {((1, 0), (2, 0), 1, 1, 1)}


def test_half_of_an_odd_number_is_rounded_up(spark):
    a = [(1, 0, f"k{i}") for i in range(41)]
    b = [(2, 0, f"k{i}") for i in range(20)] + [(2, 0, f"z{i}") for i in range(30)]
    assert got(spark.createDataFrame(a + b, "t int, c int, x string"), 0.5, 40) == set()
    assert len(got(spark.createDataFrame([*a, *b, (2, 0, "k20")], "t int, c int, x string"), 0.5, 40)) == 1


def test_empty(spark):
    assert got(spark.createDataFrame([], "t int, c int, x string")) == set()
