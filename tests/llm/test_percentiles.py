import math
import random

import pytest
from pyspark.sql import functions as F

from lakeseek.llm import percentiles as P

ROW = "g string, day int, v array<double>"
SMALL = {"k": 16, "leaf_values": 92, "fan_in": 4}


def exact(values, q):
    values = sorted(values)
    return values[max(1, math.ceil(round(q * len(values), 9))) - 1]


def good(v):
    return [x for x in v or [] if x is not None and x == x and abs(x) <= 1e17]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out = []
    for g, n in (("hot", 300), ("cold", 4), (None, 20), ("ties", 60)):
        for day in range(n):
            v = [3.0] * rnd.randrange(9) if g == "ties" else [rnd.lognormvariate(0, 2) * rnd.choice([1, -1, 1]) for _ in range(rnd.randrange(12))]
            out.append((g, day, [*v, None, float("nan"), float("inf"), -float("inf"), 1e18, -2e17]))
    out.append(("none", 0, [None, float("nan")]))
    out.append(("null", 0, None))
    return out


def values_of(rows):
    out = {}
    for g, _, v in rows:
        out.setdefault(g, []).extend(good(v))
    return {g: v for g, v in out.items() if v}


@pytest.mark.parametrize("options", [{}, SMALL])
def test_bounds_hold_and_repeats_count_once(spark, rows, options):
    df = spark.createDataFrame(rows + rows[:40], ROW)
    states = P.sketch(df, ["g"], "v", ["day"], **options)
    qs = {"p1": 0.01, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r["g"]: r for r in P.percentiles(states, ["g"], qs).collect()}
    want = values_of(rows)
    assert set(got) == set(want)
    for g, v in want.items():
        assert got[g]["n"] == len(v)
        for name, q in qs.items():
            assert got[g][f"{name}_low"] <= exact(v, q) <= got[g][f"{name}_high"]
        # the estimate's rank is as close as promised
        order = sorted(v)
        below = sum(x < got[g]["p50"] for x in order)
        upto = sum(x <= got[g]["p50"] for x in order)
        r = max(1, math.ceil(round(0.5 * len(v), 9)))
        slack = got[g]["err"] + math.ceil(len(v) / options.get("k", 1024))
        assert below - slack <= r <= upto + slack


def test_error_stays_bounded(spark, rows):
    states = P.sketch(spark.createDataFrame(rows, ROW), ["g"], "v", ["day"], **SMALL)
    for r in states.collect():
        assert len(r["buf"]) <= SMALL["k"]
        assert r["buf"] == sorted(r["buf"])
        assert r["err"] <= r["n"] * 4 / (2 * SMALL["k"]) + 4


def test_states_of_days_combine(spark, rows):
    df = spark.createDataFrame(rows, ROW)
    parts = [P.sketch(df.where(F.col("day") % 3 == i), ["g"], "v", ["day"], k=16) for i in range(3)]
    merged = P.merge_states(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["g"], 16)
    want = values_of(rows)
    got = {r["g"]: r for r in P.percentiles(merged, ["g"], {"m": 0.5}).collect()}
    assert {g: r["n"] for g, r in got.items()} == {g: len(v) for g, v in want.items()}
    for g, v in want.items():
        assert got[g]["m_low"] <= exact(v, 0.5) <= got[g]["m_high"]


@pytest.mark.parametrize("fan_in", [4, 64])
def test_states_of_single_days_combine_along_the_tree(spark, rows, fan_in):
    df = spark.createDataFrame(rows, ROW)
    days = P.sketch(df, ["g", "day"], "v", None, k=8)
    qs = {"m": 0.5, "u": 0.9}
    known = P.percentiles(P.combine(days, ["g"], ["day"], 8, fan_in), ["g"], qs)
    want = values_of(rows)
    assert {r["g"]: r["n"] for r in known.collect()} == {g: len(v) for g, v in want.items()}
    held = P.hold_truth(df, known, ["g"], "v", ["day"], qs).collect()
    assert {tuple(r) for r in held} == {(g, len(v), True, True) for g, v in want.items()}
    # bounds that are off don't hold
    off = P.hold_truth(df, known.withColumn("m_high", F.col("m_low") - 1).withColumn("m_low", F.col("m_high")), ["g"], "v", ["day"], qs)
    assert {r["m_held"] for r in off.collect()} == {False}
    assert P.combine(days.limit(0), ["g"], ["day"]).count() == 0


def test_a_row_of_many_values_counts_as_many(spark):
    df = spark.createDataFrame([("a", i, [float(i * 100 + j) for j in range(100)]) for i in range(20)], ROW)
    state = P.sketch(df, ["g"], "v", ["day"], k=16, leaf_values=200, fan_in=4).collect()
    assert [(r["n"], len(r["buf"]) <= 16, r["err"] > 0) for r in state] == [(2000, True, True)]


@pytest.mark.parametrize("options", [{}, SMALL])
@pytest.mark.parametrize("factor", [1.5, 4.0, 8.0, 12.0])
def test_ratio_is_exact(spark, rows, options, factor):
    df = spark.createDataFrame(rows + rows[:40], ROW).withColumn("n", F.lit("clash")).withColumn("buf", F.lit(1))
    got = {r["g"] for r in P.ratio_exceeds(df, ["g"], "v", ["day"], 0.9, 0.5, factor, 10, **options).collect()}
    assert got == {g for g, v in values_of(rows).items() if len(v) >= 10 and exact(v, 0.9) > factor * exact(v, 0.5)}


def test_without_row_identity_every_row_counts(spark, rows):
    df = spark.createDataFrame(rows + rows, ROW)
    got = {r["g"]: r["n"] for r in P.sketch(df, ["g"], "v", None, **SMALL).collect()}
    assert got == {g: 2 * len(v) for g, v in values_of(rows).items()}


def test_empty_table(spark):
    df = spark.createDataFrame([], ROW)
    assert P.sketch(df, ["g"], "v", ["day"]).count() == 0
    assert P.ratio_exceeds(df, ["g"], "v", ["day"], 0.9, 0.5, 8.0, 1).count() == 0


def test_names_of_states_cannot_be_keys(spark):
    df = spark.createDataFrame([("a", [1.0])], "n string, v array<double>")
    with pytest.raises(ValueError, match="n"):
        P.sketch(df, ["n"], "v")


def test_place_is_decimal(spark):
    row = spark.createDataFrame([(10,), (30,), (1,)], "n bigint").select("n", P.place(0.9).alias("r"), P.place(0.1).alias("s")).collect()
    assert [(r["n"], r["r"], r["s"]) for r in row] == [(10, 9, 1), (30, 27, 3), (1, 1, 1)]
