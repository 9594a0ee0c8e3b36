import random

import pytest
from pyspark.sql import functions as F

from lakeseek.llm import top_n as T


def brute(rows, n):
    groups = {}
    for g, item, score in rows:
        groups.setdefault(g, []).append((-score if score is not None else float("inf"), "" if item is None else item, item))
    return {(g, i) for g, v in groups.items() for _, _, i in sorted(v, key=lambda x: x[:2])[:n]}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = [("hot", f"i{k:04d}", rnd.randrange(50)) for k in range(900)]
    out += [(f"g{k % 40}", f"i{k:04d}", rnd.randrange(4)) for k in range(200)]
    return [*out, ("tiny", "only", 1), (None, "x", 5), (None, "y", 5), (None, "z", 5), (None, "a", None), ("nulls", None, 3), ("nulls", "b", None)]


@pytest.mark.parametrize("hot_rows", [10_000, 100, 1])
@pytest.mark.parametrize("n", [1, 3, 10])
def test_same_rows_for_any_split(spark, rows, hot_rows, n):
    df = spark.createDataFrame(rows, "g string, item string, score int").repartition(7)
    got = T.top_n(df, ["g"], "score", ["item"], n, hot_rows=hot_rows)
    assert {(r["g"], r["item"]) for r in got.collect()} == brute(rows, n)
    assert got.groupBy("g").agg(F.max("rank").alias("m")).where(F.col("m") > n).count() == 0


def test_ties_by_code_points(spark):
    rows = [("g", x, 1) for x in ("b", "B", "é", "z", "Ω", "𝒙", "ｚ")]
    got = T.top_n(spark.createDataFrame(rows, "g string, item string, score int"), ["g"], "score", ["item"], 7).orderBy("rank")
    assert [r["item"] for r in got.collect()] == sorted(x for _, x, _ in rows)


def test_rows_that_tie_in_everything_are_kept_up_to_n(spark):
    df = spark.createDataFrame([("g", "same", 1)] * 5, "g string, item string, score int")
    assert T.top_n(df, ["g"], "score", ["item"], 3).count() == 3
    assert T.top_n(df, ["g"], "score", ["item"], 3, hot_rows=2).count() == 3


def test_extra_columns_stay_and_rank_must_be_new(spark):
    df = spark.createDataFrame([("g", "a", 1, "x")], "g string, item string, score int, n string")
    assert T.top_n(df, ["g"], "score", ["item"], 1).columns == ["g", "item", "score", "n", "rank"]
    with pytest.raises(ValueError, match="rank"):
        T.top_n(df.withColumnRenamed("n", "rank"), ["g"], "score", ["item"], 1)


def test_empty(spark):
    df = spark.createDataFrame([], "g string, item string, score int")
    assert T.top_n(df, ["g"], "score", ["item"], 3).count() == 0


def test_distinct_rows(spark):
    rows = [("a", i) for i in range(50_000)] * 2 + [("b", 7), ("b", 7), ("b", None), ("b", None), (None, 1)]
    got = T.distinct_rows(spark.createDataFrame(rows, "k string, r bigint"), ["k"], "r")
    assert {(r["k"], r["n"]) for r in got.collect()} == {("a", 50_000), ("b", 2), (None, 1)}
