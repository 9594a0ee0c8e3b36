import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeseek.baselines import statistics
from lakeseek.operators import prepare, sampling

RAW = [("12 345", 30, "Rome", "yes", 0), ("12345", None, "Oslo", "no", 1), (None, 5, "Rome", "no", 2), ("777", 50, None, "yes", 3), ("888", 70, "Rome", "no", 4)]


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(RAW, "zip string, age bigint, city string, label string, i int")


def test_prepare(raw):
    got = prepare.prepare_query_table(raw, "zip", "label", "i")
    assert got.columns == ["zip", "age", "city", "label"]
    rows = {tuple(r) for r in got.collect()}
    assert rows == {("12345", 30.0, 0.0, 0.0), ("12345", 50.0, 1.0, 1.0), ("777", 50.0, 0.0, 0.0), ("888", 70.0, 0.0, 1.0)}


def test_prepare_variants(spark, raw):
    assert prepare.prepare_query_table(raw, "zip", "label", "i", features=[]).columns == ["zip", "label"]
    binned = prepare.prepare_query_table(raw.drop("city"), "zip", "age", "i", features=[], task="regression")
    assert dict(binned.dtypes)["age"] == "double"
    two = prepare.prepare_query_table(raw, "zip", "label", "i", features=["age"], n_bins=2)
    assert two.columns == ["zip", "age_1", "label"]
    big = raw.withColumn("huge", F.lit(1e18))
    assert "huge" not in prepare.prepare_query_table(big, "zip", "label", "i").columns
    for bad in ({"key": "nope"}, {"features": ["nope"]}):
        with pytest.raises(KeyError, match="nope"):
            prepare.prepare_query_table(raw, bad.get("key", "zip"), "label", "i", bad.get("features"))
    with pytest.raises(ValueError, match="n_bins"):
        prepare.prepare_query_table(raw, "zip", "label", "i", n_bins=1)


def test_split_is_a_partition(spark):
    df = spark.range(2000).withColumn("k", F.col("id") % 700)
    train, test = sampling.train_test_split(df, "k")
    assert train.count() + test.count() == 2000
    assert train.select("k").intersect(test.select("k")).count() == 0
    assert 250 < test.count() < 550


def test_leaks(spark):
    rnd = np.random.default_rng(0)
    parts = rnd.gamma(2, size=(1000, 4))
    frame = lambda cols: spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack(list(cols.values()))], list(cols))
    y = rnd.normal(size=500)
    assert prepare.target_leaks(frame({"copy": 2 * y, "noise": rnd.normal(size=500), "y": y}), "y", ["copy", "noise"]) == ["copy"]
    sums = frame({**{f"p{i}": parts[:, i] for i in range(4)}, "y": parts.sum(1)})
    assert sorted(prepare.target_leaks(sums, "y", ["p0", "p1", "p2", "p3"])) == ["p0", "p1", "p2", "p3"]
    helpful = frame({"x": y + rnd.normal(size=500), "y": y})
    assert prepare.target_leaks(helpful, "y", ["x"]) == []
    assert prepare.target_leaks(frame({"x": y, "y": np.zeros(500)}), "y", ["x"]) == []


def test_clean_augmented(spark):
    rows = [(float(i), 2.0 * i if i % 5 else None, float("inf") if i == 3 else 1.0, None) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = prepare.clean_augmented(df, ["a", "b", "c", "d"])
    assert got.columns == ["a", "b", "c"]
    assert got.where("b is null or c > 1e17").count() == 0
    for r in got.where(F.col("a") % 5 == 0).collect():
        assert abs(r["b"] - 2 * r["a"]) < 12


def test_random_forest(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(400, 2))
    reg = spark.createDataFrame([(i, float(a), float(b), float(3 * a)) for i, (a, b) in enumerate(x)], "i int, a double, b double, y double")
    assert prepare.random_forest_score(reg, ["a", "b"], "y", "i", "regression", trees=5)["r2"] > 0.7
    two = reg.withColumn("y", (F.col("a") > 0).cast("double"))
    got = prepare.random_forest_score(two, ["a", "b"], "y", "i", trees=5)
    assert set(got) == {"accuracy", "f1_weighted", "roc_auc"}
    assert got["accuracy"] > 0.9


def test_priority_sample_is_unbiased_for_all_rows(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(100)], "i int, x double")
    everything = sampling.priority_sample(df, "i", ["x"], 1000)
    assert everything.count() == 90
    assert everything.where("scale <> 1").count() == 0
    some = sampling.priority_sample(df, "i", ["x"], 30)
    assert some.count() == 30
    assert some.where("scale < 1").count() == 0


def test_ranks_over_blocks(spark):
    values = [i % 97 for i in range(500)]
    df = spark.createDataFrame([(i, v if i % 50 else None) for i, v in enumerate(values)], "i int, v int")
    got = {r["i"]: r["r"] for r in statistics.average_rank(df, "v", "r").collect()}
    known = sorted(v for i, v in enumerate(values) if i % 50)
    for i, v in enumerate(values):
        want = None if i % 50 == 0 else known.index(v) + (known.count(v) + 1) / 2
        assert got[i] == want
