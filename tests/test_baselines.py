import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeseek.baselines import augmenters, cells
from lakeseek.baselines import set_search as S
from lakeseek.streaming.append import StateStore, append_updates


def test_bands_and_partitions():
    b, r = S.best_bands(0.5, 128)
    assert b * r <= 128
    assert 0.3 < (1 / b) ** (1 / r) < 0.7
    assert S.best_bands(0.9, 16)[1] > S.best_bands(0.2, 16)[1]
    parts = S.size_partitions([(1, 100), (2, 50), (10, 5), (1000, 1), (1001, 1)], 3)
    assert parts[0][0] == 1
    assert parts[-1][1] == 1001
    assert all(a[1] < b[0] for a, b in zip(parts, parts[1:], strict=False))
    assert S.size_partitions([], 3) == []


def test_minhash_estimates_jaccard(spark):
    rows = [("a", f"t{i}") for i in range(200)] + [("b", f"t{i}") for i in range(100, 300)] + [("c", f"t{i}") for i in range(200)]
    m = {r["set_id"]: r["signature"] for r in S.minhash(spark.createDataFrame(rows, "set_id string, token string"), 64).collect()}
    share = lambda x, y: np.mean([p == q for p, q in zip(m[x], m[y], strict=True)])
    assert share("a", "c") == 1
    assert abs(share("a", "b") - 1 / 3) < 0.2


def test_containment_and_topk(spark):
    sets = spark.createDataFrame([("q", t) for t in "abcd"] + [("s1", t) for t in "abcx"] + [("s2", t) for t in "dxyz"] + [("s3", t) for t in "uvw"], "set_id string, token string")
    got = {(r["set_id"], r["containment"]) for r in S.containment_paths(sets, ["q"]).collect()}
    assert got == {("s1", 0.75), ("s2", 0.25)}
    top = S.exact_topk(sets, sets.where("set_id = 'q'"), 2)
    assert [(r["set_id"], r["overlap"]) for r in top.collect()] == [("q", 4), ("s1", 3)]


def test_column_pairs(spark):
    df = spark.createDataFrame([(1, "fr", "paris"), (2, "de", "berlin"), (3, "fr", "lyon"), (4, "de", None)], "i int, c string, t string")
    examples = spark.createDataFrame([("fr", "paris"), ("de", "berlin"), ("fr", "paris"), (None, "x")], "x string, y string")
    got = cells.column_pairs(cells.to_cells(df, 5, "i", ["c", "t"]), examples)
    assert [tuple(r) for r in got.collect()] == [(5, 0, 1, 2)]
    back = cells.rebuild(cells.to_cells(df, 5, "i", ["c", "t"]), 5, ["c", "t"])
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}


def test_numeric_clean(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "b"), ("x", "3"), (None, "c"), ("3", "d")], "n string, t string")
    got = cells.numeric_clean(df, ["n", "t"])
    assert [r["n"] for r in got.collect()] == [1.0, 2.0, 2.0, 0.0, 3.0]
    assert dict(got.dtypes)["t"] == "string"


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(0)
    q = spark.createDataFrame([(i, f"k{i % 40}", float(i % 40) + rnd.random()) for i in range(400)], "id int, key string, y double")
    good = spark.createDataFrame([(f"k{i}", float(i), rnd.random()) for i in range(40)], "key string, signal double, noise double")
    more = spark.createDataFrame([(f"k{i}", rnd.random()) for i in range(40)], "key string, other double")
    return q, {"good": (good, "key"), "more": (more, "key")}


def test_augmenters_find_the_signal(spark, tables):
    q, t = tables
    assert augmenters.budgeted_joins(q, "key", "y", t, 5).plan == [("good", 2.0)]
    assert augmenters.budgeted_joins(q, "key", "y", t).table.count() == 400
    got = augmenters.random_injection(q, "key", "y", t, "id", rounds=2, trees=5)
    assert "good.signal" in [c for c, _ in got.plan]
    ranked = augmenters.rank_correlation_augment(q, "key", "y", t, k_columns=1)
    assert ranked.plan[0][0] == "good.signal"
    assert ranked.table.count() == 400
    path = augmenters.path_search(q, "key", "y", t, [("", "key", "good", "key"), ("", "key", "more", "key")])
    assert path.plan[0][0] == "good.signal"
    asked = augmenters.profile_search(q, "key", "y", t, "id", queries=3, trees=5)
    assert "good.signal" in [c for c, _ in asked.plan]


def test_residual_search(spark, tables):
    q, t = tables
    good = t["good"][0]
    f = good.select(F.lit(0).alias("table_index"), F.lit("g").alias("table_name"), F.lit(0).alias("key_col_index"), "key", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in ("signal", "noise")])).alias("s")).select("table_index", "table_name", "key_col_index", "key", "s.*")
    got = augmenters.residual_r2(q, "key", "y", f, rounds=2)
    assert got.plan[0][0] == "signal"
    assert got.plan[0][1] > 0.95
    assert augmenters.label_sketch_augment(q, "key", "y", f, 1).plan[0][0] == "signal"


def test_stream_is_applied_once(spark, tmp_path):
    rows = [(f"k{i % 7}", float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, v double")
    src = tmp_path / "in"
    for i in range(4):
        df.where(F.col("v") % 4 == i).coalesce(1).write.parquet(str(src / f"p{i}"))
    store = StateStore(spark, str(tmp_path / "state"))
    for _ in range(2):  # a restart finds nothing new
        append_updates(spark, str(src), df.schema, "k", ["v"], store, str(tmp_path / "cp"), max_files=1).awaitTermination()
    assert store.newest() == 3 and not store.add(store.read(), 2)  # a batch delivered again
    got = {r["key"]: (r["count_"], r["sum_"], list(r["values_"])) for r in store.read().collect()}
    want = {f"k{j}": sorted(v for k, v in rows if k == f"k{j}") for j in range(7)}
    assert got == {k: (len(v), sum(v), v) for k, v in want.items()}


def test_batches_are_summed_up_now_and_then(spark, tmp_path):
    from lakeseek.operators import state

    store = StateStore(spark, str(tmp_path / "s"), compact=2)
    for b in range(7):
        assert store.add(state.numeric_state(spark.createDataFrame([("k", float(b))], "k string, v double"), "k", ["v"]), b)
    assert [(r["count_"], r["sum_"], r["values_"]) for r in store.read().collect()] == [(7, 21.0, [float(b) for b in range(7)])]
    assert store._numbers("sums") == [3, 5] and store._numbers("deltas") == [4, 5, 6] and store.newest() == 6
    assert not store.add(store.read(), 4)
