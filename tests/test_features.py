import pytest
from pyspark.sql import functions as F

from lakeseek.functions import text as X
from lakeseek.operators import features as feat
from lakeseek.operators import materialize, state


def rows_of(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect()}


@pytest.mark.parametrize(("raw", "want"), [("St. Gallen ", "stgallen"), ("1.0", "1"), ("1.05", "15"), ("Müller–Ñ", "mullern"), ("ＡＢ１", "ab1"), ("", ""), ("--", ""), (None, None), ("a b", "ab")])
def test_normalize_key(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "k string")
    assert df.select(X.normalize_key(F.col("k"))).first()[0] == want
    assert df.select(X.normalize_key_exact(F.col("k"))).first()[0] == want


def test_strict_key_and_names(spark):
    df = spark.createDataFrame([("1.05",), ("7.0",)], "k string")
    assert [r[0] for r in df.select(X.normalize_key(F.col("k"), strict=True)).collect()] == ["105", "7"]
    assert X.column_names(["Zip Code", "zip_code", "Größe", "ZIPCODE"]) == ["zipcode", "zipcode1v2", "groe", "zipcode3v2"]
    assert [X.base_name(n) for n in ("a_mean", "a_b_share", "a_max^2", "plain")] == ["a", "a_b", "a^2", "plain"]
    got = spark.createDataFrame([("camelCaseName",), ("HTTPServer x",)], "k string").select(X.snake_case(F.col("k")))
    assert [r[0] for r in got.collect()] == ["camel_case_name", "http_server_x"]


PASSENGERS = [("A", "male", None, "S"), ("B", "female", "C1", "C"), ("C", "female", None, "S"), ("D", "male", None, "Q"), ("E", "male", None, "S"), ("F", "male", None, "C")]


def test_category_shares(spark):
    df = spark.createDataFrame(PASSENGERS, "name string, sex string, cabin string, port string")
    got = feat.category_shares(df, "name", ["sex", "cabin", "port"])
    assert sorted(got.columns) == ["key", "port_c_share", "port_q_share", "sex_female_share"]
    beers = spark.createDataFrame([("x", "ale"), ("x", "lager"), ("y", "ale"), ("y", None), ("x", "ale"), ("x", "stout")], "state string, style string")
    shares = feat.category_shares(beers, "state", ["style"], m=3)
    assert rows_of(shares, "key", "style_ale_share") == {("x", 0.5), ("y", 0.5)}
    assert rows_of(shares, "key", "style_lager_share") == {("x", 0.25), ("y", 0.0)}
    assert feat.share_names("kind", ["A b", "ab", "--"]) == ["kind_ab_share", "kind_ab2_share", "kind_value3_share"]


def test_numeric_and_text_features(spark):
    df = spark.createDataFrame([("k1", 1.0, "a"), ("k1", None, "a"), ("k2", 4.0, None), ("k2", 7.0, "b"), (None, 100.0, "z"), ("K 1", 2.0, "b")], "k string, x double, t string")
    num = feat.numeric_features(df, "k", ["x"])
    assert rows_of(num.withColumn("x_mean", F.round("x_mean", 6)), "key", "x_mean", "x_median", "x_max", "x_min") == {("k1", 2.166667, 2.0, 3.5, 1.0), ("k2", 5.5, 5.5, 7.0, 4.0)}
    txt = feat.text_features(df, "k", ["t"])
    # the mode is a (of a, a, b, b the smaller), two values in the column
    assert rows_of(txt, "key", "t_mean", "t_max", "t_nunique") == {("k1", 3 / 4, 1.0, 2.0), ("k2", 2 / 4, 0.5, 1.0)}


def test_features_of_hot_keys(spark, monkeypatch):
    import random

    rnd = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 20}", rnd.random() if i % 7 else None, float(rnd.randrange(4))) for i in range(2001)]
    df = spark.createDataFrame([*rows, ("warm", 1.0, 2.0), ("warm", None, 4.0)], "k string, x double, y double").repartition(6)
    want = {tuple(r) for r in feat.numeric_features(df, "k", ["x", "y"]).select("key", *[F.round(f"{c}_{a}", 9) for c in "xy" for a in feat.AGGREGATES]).collect()}
    monkeypatch.setattr(feat, "HOT_ROWS", 30)
    got = feat.numeric_features(df, "k", ["x", "y"])
    assert set(got.columns) == {"key", *[f"{c}_{a}" for c in "xy" for a in feat.AGGREGATES]}
    assert {tuple(r) for r in got.select("key", *[F.round(f"{c}_{a}", 9) for c in "xy" for a in feat.AGGREGATES]).collect()} == want


def test_combined_drops_equal_and_constant_columns(spark):
    df = spark.createDataFrame([(i, float(i * i % 7), 5.0) for i in range(30)], "k int, x double, c double")
    assert feat.combined_features(df, "k", ["x", "c"], []).columns == ["key", "x_min"]
    classes = feat.duplicate_columns(feat.numeric_features(df, "k", ["x"]), "key", ["x_mean", "x_median", "x_max", "x_min"])
    assert classes == [["x_mean", "x_median", "x_max", "x_min"]]


def test_useful_and_key_columns(spark):
    rows = [(i, "c" if i % 2 else "d", None if i % 10 else 1, "same", "x" * 150 if i % 2 else "y" * 120, bool(i == 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "uniq int, cat string, sparse int, const string, prose string, flag boolean")
    assert feat.useful_columns(df) == ["cat"]
    keys = spark.createDataFrame([(1, "a", "b", None, "q"), (2, "c", "d", None, "q")], "city int, ref_no string, myid string, empty string, one string")
    assert feat.key_candidates(keys) == ["city"]


@pytest.mark.parametrize("chunks", [2, 3])
def test_state_equals_full(spark, chunks):
    import random

    rnd = random.Random(6)
    rows = [(f"k{rnd.randrange(30)}" if i % 50 else f"single{i}", float(rnd.randrange(1000)) / 7, f"c{rnd.randrange(8)}", i) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, n0 double, c0 string, i int")
    parts = [df.where(F.col("i") % chunks == j) for j in range(chunks)]
    num = state.merge_numeric([state.numeric_state(p, "k", ["n0"]) for p in parts], ["key", "col_name"])
    txt = state.merge_text([state.text_state(p, "k", ["c0"]) for p in parts], ["key", "col_name", "category"])
    got = {(r["key"], r["feature"]): r["value"] for r in state.derive(num, txt).collect()}
    full = feat.numeric_features(df, "k", ["n0"]).join(feat.text_features(df, "k", ["c0"]), "key")
    want = {(r["key"], c): r[c] for r in full.collect() for c in full.columns if c != "key"}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_state_needs_every_column(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("b", None, "x"), ("c", 2.0, None)], "k string, n double, t string")
    got = state.derive(state.numeric_state(df, "k", ["n"]), state.text_state(df, "k", ["t"]))
    assert {r["key"] for r in got.collect()} == {"a"}


def test_bins_and_powers(spark):
    df = spark.createDataFrame([(float(i),) for i in range(8)] + [(None,)], "x double")
    out = materialize.bin_indicators(materialize.power_columns(df, "x", 3), "x", 4)
    assert [c for c in out.columns if "=" in c] == [f"x=bin_{i}" for i in range(4)]
    assert out.agg(F.sum("`x=bin_3`"), F.sum("`x^2`"), F.sum("`x^3`")).first() == (2.0, 140.0, 784.0)
    tied = spark.createDataFrame([(1.0,)] * 9 + [(2.0,)], "x double")
    assert materialize.bin_edges(tied, "x", 4) == [1.0]


def test_augment_keeps_rows(spark):
    q = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, i int")
    f = spark.createDataFrame([(0, 0, "a", "x_mean", 5.0), (0, 0, "c", "x_mean", 6.0), (1, 0, "a", "x_mean", 7.0)], "table_index int, key_col_index int, key string, feature string, value double")
    names = materialize.friendly_names([(0, 0, "t.csv", "x_mean"), (1, 0, "t.csv", "x_mean")])
    assert names == ["t.csv.x_mean__0_0_0", "t.csv.x_mean__1_0_1"]
    got = materialize.augment(q, "k", f, [(0, 0, "x_mean"), (1, 0, "x_mean")], ["p", "q"])
    assert rows_of(got, "i", "p", "q") == {(1, 5.0, 7.0), (2, 5.0, 7.0), (3, None, None), (4, None, None)}
    assert materialize.augment(q, "k", f, [], []) is q


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, x double, t string")
    assert feat.numeric_features(df, "k", ["x"]).count() == 0
    assert feat.text_features(df, "k", ["t"]).count() == 0
    assert feat.useful_columns(df) == []
    assert state.numeric_state(df, "k", ["x"]).count() == 0


def test_long_keys_stay_distinct(spark):
    from lakeseek.operators.prepare import prepare_query_table

    a, b = "x" * 340 + "a", "x" * 340 + "b"
    df = spark.createDataFrame([(a, 1.0, 0), (b, 3.0, 1), ("y" * 335, 5.0, 2)], "k string, v double, o int")
    got = feat.numeric_features(df, "k", ["v"]).collect()
    assert {r["v_mean"] for r in got} == {1.0, 3.0, 5.0}
    assert all(len(r["key"]) <= X.KEY_LENGTH for r in got)
    asked = prepare_query_table(df, "k", "v", "o", task="regression").collect()
    assert {r["k"] for r in asked} == {r["key"] for r in got}


def test_small_columns_stay(spark):
    df = spark.createDataFrame([(f"k{i}", (i % 3) * 1e-10, (i % 2) * 1e-10) for i in range(12)], "k string, a double, b double")
    got = feat.combined_features(df, "k", ["a", "b"], [])
    assert {c[0] for c in got.columns} == {"k", "a", "b"}
