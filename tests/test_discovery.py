import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeseek.operators import gram, hops, retrieval, union
from lakeseek.plans import api, proxy, select

LONG = "table_index int, table_name string, key_col_index int, key_col string, key string, feature string, base_col string, value double"


@pytest.fixture(scope="module")
def world(spark):
    """300 rows over 60 keys; t0.a drives the target, t0.b opposes it, t1 is noise, t2 has no common key."""
    rnd = np.random.default_rng(0)
    a, noise = rnd.normal(size=60), rnd.normal(size=60)
    rows = [(f"k{k}", float(rnd.normal()), float(3 * a[k] + 0.3 * rnd.normal())) for k in rnd.integers(0, 60, 300)]
    feats = []
    for k in range(60):
        feats += [(0, "t0.csv", 0, "id", f"k{k}", f, f[0], float(v)) for f, v in (("a_mean", a[k]), ("a_max", a[k] + 0.01), ("b_mean", -a[k] + 0.5 * noise[k]))]
        feats += [(1, "dir/t1.csv", 0, "id", f"k{k}", f"n{i}_mean", f"n{i}", float(rnd.normal())) for i in range(3)]
        feats.append((2, "t2.csv", 0, "id", f"z{k}", "a_mean", "a", 1.0))
    return spark.createDataFrame(rows, "key string, x double, y double"), spark.createDataFrame(feats, LONG).cache()


def wide_of(features):
    return features.where("table_index < 2").groupBy("key").pivot("feature").agg(F.first("value"))


def test_overlap(spark, world):
    q, f = world
    keys = retrieval.lake_keys(f)
    assert [(r["table_index"], r["ratio"]) for r in retrieval.overlap_topk(keys, q, 5).collect()] == [(0, 1.0), (1, 1.0)]
    assert [r["table_index"] for r in retrieval.overlap_topk(keys, q, 5, exclude=[0]).collect()] == [1]
    assert retrieval.overlap_topk(keys, q.limit(0), 5).count() == 0


def test_sides_and_quirks(world):
    q, f = world
    score = {r["feature"]: r["score"] for r in retrieval.side_scores(f, q, "key", "y").collect()}
    ref = {r["feature"]: r["score"] for r in retrieval.side_scores(f, q, "key", "y", "reference").collect()}
    assert score["a_mean"] > 0.85
    assert score["b_mean"] > 0.7 > 0.4 > ref["b_mean"]  # an opposed feature passes only with the absolute share
    kept = {r["feature"] for r in retrieval.prune(f, retrieval.side_scores(f, q, "key", "y"), 0.7).select("feature").distinct().collect()}
    assert {"a_mean", "a_max", "b_mean"} <= kept


def test_eta_of_constants_is_zero(spark):
    q = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1), ("c", 1)], "key string, c int")
    f = spark.createDataFrame([(0, 0, k, n, v) for k, v in (("a", 1.0), ("b", 3.0), ("c", 3.0)) for n, v in (("f", v), ("const", 0.1))], "table_index int, key_col_index int, key string, feature string, value double")
    assert {r["feature"]: r["score"] for r in retrieval.eta_squared(f, q, "key", "c").collect()} == {"f": pytest.approx(1.0), "const": 0.0}


def test_reference_masks(spark):
    scores = spark.createDataFrame([(0, 0, "a", 0.9), (0, 0, "b", 0.1), (1, 0, "a", 0.9), (2, 0, "a", 0.0)], "table_index int, key_col_index int, feature string, score double")
    f = scores.select("table_index", "key_col_index", "feature", F.lit("k").alias("key"), F.lit(1.0).alias("value"))
    assert {(r["table_index"], r["feature"]) for r in retrieval.prune_reference(f, scores, 0.5).collect()} == {(0, "a")}
    pure = scores.where("table_index > 0")
    assert retrieval.prune_reference(f, pure, 0.5).count() == 4


def test_stop_list(world):
    f = world[1]
    left = lambda stop: {(r["table_index"], r["feature"]) for r in retrieval.stop_features(f, stop).select("table_index", "feature").distinct().collect()}
    everything = left({})
    assert everything - left({"t0": ["a"]}) == {(0, "a_mean"), (0, "a_max")}
    assert everything - left({"t1.csv": "n1"}) == {(1, "n1_mean")}
    assert left({"t2": ["a"], "nowhere": ["b"]}) == everything - {(2, "a_mean")}
    with pytest.raises(ValueError, match="names"):
        retrieval.stop_features(f.drop("base_col"), {"t0": ["a"]})


def test_table_names(spark):
    cat = spark.createDataFrame([(0, "a/x.csv"), (1, "b/x.csv"), (2, "y.tsv.gz"), (3, "v1.2 data.parquet"), (4, "plain")], "table_index int, table_name string")
    assert retrieval.resolve_tables(cat, ["x"]) == [0, 1]
    assert retrieval.resolve_tables(cat, ["a/x.csv"]) == [0]
    assert retrieval.resolve_tables(cat, ["Y", "v1.2 data", "plain"]) == [2, 3, 4]
    with pytest.warns(RuntimeWarning, match="nothing"):
        assert retrieval.resolve_tables(cat, ["nothing"]) == []
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert retrieval.resolve_tables(cat, []) == []


def test_gram_equals_joined_rows(world):
    q, f = world
    wide = wide_of(f)
    names = [c for c in wide.columns if c != "key"]
    g = gram.joined_gram(q, "key", ["x"], "y", wide, names)
    m = np.array(q.join(wide, "key").select("x", *names, "y").collect())
    assert g.n == len(m)
    assert np.allclose(g.sums, m.sum(0))
    assert np.allclose(g.matrix, m.T @ m)
    s, std = g.standardized()
    assert np.allclose(np.diag(s), len(m))
    assert np.allclose(std, m.std(0))


def test_gram_per_class(spark, world):
    q, f = world
    wide = wide_of(f)
    q = q.withColumn("c", (F.col("y") > 0).cast("int"))
    g = gram.joined_gram(q.drop("y"), "key", ["x"], None, wide, ["a_mean"], "c")
    m = q.join(wide, "key").select("x", "a_mean", "c").toPandas()
    for c, block in g.classes.items():
        part = m[m.c == int(c)][["x", "a_mean"]].to_numpy()
        assert np.allclose(block.matrix, part.T @ part)


@pytest.mark.parametrize("metric", proxy.REGRESSION_METRICS)
def test_scores_of_blocks_equal_scores_of_sets(metric):
    rnd = np.random.default_rng(1)
    m = rnd.normal(size=(200, 7))
    m[:, 6] = m[:, 0] + m[:, 2] * 2 + rnd.normal(size=200)
    m[:, 5] = m[:, 0] * 2  # dependent
    g = gram.Gram(list("abcdefy"), 200, m.sum(0), m.T @ m, 1)
    s = proxy.RegressionScorer(g, metric)
    got = s.score([0], [[1], [2], [3], [1, 2]])
    assert np.allclose(got, [s.of([0, 1]), s.of([0, 2]), s.of([0, 3]), s.of([0, 1, 2])])
    if metric != "conditional_gcv":
        assert s.score([0], [[5]])[0] == -np.inf
    x = m[:, [0, 2]] - m[:, [0, 2]].mean(0)
    y = m[:, 6] - m[:, 6].mean()
    rss = np.sum((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2)
    if metric == "mse":
        assert s.of([0, 2]) == pytest.approx(-rss / 200, rel=1e-6)


@pytest.mark.parametrize("metric", proxy.CLASSIFICATION_METRICS)
def test_class_scores_ignore_units(metric):
    rnd = np.random.default_rng(0)
    y = rnd.integers(0, 3, 4000)
    far, mark, const = rnd.normal(size=4000) + 0.1 * y, (y == 1) * 1.0 + 0.2 * rnd.normal(size=4000), np.full(4000, 7.0)

    def scores(scale):
        m = np.column_stack([far * scale, mark, const])
        block = lambda x: gram.Gram(["d", "i", "c"], len(x), x.sum(0), x.T @ x, 0)
        total = block(m)
        total.classes = {k: block(m[y == k]) for k in range(3)}
        s = proxy.ClassScorer(total, metric)
        return [s.of([0]), s.of([1]), s.of([2]) if metric.startswith("cond") else 0.0]

    a, b = scores(1.0), scores(1e6)
    assert a == pytest.approx(b, rel=1e-6)
    assert a[1] > a[0]
    assert a[2] == 0


def test_solvers_and_lasso():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(100, 4))
    y = x @ [1.0, 0, -2, 0] + 0.01 * rnd.normal(size=100)
    g, c = x.T @ x, x.T @ y
    want = np.linalg.lstsq(x, y, rcond=None)[0]
    for method in ("qr", "cholesky"):
        assert np.allclose(proxy.least_squares(g, c, method), want)
    assert np.allclose(proxy.lasso(g / 100, c / 100, 0.0), want, atol=1e-6)
    assert np.flatnonzero(np.abs(proxy.lasso(g / 100, c / 100, 0.2)) > 1e-9).tolist() == [0, 2]
    z = np.column_stack([x, x[:, 0] + x[:, 1]])
    assert proxy.collinear(z.T @ z) == [4]
    with pytest.raises(np.linalg.LinAlgError):
        proxy.least_squares(np.ones((2, 2)), np.ones(2), "qr")


def test_augmenter(world, tmp_path):
    q, f = world
    path = tmp_path / "trajectory.csv"
    r = api.Augmenter(f, "regression", top_k=5, trajectory=str(path)).augment(q, "key", "y", debug=True)
    assert r.plan[0]["base_col"] == "a"
    assert len({(p["table_index"], p["base_col"]) for p in r.plan}) == len(r.plan)  # no two aggregates of one column
    table, plan = r
    assert table.count() == q.count()
    assert set(q.columns) < set(table.columns)
    assert len(path.read_text().splitlines()) == 1 + r.n_selected
    assert [s.status for s in r.steps] == ["done"] * 4


def test_augmenter_of_classes(world):
    q, f = world
    q = q.withColumn("y", F.when(F.col("y") > 0, 1.0).otherwise(0.0))
    r = api.Augmenter(f, "classification", top_k=5, params={"polynomial_features": {"enabled": True, "degree": 2}}).augment(q, "key", "y", debug=True)
    assert r.plan[0]["base_col"] in ("a", "b")


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_explanation(world, task):
    q, f = world
    if task == "classification":
        q = q.withColumn("y", F.when(F.col("y") > 0, 1.0).otherwise(0.0))
    got = [tuple(r) for r in api.Augmenter(f, task, threshold=None).explain(q, "key", "y").collect()]
    assert len(got) == 6
    assert got[0][1] in ("a_mean", "a_max")
    assert [r[2] for r in got] == sorted((r[2] for r in got), reverse=True)
    assert {r[1]: r[3] for r in got}[got[1][1]]  # the other aggregate of a says the same
    assert not got[0][3]


def test_powers_and_bins_are_joined(world, tmp_path):
    q, f = world
    r = api.Augmenter(f, "regression", threshold=None, history=str(tmp_path / "h.csv"), params={"polynomial_features": {"enabled": True, "degree": 2}}).augment(q, "key", "y", debug=True)
    assert {f"t0.csv.{r.plan[0]['feature']}", f"t0.csv.{r.plan[0]['feature']}^2"} <= set(r.table.columns)
    assert (tmp_path / "h.csv").read_text().startswith("iteration,candidate,score,rank,chosen")
    assert (tmp_path / "h.csv.json").exists()
    stepped = q.withColumn("y", F.floor("y").cast("double"))
    r = api.Augmenter(f, "regression", threshold=None, params={"dummify_features": {"enabled": True, "n_bins": 4}}).augment(stepped, "key", "y", debug=True)
    for p in r.plan:
        name = f"{p['table_name']}.{p['feature']}"
        assert (name in r.table.columns) == (p["edges"] is None)
        assert (f"{name}=bin_1" in r.table.columns) == (p["edges"] is not None)


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_l1_selection(world, task):
    q, f = world
    if task == "classification":
        q = q.withColumn("y", F.when(F.col("y") > 0, 1.0).otherwise(0.0))
    r = api.Augmenter(f, task, strategy="LassoFeatureSelector", threshold=None, params={"alphas": [0.05], "cv": 2}).augment(q, "key", "y", debug=True)
    assert {p["base_col"] for p in r.plan} & {"a", "b"}
    assert r.table.count() == q.count()


@pytest.mark.parametrize("strategy", ["BackwardElimination", "IncrementalSelection"])
def test_other_strategies(world, strategy):
    q, f = world
    r = api.Augmenter(f, "regression", strategy=strategy, metric="r2", threshold=None).augment(q, "key", "y", debug=True)
    assert "a" in {p["base_col"] for p in r.plan}


def test_lasso_strategy_and_budget():
    rnd = np.random.default_rng(3)
    m = rnd.normal(size=(300, 6))
    m[:, 5] = 2 * m[:, 1] - m[:, 3] + 0.1 * rnd.normal(size=300)
    g = gram.Gram(list("abcdey"), 300, m.sum(0), m.T @ m, 0)
    cands = [select.Candidate(n, (i,), (0, 0, n)) for i, n in enumerate("abcde")]
    assert set(select.lasso_selection(g, cands, [0.01, 0.3, 10.0]).names()) >= {"b", "d"}
    ticks = iter(range(100))
    s = select.forward(g, cands, "r2", 1e-6, select.Budget(0.5, lambda: next(ticks)))
    assert s.names() == ["b"]
    assert s.expired
    assert select.forward(g, cands, "r2", 0.01).names()[:2] == ["b", "d"]
    assert [c.name for c in select.rank_by_correlation(g, cands)][:2] == ["b", "d"]
    assert select.knee([10, 9, 8, 1, 0.5, 0.4]) == 4


def test_failures_leave_the_table(world, caplog):
    q, f = world
    lost = q.withColumn("key", F.concat(F.lit("no"), "key"))
    r = api.Augmenter(f, "regression").augment(lost, "key", "y")
    assert (r.table, r.plan) == (lost, [])
    with pytest.raises(api.KeyNotFoundError):
        api.Augmenter(f, "regression").augment(lost, "key", "y", debug=True)
    with pytest.raises(api.UserTableNotProcessed):
        api.Augmenter(f, "regression").augment(q.withColumn("s", F.lit("text")), "key", "y", debug=True)


def test_hops(spark):
    kind = "table_index int, key_col_index int, key string"
    bridges = spark.createDataFrame([(0, 0, f"c{i}", 1, f"n{i % 3}") for i in range(6)] + [(1, 0, f"n{i}", 1, "r") for i in range(3)], f"{kind}, to_key_col int, to_key string")
    keys = bridges.select("table_index", "key_col_index", "key").union(bridges.select("table_index", F.col("to_key_col"), F.col("to_key"))).union(spark.createDataFrame([(2, 0, "r"), (3, 0, "n0")], kind)).distinct()
    q = spark.createDataFrame([(f"c{i}",) for i in range(6)], "key string")
    got = hops.join_graph(bridges, keys, q, threshold=0.5, max_hops=3)
    tree = {(r["table_index"], r["key_col_index"], r["hop"], r["roots"]) for r in hops.edges(got).collect()}
    assert tree == {(0, 0, 1, 6), (1, 0, 2, 6), (2, 0, 3, 6)}  # table 3 is reached by a third of the roots only
    f = spark.createDataFrame([(2, "t2", 0, "r", "x_mean", "x", 4.0)], "table_index int, table_name string, key_col_index int, key string, feature string, base_col string, value double")
    assert {(r["key"], r["value"]) for r in hops.root_features(f, got).collect()} == {(f"c{i}", 4.0) for i in range(6)}


def test_chain_join_adds_no_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "i int, k string")
    b = spark.createDataFrame([("x", "p"), ("x", "p"), ("y", "q")], "k string, l string")
    c = spark.createDataFrame([("p", 7)], "l string, v int")
    got = hops.chain_join([(b, "k", "k"), (c, "t1.l", "l")], a).select("i", F.col("`t2.v`").alias("v"))
    assert {tuple(r) for r in got.collect()} == {(1, 7), (2, None), (3, None)}


def test_matching_is_the_best_assignment():
    import itertools

    rnd = random.Random(8)
    for _ in range(60):
        n, m = rnd.randrange(1, 5), rnd.randrange(1, 5)
        w = {(f"q{i}", f"p{j}"): rnd.randrange(1, 20) for i in range(n) for j in range(m) if rnd.random() < 0.7}
        best = 0
        for perm in itertools.permutations([f"p{j}" for j in range(m)] + [None] * n, n):
            best = max(best, sum(w.get((f"q{i}", p), 0) for i, p in enumerate(perm)))
        got = union.best_matching(w)
        assert sum(w[p] for p in got.items()) == best
        assert len(set(got.values())) == len(got)


def test_union_peer():
    hits = [("a", 1, "x", 90), ("b", 1, "y", 80), ("a", 2, "x", 95), ("b", 1, "x", 10)]
    tables = {1: ("one.csv", 2, 100), 2: ("two.csv", 5, 100)}
    peer = union.find_union_peer(hits, tables, 2, 100)
    assert (peer.table_name, peer.mapping, peer.coverage, peer.score) == ("one.csv", {"a": "x", "b": "y"}, 1.0, 170 / 200)
    assert union.find_union_peer(hits, tables, 2, 100, threshold=0.9) is None
    assert union.find_union_peer([], {}, 2, 100) is None


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_blocks_select_as_one_matrix_does(world, monkeypatch, task):
    q, f = world
    if task == "classification":
        q = q.withColumn("y", F.when(F.col("y") > 0, 1.0).otherwise(0.0))
    a = api.Augmenter(f, task, top_k=5, threshold=None, tol=0.001, params={"polynomial_features": {"enabled": True, "degree": 2}, "dummify_features": {"enabled": True, "n_bins": 3}})
    whole = a.augment(q, "key", "y", debug=True).plan
    monkeypatch.setattr(api, "MAX_COLUMNS", 9)  # two candidates a block
    blocks = a.augment(q, "key", "y", debug=True).plan
    assert len(whole) > 1
    assert [(p["feature"], p["edges"], round(p["score"], 9)) for p in blocks] == [(p["feature"], p["edges"], round(p["score"], 9)) for p in whole]


@pytest.mark.parametrize("metric", proxy.REGRESSION_METRICS)
def test_models_agree(metric):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(200, 6))
    x[:, 5] = x[:, 0] + x[:, 1]  # depends on others
    rows = np.column_stack([x, x[:, 1] - 2 * x[:, 3] + 0.1 * rnd.normal(size=200)])
    g = gram.Gram([f"c{i}" for i in range(7)], 200, rows.sum(0), rows.T @ rows, 1)
    candidates = [select.Candidate(f"c{i}", (i,), (i,)) for i in range(1, 6)]
    plans = {m: select.forward(g, candidates, metric, 0.001, model=m) for m in ("RegressionCholesky", "RegressionQR", "IncrementalRegressionFGS")}
    first = plans.pop("RegressionCholesky")
    assert first.names()[:2] == ["c3", "c1"]
    for p in plans.values():
        assert p.names() == first.names() and np.allclose(p.scores, first.scores, rtol=1e-6)


def test_collinear_columns_in_one_pass():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(50, 5))
    x = np.column_stack([x, x[:, 0] - x[:, 3], x[:, 1] * 2, rnd.normal(size=50)])
    assert proxy.collinear(x.T @ x) == [5, 6] and proxy.collinear(np.zeros((0, 0))) == []


def test_several_hops_through_the_facade(spark):
    rnd = random.Random(2)
    regions = {f"r{i}": float(i) for i in range(5)}
    city = {f"c{i}": f"r{i % 5}" for i in range(40)}
    q = spark.createDataFrame([(c, rnd.random(), regions[r] + 0.01 * rnd.random()) for c, r in city.items() for _ in range(3)], "key string, x double, y double")
    bridges = [(0, 0, c, 1, r) for c, r in city.items()] + [(0, 1, r, 0, c) for c, r in city.items()]
    bridges = spark.createDataFrame(bridges, "table_index int, key_col_index int, key string, to_key_col int, to_key string")
    feats = [(0, "city.csv", 0, "id", c, "noise_mean", "noise", rnd.random()) for c in city] + [(1, "region.csv", 0, "id", r, "level_mean", "level", v) for r, v in regions.items()]
    f = spark.createDataFrame(feats, LONG)
    got = api.Augmenter(f, "regression", threshold=None, max_hops=2, bridges=bridges).augment(q, "key", "y", debug=True)
    assert got.plan[0]["feature"] == "level_mean"
    rows = got.table.select("key", "`region.csv.level_mean`").distinct().collect()
    assert {r[0]: r[1] for r in rows} == {c: regions[r] for c, r in city.items()} and got.table.count() == 120
    one = api.Augmenter(f, "regression", threshold=None).augment(q, "key", "y", debug=True)
    assert "level_mean" not in [p["feature"] for p in one.plan]
    with pytest.raises(ValueError, match="bridges"):
        api.Augmenter(f, "regression", max_hops=2)
