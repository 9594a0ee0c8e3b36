import os

import pytest
from pyspark.sql import functions as F

from lakeseek import cli
from lakeseek.operators import features as feat
from lakeseek.plans import config, planner, registry
from lakeseek.plans.errors import ConfigValidationError, TableLocked
from lakeseek.plans.index import LakeIndex
from lakeseek.sources import lake, shared


@pytest.fixture
def folder(spark, tmp_path):
    root = tmp_path / "lake"
    root.mkdir()
    (root / "b.csv").write_text("Key,val ue,kind\nK1,1.5,a\nK1,2.5,b\nk2,oops,a\nk3,4.0,a,extra\n")
    (root / "c.tsv").write_text("key\tx\nk1\t1\nk2\t2\n")
    spark.createDataFrame([(f"k{i % 5}", float(i)) for i in range(20)], "key string, value double").toPandas().to_parquet(root / "a.parquet")
    (root / "notes.txt").write_text("no table")
    return root


def test_listing_and_reading(spark, folder):
    tables = lake.list_tables(spark, str(folder))
    assert [(t.table_index, t.name) for t in tables] == [(0, "a.parquet"), (1, "b.csv"), (2, "c.tsv")]
    assert [t.name for t in lake.list_tables(spark, str(folder), after="a.parquet", n_tables=1)] == ["b.csv"]
    df = lake.with_clean_names(tables[1].read(spark))
    assert df.columns == ["key", "value", "kind"]
    assert df.count() == 4
    assert tables[2].read(spark).count() == 2
    typed = tables[1].read(spark, df.toDF("Key", "val ue", "kind").withColumn("val ue", F.lit(1.0)).schema)
    assert typed.where(F.col("`val ue`").isNull()).count() == 1


def test_archives(spark, folder, tmp_path):
    import gzip
    import tarfile
    import zipfile

    both = tmp_path / "both"
    both.mkdir()
    with zipfile.ZipFile(both / "one.zip", "w") as z:
        z.write(folder / "b.csv", "in/b.csv")
        z.write(folder / "a.parquet", "a.parquet")
        z.write(folder / "c.tsv", "c.tsv")
    (tmp_path / "c.tsv.gz").write_bytes(gzip.compress((folder / "c.tsv").read_bytes()))
    with tarfile.open(both / "two.tar.gz", "w:gz") as t:
        t.add(tmp_path / "c.tsv.gz", "d/c.tsv.gz")
        t.add(folder / "b.csv", "b.csv")
    got = list(lake.resolve_sources(spark, str(both)))
    assert [(t.table_index, t.name, t.read(spark).count()) for t in got] == [(0, "in/b.csv", 4), (1, "a.parquet", 20), (2, "d/c.tsv.gz", 2)]
    assert lake.catalog(spark, got).count() == 3


def test_guards(spark):
    df = spark.createDataFrame([(i, None if i % 2 else i) for i in range(100)], "a int, b int")
    kept = lake.cap_rows(df, 20)
    assert kept.columns == ["a", "b"]
    assert kept.count() == 20
    assert kept.where("b is null").count() == 0
    assert lake.too_wide(df, 1)
    got = lake.select_known(df, spark.createDataFrame([], "a bigint, c string").schema)
    assert got.dtypes == [("a", "bigint"), ("c", "string")]


def test_index_life(spark, folder, tmp_path):
    index = LakeIndex(spark, "l", config.EngineConfig(str(tmp_path / "ix")))
    assert not index.exists()
    assert index.build(str(folder), update_support=True) == [0, 1, 2]
    assert index.stats().tables == 3
    before = {(r["key"], r["feature"]): r["value"] for r in index.read("features").where("table_index = 0 and key_col = 'key'").collect()}
    more = spark.createDataFrame([("k1", 100.0, 1), ("k9", 5.0, 1)], "key string, value double, unknown int")
    assert index.update_table("a", more)
    assert not index.update_table("nowhere", more)
    assert not index.update_table("a", more.limit(0))
    full = spark.createDataFrame([(f"k{i % 5}", float(i)) for i in range(20)] + [("k1", 100.0), ("k9", 5.0)], "key string, value double")
    want = feat.numeric_features(full, "key", ["value"])
    got = {(r["key"], r["feature"]): r["value"] for r in index.read("features").where("table_index = 0 and key_col = 'key'").collect()}
    assert got == {(r["key"], c): r[c] for r in want.collect() for c in want.columns if c != "key"}
    assert got != before
    assert index.read("meta").where("table_index = 0").first()["n_rows"] == 22
    assert index.read("meta").count() == 3  # the other tables' partitions stay
    assert index.rebuild_table("a.parquet", full.limit(5))
    assert index.read("meta").where("table_index = 0").first()["n_rows"] == 5
    peer = index.find_union_peer(spark.createDataFrame([("k1", 1), ("k2", 2)], "key string, x int"))
    assert peer is not None
    assert index.find_union_peer(spark.createDataFrame([("zz", -9)], "key string, x int")) is None
    index.drop()
    assert not index.exists()


def updated(spark, tmp_path):
    index = LakeIndex(spark, "l", config.EngineConfig(str(tmp_path / "ix")))
    first = spark.createDataFrame([(f"k{i % 4}", i % 3) for i in range(20)], "key string, value int")
    index.add_table(first, 0, "t", update_support=True)
    return index, spark.createDataFrame([("k1", 7), ("k8", 5)], "key string, value int")


def rows_of(index):
    return {(r["key_col_index"], r["key"], r["feature"], r["value"]) for r in index.read("features").collect()}, index.read("meta").first()["n_rows"]


def test_an_update_counts_once(spark, tmp_path):
    index, more = updated(spark, tmp_path)
    assert index.update_table("t", more, "d1") and rows_of(index)[1] == 22
    once = rows_of(index)
    assert index.update_table("t", more, "d1") and rows_of(index) == once
    assert index.update_table("t", more, "d2") and rows_of(index)[1] == 24


def test_an_update_that_died_after_publishing_is_finished(spark, tmp_path, monkeypatch):
    index, more = updated(spark, tmp_path)
    real, calls = LakeIndex._write, []

    def dies(self, kind, df):
        if len(calls) == 1:
            raise RuntimeError("lost")
        calls.append(kind)
        real(self, kind, df)

    monkeypatch.setattr(LakeIndex, "_write", dies)
    with pytest.raises(RuntimeError, match="lost"):
        index.update_table("t", more, "d1")
    monkeypatch.setattr(LakeIndex, "_write", real)
    assert index.update_table("t", more, "d1")  # repeated: what was published is carried over, nothing is added again
    died = rows_of(index)
    other, more = updated(spark, tmp_path / "other")
    other.update_table("t", more, "d1")
    assert died == rows_of(other)


def test_a_table_is_locked_while_it_is_updated(spark, tmp_path, monkeypatch):
    index, more = updated(spark, tmp_path)
    with index._locked(0):
        with pytest.raises(TableLocked):
            index.update_table("t", more)
        with index._locked(1):  # other tables aren't
            pass
        monkeypatch.setattr("lakeseek.plans.index.LOCK_SECONDS", -1)  # the lock counts as left behind
        assert index.update_table("t", more)


def test_a_cluster_needs_a_shared_folder():
    assert [shared.is_local(m) for m in ("local", "local[4]", "local-cluster[2,1,1024]", "spark://h:7077", "yarn")] == [True, True, False, False, False]


def test_publishing_is_exclusive(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x").write_text(name)
    assert shared.publish(spark, str(tmp_path / "a"), str(tmp_path / "to/1"))
    assert not shared.publish(spark, str(tmp_path / "b"), str(tmp_path / "to/1"))
    assert (tmp_path / "to/1/x").read_text() == "a" and not (tmp_path / "b").exists()
    with pytest.raises(Exception, match="nowhere"):
        shared.publish(spark, str(tmp_path / "nowhere"), str(tmp_path / "to/2"))


def test_broken_tables_are_reported(spark, folder, tmp_path):
    (folder / "broken.parquet").write_bytes(b"PAR1 this is no table PAR1")
    index = LakeIndex(spark, "l", config.EngineConfig(str(tmp_path / "ix")))
    assert index.build(str(folder)) == [0, 1, 3]
    assert [(i, n) for i, n, _ in index.failed_tables] == [(2, "broken.parquet")]


@pytest.mark.parametrize("bad", [
    {"task": "nope"}, {"task": "regression", "ranking": "eta"}, {"task": "regression", "ranking": "joinability", "strategy": "ForwardSelection"},
    {"task": "regression", "ranking": "passthrough", "strategy": "ForwardSelection", "model": "ClassificationCholesky", "params": {}},
    {"task": "regression", "ranking": "passthrough", "strategy": "ForwardSelection", "model": "RegressionQR", "params": {"metric": "mse"}},
    {"task": "regression", "ranking": "passthrough", "strategy": "ForwardSelection", "model": "RegressionQR", "params": {"metric": "mse", "tol": 1}},
    {"task": "regression", "baseline": True},
])
def test_invalid_configurations(bad):
    with pytest.raises(ConfigValidationError):
        config.DiscoveryConfig(**bad)


def test_valid_configurations():
    config.DiscoveryConfig("regression", "passthrough", "ForwardSelection", "RegressionQR", {"metric": "mse", "tol": 0.1})
    config.DiscoveryConfig("classification explanation", "eta")
    config.DiscoveryConfig(baseline=True, params={"k": 1})
    assert config.valid_options("regression") == ["correlation", "joinability", "passthrough"]
    for task, rankings in config.SEARCHES.items():
        for ranking, strategies in rankings.items():
            assert config.valid_options(task, ranking) == strategies
            for s in filter(None, strategies):
                for m in config.valid_options(task, ranking, s):
                    assert m == "WeightedSum" or m in registry.models.names()


def test_settings(monkeypatch, tmp_path):
    file = tmp_path / "c.json"
    file.write_text('{"root": "from-file"}')
    monkeypatch.delenv("LAKESEEK_ROOT", raising=False)
    assert config.EngineConfig.resolve(file=str(file)).root == "from-file"
    monkeypatch.setenv("LAKESEEK_ROOT", "from-env")
    assert config.EngineConfig.resolve(file=str(file)).root == "from-env"
    assert config.EngineConfig.resolve("arg", str(file)).root == "arg"


def test_registries():
    for r in (registry.models, registry.strategies, registry.augmenters):
        assert r.names() == sorted(r.names())
        for n in r.names():
            assert callable(r.resolve(n))
    r = registry.Registry("thing", {"gone": "no_such_module:x", "own": len})
    assert r.resolve("own") is len
    with pytest.raises(KeyError, match="known: gone, own"):
        r.resolve("other")
    with pytest.raises(ImportError, match="no_such_module"):
        r.resolve("gone")


def test_plan_steps():
    S = planner.PlanStep
    steps = [S("a", lambda: 2), S("b", lambda x, k: x * k, ("a",), {"k": 5})]
    assert planner.execute(steps) == {"a": 2, "b": 10}
    assert "a --> b" in planner.as_mermaid(steps)
    assert '"a" -> "b"' in planner.as_dot(steps)
    assert planner.as_text(steps).splitlines()[1] == "[+] 2. b <- a"
    with pytest.raises(RuntimeError, match="needs z"):
        planner.execute([S("y", lambda x: x, ("z",))])


def test_command_line(spark, folder, tmp_path, capsys):
    root = str(tmp_path / "ix")
    assert cli.main(["info"]) == 0
    assert cli.main(["--root", root, "index", "build", "l", str(folder)], spark) == 0
    assert cli.main(["--root", root, "index", "stats", "l"], spark) == 0
    assert "tables 3" in capsys.readouterr().out
    (tmp_path / "q.csv").write_text("key,x,y\n" + "".join(f"k{i % 5},{i % 3},{(i % 5) * 2.0 + i % 2}\n" for i in range(40)))
    out = str(tmp_path / "out")
    assert cli.main(["--root", root, "augment", "l", str(tmp_path / "q.csv"), "--key", "key", "--target", "y", "--task", "regression", "--no-pruning", "-o", out], spark) == 0
    assert any(f.endswith(".csv") for f in os.listdir(out))
    assert cli.main(["--root", root, "index", "drop", "l", "--yes"], spark) == 0
    assert cli.main(["--root", root, "index", "stats", "l"], spark) == 1
