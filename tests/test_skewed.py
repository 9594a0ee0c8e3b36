"""Operators for skewed keys, numbering and incremental runs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakeseek.operators import incremental
from lakeseek.operators.incremental import FILE, Arrivals, Progress, merge_intervals, subtract_intervals, to_intervals
from lakeseek.operators.sequence import number_rows
from lakeseek.operators.skew import HotGroups
from lakeseek.operators.stitch import most_frequent_value
from lakeseek.sources.shared import children


def brute(rows, least):
    by = {}
    for k, v, *o in set(rows):
        if k and v is not None:
            by.setdefault(k, Counter())[v] += 1
    return {(k, min(c, key=lambda v: (-c[v], v)), max(c.values()), sum(c.values())) for k, c in by.items() if sum(c.values()) >= least}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    out = [("hot", rnd.randrange(30), 0, i) for i in range(4000)]  # over half of all rows
    out += [("warm", rnd.randrange(3), rnd.randrange(2), i) for i in range(1500)]
    out += [(f"k{i % 300}", rnd.randrange(3), 0, i) for i in range(1200)]
    out += [("tie", 2, 0, 1), ("tie", 1, 0, 2), ("Ω", 1, None, None), ("é" * 5000, 1, 0, 0), (None, 1, 0, 0), ("", 1, 0, 0), ("novalue", None, 0, 0)]
    return out + out[::3]


@pytest.mark.parametrize("partitions", ["1", "4", "23"])
@pytest.mark.parametrize("batch", ["10000", "7"])
def test_most_frequent_value(spark, rows, partitions, batch):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame([(*r, 1, 2) for r in rows], "k string, t int, c int, r int, key int, total int").repartition(9)
        for least in (1, 20):
            got = {(r["key"], r["value"], r["n"], r["total"]) for r in most_frequent_value(df, "k", "t", ["c", "r"], least).collect()}
            assert got == brute(rows, least)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_most_frequent_value_of_nothing(spark):
    df = spark.createDataFrame([], "k string, t int, r int")
    assert most_frequent_value(df, "k", "t", ["r"]).collect() == []
    assert most_frequent_value(spark.createDataFrame([(None, 1, 1), ("", 1, 1)], df.schema), "k", "t", ["r"]).collect() == []


@pytest.mark.parametrize("listed", [100, 0])
def test_hot_groups(spark, listed):
    df = spark.createDataFrame([("a", 1)] * 10 + [(None, 1)] * 10 + [("b", 1)] * 2, "k string, v int")
    hot = HotGroups(df, ["k"], 5, listed)
    assert hot.listed == (listed > 0)
    assert Counter(r["k"] for r in hot.hot(df).collect()) == {"a": 10, None: 10}
    assert Counter(r["k"] for r in hot.cold(df).collect()) == {"b": 2}
    assert {(r["k"], r["s"]) for r in hot.sized(df, "s").collect()} == {("a", 10), (None, 10), ("b", None)}
    assert HotGroups(df, ["k"], 50).empty


def test_numbers_are_consecutive(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), i) for i in range(500)]
    got = number_rows(spark.createDataFrame(rows, "s string, i int").repartition(6), ["s", "i"]).orderBy("seq").collect()
    assert [r["seq"] for r in got] == list(range(1, 501))
    assert [(r["s"], r["i"]) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert number_rows(spark.createDataFrame([], "s string"), ["s"]).count() == 0


def sets(rows):
    out = {}
    for s, a, b in rows:
        if a is not None and b is not None:
            out.setdefault(s, set()).update(range(a, b + 1))
    return {s: v for s, v in out.items() if v}


def disjoint(rows):
    for s in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == s)
        assert all(b[0] > a[1] + 1 for a, b in zip(mine, mine[1:], strict=False))


def test_interval_algebra(spark):
    rnd = random.Random(9)
    kind = "s string, first bigint, last bigint"
    for _ in range(6):
        a, b = ([(rnd.choice(["x", "y", None]), f := rnd.randrange(60), f + rnd.randrange(-1, 12)) for _ in range(rnd.randrange(14))] for _ in range(2))
        a.append(("x", None, 3))
        da, db = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)
        merged = [tuple(r) for r in merge_intervals(da, ["s"]).collect()]
        gaps = [tuple(r) for r in subtract_intervals(da, db, ["s"]).collect()]
        disjoint(merged)
        disjoint(gaps)
        sa, sb = sets(a), sets(b)
        assert sets(merged) == sa
        assert sets(gaps) == {s: v - sb.get(s, set()) for s, v in sa.items() if v - sb.get(s, set())}


def test_numbers_to_intervals(spark):
    seq = [*range(65_500, 65_600), 3, 4, 5, 4, None, 9]
    got = to_intervals(spark.createDataFrame([("a", x) for x in seq] + [(None, 7)], "s string, n bigint"), ["s"], "n")
    assert {tuple(r) for r in got.collect()} == {("a", 3, 5), ("a", 9, 9), ("a", 65_500, 65_599), (None, 7, 7)}


KIND = "t string, u int, n int"


def deliver(spark, log, rows, kind=KIND):
    """One more file in the log; returns its name."""
    before = set(log.glob("*.parquet")) if log.exists() else set()
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(log))
    return (set(log.glob("*.parquet")) - before).pop().name


def run(spark, a, p, log, name, die=False):
    """What a run takes; with ``die`` it ends before its results are published."""
    gaps = p.gaps(a.ranges())
    rows = a.records(str(log), gaps)
    got = sorted(tuple(r)[:3] for r in rows.collect())
    if die:
        rows.write.parquet(f"{p.root}/staged/{name}/data")
    else:
        assert p.commit(name, rows, gaps)
    return got


def test_late_records_are_neither_skipped_nor_done_ones_repeated(spark, tmp_path):
    log, a, p = tmp_path / "log", Arrivals(spark, str(tmp_path / "r"), ["t", "u", "n"], "u"), Progress(spark, str(tmp_path / "r"), FILE)
    deliver(spark, log, [("a", 5, 1), ("b", 1, 1), ("b", 2, 1), ("b", 2, 1), ("c", None, 1)])
    assert a.take_in(str(log)) == 1
    assert run(spark, a, p, log, "r1", die=True) == [("a", 5, 1), ("b", 1, 1), ("b", 2, 1)]
    assert run(spark, a, p, log, "r1") == [("a", 5, 1), ("b", 1, 1), ("b", 2, 1)]
    # a record older than what was taken arrives late, with a second delivery of one that was taken
    deliver(spark, log, [("a", 3, 1), ("b", 1, 1)])
    assert a.take_in(str(log)) == 1 and a.take_in(str(log)) == 0
    assert run(spark, a, p, log, "r2") == [("a", 3, 1)]
    assert run(spark, a, p, log, "r3") == []
    assert sorted(tuple(r)[:3] for r in p.output().collect()) == [("a", 3, 1), ("a", 5, 1), ("b", 1, 1), ("b", 2, 1)]
    assert {tuple(r)[:3] for r in a.ids().collect()} == {("a", 5, 1), ("b", 1, 1), ("b", 2, 1), ("a", 3, 1)}


def test_a_run_opens_new_files_only(spark, tmp_path):
    log, a, p = tmp_path / "log", Arrivals(spark, str(tmp_path / "r")), Progress(spark, str(tmp_path / "r"), FILE)
    deliver(spark, log, [("old", i, i) for i in range(500)])
    assert a.take_in(str(log)) == 1
    assert len(run(spark, a, p, log, "r1")) == 500
    new = deliver(spark, log, [("new", None, 1), ("new", None, 1)])
    a.take_in(str(log))
    gaps = p.gaps(a.ranges())
    rows = a.records(str(log), gaps)
    assert [f.rpartition("/")[2] for f in rows.inputFiles() if "/log/" in f] == [new]
    assert [tuple(r) for r in gaps.collect()] == [(new, 0, 1)]
    assert rows.count() == 2  # without ident every row is a record, repeated ones too


def test_lines_take_records_by_equality(spark, tmp_path):
    records = [("t1", 5, 10), ("t1", 7, 10), ("t1", 7, 11), ("t1", 6, 1), ("t2", 1, None), ("t2", 1, None), ("t3", None, 4), ("t4", 9, 1)]
    lines = [("t1", 7, 10), ("t1", 5, 10), ("t2", 1, None), ("t4", 9, 2), ("t9", 1, 1), ("t1", 7, 10)]
    log, a, p = tmp_path / "log", Arrivals(spark, str(tmp_path / "r"), ["t", "u", "n"], "u"), Progress(spark, str(tmp_path / "r"), FILE)
    deliver(spark, log, records)
    a.take_in(str(log))
    df = spark.createDataFrame(lines, KIND)
    assert p.commit("ledger", df, to_intervals(a.numbers(df), ["file"], "seq"))
    assert run(spark, a, p, log, "next") == [("t1", 6, 1), ("t1", 7, 11), ("t4", 9, 1)]


def test_logs_that_are_empty_or_changed(spark, tmp_path):
    log, a, p = tmp_path / "log", Arrivals(spark, str(tmp_path / "r"), ["t"]), Progress(spark, str(tmp_path / "r"), FILE)
    assert a.ranges().count() == 0
    name = deliver(spark, log, [])
    a.take_in(str(log))
    assert a.ranges().count() == 0 and a.records(str(log), a.ranges()).count() == 0 and a.ids().count() == 0
    import os

    os.utime(log / name, (1, 1))
    with pytest.raises(ValueError, match="changed"):
        a.take_in(str(log))


def test_of_two_intakes_at_once_one_wins(spark, tmp_path, monkeypatch):
    log, root = tmp_path / "log", str(tmp_path / "r")
    deliver(spark, log, [("a", 1, 1)])
    first, second = Arrivals(spark, root, ["t"]), Arrivals(spark, root, ["t"])
    first.take_in(str(log))
    # the second one looked before the first one published
    files, listed = iter([{}]), iter([[]])
    monkeypatch.setattr(second, "files", lambda: next(files, None) or Arrivals.files(second))
    monkeypatch.setattr(incremental, "children", lambda s, p: next(listed, None) or children(s, p))
    assert second.take_in(str(log)) == 0
    assert [tuple(r)[0] for r in second.ids().collect()] == ["a"]


def test_runs_neither_skip_nor_repeat(spark, tmp_path):
    p = Progress(spark, str(tmp_path / "p"), {"s": "string"})
    available = lambda n: spark.createDataFrame([("a", 1, n)], "s string, first bigint, last bigint")
    rows = lambda gaps: gaps.select("s", F.explode(F.sequence("first", "last")).alias("seq"))
    gaps = p.gaps(available(5))
    assert p.commit("r1", rows(gaps.where("first = 1")).where("seq <> 3"), spark.createDataFrame([("a", 1, 2), ("a", 4, 5)], "s string, first bigint, last bigint"))
    # a run that dies before its rename leaves only a staged folder
    rows(p.gaps(available(8))).write.parquet(str(tmp_path / "p/staged/dead/data"))
    gaps = p.gaps(available(8))
    assert {tuple(r) for r in gaps.collect()} == {("a", 3, 3), ("a", 6, 8)}
    assert p.commit("r2", rows(gaps), gaps)
    assert not p.commit("r2", rows(gaps), gaps)
    assert p.gaps(available(8)).count() == 0
    assert sorted(r["seq"] for r in p.output().collect()) == list(range(1, 9))
    assert [tuple(r) for r in p.taken().collect()] == [("a", 1, 8)]
