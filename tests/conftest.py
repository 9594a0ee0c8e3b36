import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    return d


@pytest.fixture(scope="session")
def sql(data):
    import duckdb

    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in os.listdir(data):
        c.sql(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return c


@pytest.fixture(scope="session")
def same(spark, data, sql):
    """Whether a query gives the rows of its SQL."""

    def check(f, text):
        df = f(spark, data)
        cols = sorted(df.columns)
        got = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
        rel = sql.sql(text)
        assert sorted(rel.columns) == cols
        assert got == sorted((tuple(r) for r in rel.select(",".join(f'"{c}"' for c in cols)).fetchall()), key=repr)

    return check
