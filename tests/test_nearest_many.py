import math
import random

from lakeseek.baselines import set_search as S
from lakeseek.plans import queries as Q


def test_every_query_against_all(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(250)]
    rows += [(900 + i, rows[7][1]) for i in range(6)]  # ties
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    asked = [r for r in rows if r[0] % 10 == 7]
    want = {q: [i for _, i in sorted((-round(cos(v, w), 9), i) for i, w in rows)[:5]] for q, v in asked}
    df = spark.createDataFrame([*rows, (2000, [0.0] * 8), (2001, None)], "id int, v array<double>")
    got = {}
    for r in sorted(S.nearest_many(df, df.where("id % 10 = 7"), 5, "id", "v", block=32).collect(), key=lambda r: (-round(r["similarity"], 9), r["id"])):
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == want and len(got) == 25


def test_registered_for_the_query_table(spark, data):
    vectors = spark.read.parquet(f"{data}/embeddings.parquet")
    asked = {r["vec_id"] for r in vectors.where("vec_id % 100 = 0").collect()}
    got = Q.queries()["embedding_topk"](spark, data).groupBy("query_id").count().collect()
    assert {r["query_id"] for r in got} == asked and {r["count"] for r in got} == {min(10, vectors.count())}
