"""Queries of discovery: overlap, pruning, Gram matrices, scores, selection, joins, hops, union search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.operators import features as feat
from lakeseek.operators import gram, hops, materialize, retrieval, union
from lakeseek.plans import api, proxy
from lakeseek.plans.catalogue import Catalogue, read
from lakeseek.plans.queries_features import numeric_sql, rounded
from lakeseek.sources import shared

query = Catalogue()

# The lake of the queries: number, table, key column, numeric columns.
LAKE = [(0, "orders", "o_custkey", ["o_totalprice"]), (1, "supplier", "s_suppkey", ["s_acctbal", "s_nationkey"]), (2, "nation", "n_nationkey", ["n_regionkey"]), (3, "customer", "c_nationkey", ["c_acctbal"]), (4, "supplier", "s_nationkey", ["s_acctbal"])]


def lake(spark: SparkSession, d: str) -> DataFrame:
    """Features of the stand-in lake in long form, written once, as those of an index are."""
    out = None
    for i, table, key, columns in LAKE:
        long = feat.to_long(feat.numeric_features(read(spark, d, table), key, columns), i, f"{table}.parquet", 0, key)
        out = long if out is None else out.unionByName(long)
    return shared.materialize(out, "lake")


def _long_sql() -> str:
    parts = []
    for i, table, key, columns in LAKE:
        names = [f"{c}_{a}" for c in columns for a in feat.AGGREGATES]
        exact = numeric_sql(table, key, columns).replace("round(", "(").replace(", 6)", ")")
        cells = f"unnest([{', '.join(repr(n) for n in names)}]) as feature, unnest([{', '.join(n + '::double' for n in names)}]) as value"
        parts.append(f"select {i} as table_index, '{table}.parquet' as table_name, 0 as key_col_index, key, {cells} from ({exact})")
    return " union all ".join(parts)


_LAKE = f"lake as ({_long_sql()}), keys as (select distinct table_index, key_col_index, key from lake)"
_CUST = "q as (select c_custkey::varchar as key, c_nationkey::double as x, c_acctbal as y from customer where c_custkey is not null)"


def customers(spark: SparkSession, d: str) -> DataFrame:
    """The regression query table: key, one feature, target."""
    return read(spark, d, "customer").where(F.col("c_custkey").isNotNull()).select(F.col("c_custkey").cast("string").alias("key"), F.col("c_nationkey").cast("double").alias("x"), F.col("c_acctbal").alias("y"))


_TOP = "select table_index, key_col_index, count(*) as n, round(count(*) / (select count(distinct key) from q), 6) as ratio from keys where key in (select key from q){} group by 1, 2 order by n desc, 1, 2 limit 3"


@query(f"with {_LAKE}, {_CUST} {_TOP.format('')}")
def overlap_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(retrieval.overlap_topk(retrieval.lake_keys(lake(spark, d)), customers(spark, d), 3))


@query(f"with {_LAKE}, {_CUST} {_TOP.format(' and table_index not in (0)')}")
def overlap_topk_excluded(spark: SparkSession, d: str) -> DataFrame:
    features = lake(spark, d)
    out = retrieval.resolve_tables(features.select("table_index", "table_name").distinct(), ["orders"])
    return rounded(retrieval.overlap_topk(retrieval.lake_keys(features), customers(spark, d), 3, exclude=out))


@query("""
    with k as (select distinct table_index, key_col_index, key from overlap_table where key <> ''),
    q as (select distinct table_index as query_id, key from k where table_index % 100 = 0), t as (select query_id, count(*) as t from q group by 1),
    h as (select query_id, table_index, key_col_index, count(*) as n from k join q using (key) group by 1, 2, 3)
    select query_id, table_index, key_col_index, n, round(n / t, 6) as ratio from h join t using (query_id) qualify row_number() over (partition by query_id order by n desc, table_index, key_col_index) <= 20""")
def overlap_topk_lake(spark: SparkSession, d: str) -> DataFrame:
    """For every table whose index is divisible by 100 the key columns of the inverted index that share most keys with it."""
    keys = read(spark, d, "overlap_table").where(F.col("key") != "").select("table_index", "key_col_index", "key").distinct()
    return rounded(retrieval.overlap_topk_many(keys, keys.where(F.col("table_index") % 100 == 0).select(F.col("table_index").alias("query_id"), "key"), 20))


@query(f"with {_LAKE}, {_CUST}, hits as ({_TOP.format('')}) select table_index, key_col_index, key, feature, round(value, 6) as value from lake join hits using (table_index, key_col_index) where key in (select key from q)")
def sketch_fetch(spark: SparkSession, d: str) -> DataFrame:
    features, q = lake(spark, d), customers(spark, d)
    hits = retrieval.overlap_topk(retrieval.lake_keys(features), q, 3)
    return rounded(retrieval.fetch(features, hits, q).select("table_index", "key_col_index", "key", "feature", "value"))


_SIDES = f"""{_LAKE}, {_CUST}, per as (select key, avg(y) as y from q group by 1),
    xm as (select table_index, feature, avg(value) as xm from lake group by 1, 2),
    m as (select l.table_index, l.key_col_index, l.feature, l.key, l.value, p.y from lake l join per p using (key)),
    ym as (select table_index, feature, avg(y) as ym from m group by 1, 2),
    s as (select m.*, sign(y - ym) as q, sign(value - xm) as x from m join xm using (table_index, feature) join ym using (table_index, feature))"""


@query(f"""with {_SIDES} select table_index, key_col_index, feature, count(*) as matched,
    round(coalesce(greatest(avg((q = x)::int) filter (q <> 0 and x <> 0), 1 - avg((q = x)::int) filter (q <> 0 and x <> 0)), 0), 6) as score from s group by 1, 2, 3""")
def qcr_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(retrieval.side_scores(lake(spark, d), customers(spark, d), "key", "y"))


@query(f"with {_SIDES} select table_index, key_col_index, feature, count(*) as matched, round(avg((q = x)::int), 6) as score from s group by 1, 2, 3")
def qcr_scores_reference(spark: SparkSession, d: str) -> DataFrame:
    return rounded(retrieval.side_scores(lake(spark, d), customers(spark, d), "key", "y", "reference"))


@query(f"""with {_SIDES}, sc as (select table_index, key_col_index, feature,
    coalesce(greatest(avg((q = x)::int) filter (q <> 0 and x <> 0), 1 - avg((q = x)::int) filter (q <> 0 and x <> 0)), 0) as score from s group by 1, 2, 3)
    select l.table_index, l.feature, count(*) as n from lake l join sc using (table_index, key_col_index, feature) where score > 0.52 group by 1, 2""")
def qcr_prune(spark: SparkSession, d: str) -> DataFrame:
    features = lake(spark, d)
    kept = retrieval.prune(features, retrieval.side_scores(features, customers(spark, d), "key", "y"), 0.52)
    return kept.groupBy("table_index", "feature").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    with {_LAKE}, q as (select c_nationkey::varchar as key, c_mktsegment as c from customer where c_nationkey is not null),
    r as (select l.table_index, l.key_col_index, l.feature, q.c, l.value from q join lake l using (key)),
    st as (select table_index, key_col_index, feature, c, avg(value) as m from r group by all),
    tot as (select table_index, key_col_index, feature, avg(value) as m, sum(value * value) - sum(value) * sum(value) / count(*) as ss, sum(value * value) as raw from r group by all),
    sz as (select c, count(*) as n from q group by 1)
    select st.table_index, st.key_col_index, st.feature, round(case when any_value(tot.ss) > 1e-12 * abs(any_value(tot.raw)) then sum(sz.n * pow(st.m - tot.m, 2)) / any_value(tot.ss) else 0 end, 6) as score
    from st join tot using (table_index, key_col_index, feature) join sz using (c) group by 1, 2, 3""")
def eta_scores(spark: SparkSession, d: str) -> DataFrame:
    q = read(spark, d, "customer").where(F.col("c_nationkey").isNotNull()).select(F.col("c_nationkey").cast("string").alias("key"), F.col("c_mktsegment").alias("c"))
    return rounded(retrieval.eta_squared(lake(spark, d), q, "key", "c"))


@query("""
    with c as (select c_custkey, c_nationkey, c_mktsegment, count(*) over (partition by c_nationkey, c_mktsegment) as n, count(*) over () as total,
                      row_number() over (partition by c_nationkey, c_mktsegment order by md5(c_custkey::varchar), c_custkey) as pos from customer)
    select c_custkey, c_nationkey, c_mktsegment from c where total <= 1024 or pos <= greatest(1, round(n / total * 1024))""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return retrieval.sample_per_class(df, "c_nationkey", "c_mktsegment", "c_custkey")


@query(f"with {_LAKE} select table_index, feature, count(*) as n from lake where not (table_name = 'supplier.parquet' and feature like 's_acctbal%') group by 1, 2")
def stop_list(spark: SparkSession, d: str) -> DataFrame:
    kept = retrieval.stop_features(lake(spark, d), {"supplier": ["s_acctbal"]})
    return kept.groupBy("table_index", "feature").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_LAKE} select table_index, count(*) as n from lake where table_index in (select table_index from lake group by 1 having count(distinct feature) > 4) group by 1")
def small_group_filter(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.small_groups_out(lake(spark, d), 4).groupBy("table_index").agg(F.count(F.lit(1)).alias("n"))


_ONCE = f"{_LAKE}, {_CUST}".replace("lake as (", "lake as materialized (", 1)


@query(f"""with {_ONCE}, asked as materialized (select distinct key from q), met as materialized (select l.* from lake l join asked using (key)),
    mean as materialized (select table_index, key_col_index, feature, avg(value) as mean from met group by 1, 2, 3),
    known as (select table_index, key_col_index, feature, key, value from met
              union all select table_index, key_col_index, feature, key, null from mean, asked)
    select table_index, key_col_index, feature, key, round(coalesce(max(value), any_value(mean)), 6) as value from known join mean using (table_index, key_col_index, feature) group by 1, 2, 3, 4""")
def missing_key_padding(spark: SparkSession, d: str) -> DataFrame:
    return rounded(retrieval.pad_missing(lake(spark, d), customers(spark, d)))


# -- Gram matrices and scores -----------------------------------------------------------------------------------------


@query("select c_nationkey as key, count(*) as n, round(sum(c_acctbal), 4) as sum_c_acctbal, round(sum(c_custkey)::double, 4) as sum_c_custkey, round(sum(c_acctbal * c_acctbal), 2) as gram_c_acctbal_c_acctbal, round(sum(c_acctbal * c_custkey), 2) as gram_c_acctbal_c_custkey, round(sum(c_custkey * c_custkey)::double, 2) as gram_c_custkey_c_custkey from customer group by 1")
def query_sketch_regression(spark: SparkSession, d: str) -> DataFrame:
    s = gram.query_sketch(read(spark, d, "customer"), "c_nationkey", ["c_acctbal", "c_custkey"])
    return s.select(F.col("c_nationkey").alias("key"), "n", *[F.round(c, 2 if c.startswith("gram") else 4).alias(c) for c in s.columns[2:]])


@query("select c_nationkey as key, c_mktsegment as class, count(*) as n, round(sum(c_acctbal), 4) as sum_c_acctbal, round(sum(c_acctbal * c_acctbal), 2) as gram_c_acctbal_c_acctbal from customer group by 1, 2")
def query_sketch_classification(spark: SparkSession, d: str) -> DataFrame:
    s = gram.query_sketch(read(spark, d, "customer"), "c_nationkey", ["c_acctbal"], ["c_mktsegment"])
    return s.select(F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("class"), "n", F.round("sum_c_acctbal", 4).alias("sum_c_acctbal"), F.round("gram_c_acctbal_c_acctbal", 2).alias("gram_c_acctbal_c_acctbal"))


_Z = f"""o as ({numeric_sql('orders', 'o_custkey', ['o_totalprice']).replace('round(', '(').replace(', 6)', ')')}),
    z as (select c_nationkey / 10.0::double as x, c_acctbal / 1000 as y, coalesce(o.o_totalprice_mean, (select avg(o_totalprice_mean) from o)) / 100000 as z1, coalesce(o.o_totalprice_max, (select avg(o_totalprice_max) from o)) / 100000 as z2
          from customer left join o on o.key = c_custkey::varchar where c_custkey is not null)"""
_CELLS = [(a, b) for i, a in enumerate(["x", "z1", "z2", "y"]) for b in ["x", "z1", "z2", "y"][i:]]


def _joined(spark: SparkSession, d: str) -> gram.Gram:
    wide = feat.numeric_features(read(spark, d, "orders"), "o_custkey", ["o_totalprice"]).select("key", (F.col("o_totalprice_mean") / 100000).alias("z1"), (F.col("o_totalprice_max") / 100000).alias("z2"))
    q = customers(spark, d).withColumns({"x": F.col("x") / 10, "y": F.col("y") / 1000})
    return gram.joined_gram(q, "key", ["x"], "y", wide, ["z1", "z2"])


@query(f"with {_Z} select unnest([{', '.join(repr(a) for a, _ in _CELLS)}]) as a, unnest([{', '.join(repr(b) for _, b in _CELLS)}]) as b, round(unnest([{', '.join(f'sum({a} * {b})' for a, b in _CELLS)}]), 4) as g from z")
def joint_gram(spark: SparkSession, d: str) -> DataFrame:
    g = _joined(spark, d)
    at = {n: i for i, n in enumerate(g.names)}
    return spark.createDataFrame([(a, b, round(float(g.matrix[at[a], at[b]]), 4)) for a, b in _CELLS], "a string, b string, g double")


@query(f"with {_Z} select unnest([{', '.join(repr(a) for a, _ in _CELLS)}]) as a, unnest([{', '.join(repr(b) for _, b in _CELLS)}]) as b, round(unnest([{', '.join(f'count(*) * corr({a}, {b})' for a, b in _CELLS)}]), 4) as g from z")
def standardized_gram(spark: SparkSession, d: str) -> DataFrame:
    g = _joined(spark, d)
    s, _ = g.standardized()
    at = {n: i for i, n in enumerate(g.names)}
    return spark.createDataFrame([(a, b, round(float(s[at[a], at[b]]), 4)) for a, b in _CELLS], "a string, b string, g double")


@query("select c_mktsegment as class, count(*) as n, round(avg(c_acctbal), 6) as mean_a, round(avg(c_nationkey), 6) as mean_b, round(var_pop(c_acctbal), 4) as var_a, round(covar_pop(c_acctbal, c_nationkey), 4) as cov_ab from customer where c_mktsegment is not null group by 1")
def class_statistics(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "customer").where(F.col("c_mktsegment").isNotNull())
    rows = []
    for label, (n, sums, m) in gram.blocked_gram(df, ["c_acctbal", "c_nationkey"], label="c_mktsegment").items():
        cov = gram.Gram(["a", "b"], n, sums, m, 0).centred() / n
        rows.append((label, int(n), round(float(sums[0] / n), 6), round(float(sums[1] / n), 6), round(float(cov[0, 0]), 4), round(float(cov[0, 1]), 4)))
    return spark.createDataFrame(rows, "class string, n bigint, mean_a double, mean_b double, var_a double, cov_ab double")


@query(f"with {_Z} select unnest(['z1', 'z2']) as feature, round(unnest([regr_r2(y, z1), regr_r2(y, z2)]), 8) as r2 from z")
def single_feature_r2(spark: SparkSession, d: str) -> DataFrame:
    g = _joined(spark, d)
    s = proxy.RegressionScorer(g, "r2").score([], [[1], [2]])
    return spark.createDataFrame([(n, round(float(v), 8)) for n, v in zip(("z1", "z2"), s, strict=True)], "feature string, r2 double")


@query(f"""with {_Z}, t as (select count(*) as n, var_pop(y) * count(*) as yy, regr_r2(y, z1) as a, regr_r2(y, z2) as b from z)
    select unnest(['z1', 'z2']) as feature, round(unnest([-sqrt(yy * (1 - a) / n) / (1 - 1.0::double / n), -sqrt(yy * (1 - b) / n) / (1 - 1.0::double / n)]), 6) as score from t""")
def single_feature_gcv(spark: SparkSession, d: str) -> DataFrame:
    s = proxy.RegressionScorer(_joined(spark, d), "gcv_rmse").score([], [[1], [2]])
    return spark.createDataFrame([(n, round(float(v), 6)) for n, v in zip(("z1", "z2"), s, strict=True)], "feature string, score double")


@query(f"""with {_Z}, q as (select c_mktsegment as c, c_acctbal / 1000 as v from customer where c_mktsegment is not null),
    t as (select count(*) as n, avg(v) as m, var_pop(v) as tv from q), k as (select c, count(*) as n, avg(v) as m, var_pop(v) as var from q group by 1)
    select 'v' as feature, round((sum(k.n / t.n * pow(k.m - t.m, 2)) / any_value(t.tv)) / (sum(k.n / t.n * k.var) / any_value(t.tv) + 0.001), 8) as score from k, t""")
def single_feature_fisher(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "customer").where(F.col("c_mktsegment").isNotNull()).withColumn("v", F.col("c_acctbal") / 1000)
    blocks = {k: gram.Gram(["v"], n, s, m, 0) for k, (n, s, m) in gram.blocked_gram(df, ["v"], label="c_mktsegment").items()}
    total = gram.Gram(["v"], sum(b.n for b in blocks.values()), sum(b.sums for b in blocks.values()), sum(b.matrix for b in blocks.values()), 0, blocks)
    score = proxy.ClassScorer(total, "conditional_mahalanobis").of([0])
    return spark.createDataFrame([("v", round(score, 8))], "feature string, score double")


_TWO = f"""{_Z}, c as (select count(*) as n, var_pop(y) as v, corr(y, z1) as a, corr(y, z2) as b, corr(z1, z2) as r from z),
    t as (select n, v, (a * a + b * b - 2 * a * b * r) / (1 - r * r) as r2 from c)"""


@query(f"""with {_TWO}, m as (select unnest(['mse', 'rmse', 'gcv_rmse', 'r2', 'adj_r2']) as metric,
        unnest([-v * (1 - r2), -sqrt(v * (1 - r2)), -sqrt(v * (1 - r2)) / (1 - 2.0::double / n), r2, 1 - (1 - r2) * (n - 1) / (n - 3)]) as score from t)
    select model, metric, round(score, 6) as score from m, (select unnest(['RegressionCholesky', 'RegressionQR', 'IncrementalRegressionFGS']) as model)""")
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The score of two features together by every metric and model."""
    g = _joined(spark, d)
    rows = []
    for model in ("RegressionCholesky", "RegressionQR", "IncrementalRegressionFGS"):
        for metric in ("mse", "rmse", "gcv_rmse", "r2", "adj_r2"):
            # z2 beside z1, neither beside the base column
            rows.append((model, metric, round(float(proxy.scorer(g, metric, model).score([1], [[2]])[0]), 6)))
    return spark.createDataFrame(rows, "model string, metric string, score double")


@query(f"""with {_Z}, c as (select count(*) as n, var_pop(y) as v, corr(y, z1) as a, corr(y, z2) as b from z)
    select feature, round(-(v - v * r * r / (1 + 0.001 / n)) / pow(1 - 1.0::double / n, 2), 6) as score from c, (select unnest(['z1', 'z2']) as feature), lateral (select case feature when 'z1' then a else b end as r)""")
def single_feature_conditional_gcv(spark: SparkSession, d: str) -> DataFrame:
    s = proxy.RegressionScorer(_joined(spark, d), "conditional_gcv").score([], [[1], [2]])
    return spark.createDataFrame([(n, round(float(v), 6)) for n, v in zip(("z1", "z2"), s, strict=True)], "feature string, score double")


@query("""with q as (select c_mktsegment as c, c_acctbal / 1000 as v from customer where c_mktsegment is not null and c_acctbal is not null),
    k as (select c, count(*) as n, avg(v) / (select stddev_pop(v) from q) as m, var_pop(v) / (select var_pop(v) from q) as s from q group by 1),
    w as (select sum((n - 1) * s) / sum(n - 1) as s from k), p as (select a.m - b.m as gap, a.s as sa, b.s as sb from k a join k b on a.c < b.c)
    select 'average_mahalanobis' as metric, round(sum(gap * gap) / (select s from w), 6) as score from p union all
    select 'average_bhattacharyya', round(sum(gap * gap / (4 * (sa + sb)) + ln((sa + sb) / (2 * sqrt(sa * sb))) / 2), 6) from p""")
def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    """How far the segments lie apart by the balance."""
    df = read(spark, d, "customer").where(F.col("c_mktsegment").isNotNull() & F.col("c_acctbal").isNotNull()).withColumn("v", F.col("c_acctbal") / 1000)
    blocks = {k: gram.Gram(["v"], n, s, m, 0) for k, (n, s, m) in gram.blocked_gram(df, ["v"], label="c_mktsegment").items()}
    total = gram.Gram(["v"], sum(b.n for b in blocks.values()), sum(b.sums for b in blocks.values()), sum(b.matrix for b in blocks.values()), 0, blocks)
    rows = [(m, round(proxy.ClassScorer(total, m).of([0]), 6)) for m in ("average_mahalanobis", "average_bhattacharyya")]
    return spark.createDataFrame(rows, "metric string, score double")


# -- selection and augmentation ---------------------------------------------------------------------------------------


def _plan_rows(spark: SparkSession, plan: list[dict]) -> DataFrame:
    rows = [(i, p["table_name"], p["feature"], float(p["score"]) if p["score"] is not None else None) for i, p in enumerate(plan)]
    return spark.createDataFrame(rows, "step int, table_name string, feature string, score double")


@query()
def forward_selection_regression(spark: SparkSession, d: str) -> DataFrame:
    r = api.Augmenter(lake(spark, d), "regression", top_k=5, threshold=None, tol=0.0001).augment(customers(spark, d), "key", "y", debug=True)
    return _plan_rows(spark, r.plan)


def _segments(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "customer").where(F.col("c_mktsegment").isNotNull() & F.col("c_custkey").isNotNull())
    names = [r[0] for r in df.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]
    code = F.coalesce(*[F.when(F.col("c_mktsegment") == n, F.lit(float(i))) for i, n in enumerate(names)])
    return df.select(F.col("c_custkey").cast("string").alias("key"), F.col("c_acctbal").alias("x"), code.alias("y"))


@query()
def forward_selection_classification(spark: SparkSession, d: str) -> DataFrame:
    r = api.Augmenter(lake(spark, d), "classification", top_k=5, threshold=None).augment(_segments(spark, d), "key", "y", debug=True)
    return _plan_rows(spark, r.plan)


@query()
def backward_elimination(spark: SparkSession, d: str) -> DataFrame:
    r = api.Augmenter(lake(spark, d), "regression", top_k=5, threshold=None, strategy="BackwardElimination", tol=0.0001).augment(customers(spark, d), "key", "y", debug=True)
    return _plan_rows(spark, r.plan)


@query()
def incremental_selection(spark: SparkSession, d: str) -> DataFrame:
    r = api.Augmenter(lake(spark, d), "regression", top_k=5, threshold=None, strategy="IncrementalSelection", metric="r2", tol=0.0001).augment(customers(spark, d), "key", "y", debug=True)
    return _plan_rows(spark, r.plan)


@query(f"""with {_LAKE}, {_CUST}, hits as ({_TOP.format('').replace('limit 3', 'limit 5')}),
    f as (select * from lake join hits using (table_index, key_col_index) where key in (select key from q)),
    m as (select table_index, table_name, key_col_index, feature, avg(value) as m from f group by 1, 2, 3, 4)
    select m.table_name, m.feature, round(abs(corr(coalesce(f.value, m.m), q.y)), 4) as score
    from q cross join m left join f on f.key = q.key and f.table_index = m.table_index and f.key_col_index = m.key_col_index and f.feature = m.feature group by m.table_index, 1, 2, m.key_col_index""")
def explain_features(spark: SparkSession, d: str) -> DataFrame:
    """All candidates for the customers' balance with their correlation, unmatched customers at the mean."""
    got = api.Augmenter(lake(spark, d), "regression", top_k=5, threshold=None).explain(customers(spark, d), "key", "y")
    return rounded(got.drop("collinear"), 4)


@query()
def augment_customers(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: the customers with the features that discovery selects for their balance."""
    return api.Augmenter(lake(spark, d), "regression", top_k=5, threshold=None, tol=0.0001).augment(customers(spark, d), "key", "y", debug=True).table


@query(f"""with o as ({numeric_sql('orders', 'o_custkey', ['o_totalprice'])}), n as ({numeric_sql('supplier', 's_nationkey', ['s_acctbal'])})
    select c_custkey, o.o_totalprice_max as "orders.parquet.o_totalprice_max", o.o_totalprice_mean as "orders.parquet.o_totalprice_mean" from customer left join o on o.key = c_custkey::varchar""")
def augment_left_join(spark: SparkSession, d: str) -> DataFrame:
    chosen = [(0, 0, "o_totalprice_max"), (0, 0, "o_totalprice_mean")]
    names = materialize.friendly_names([(t, k, "orders.parquet", f) for t, k, f in chosen])
    return rounded(materialize.augment(read(spark, d, "customer").select("c_custkey"), "c_custkey", lake(spark, d), chosen, names))


# -- hops and union ---------------------------------------------------------------------------------------------------


def _bridges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Key columns of customer (0: custkey, 1: nationkey), nation (0: nationkey, 1: regionkey) and region."""
    def both(t: int, df: DataFrame, a: str, b: str) -> DataFrame:
        pre = {"c_custkey": "c", "c_nationkey": "n", "n_nationkey": "n", "n_regionkey": "r"}
        x, y = (F.concat(F.lit(pre[c]), F.col(c).cast("string")) for c in (a, b))
        two = [F.struct(F.lit(0).alias("key_col_index"), x.alias("key"), F.lit(1).alias("to_key_col"), y.alias("to_key")), F.struct(F.lit(1).alias("key_col_index"), y.alias("key"), F.lit(0).alias("to_key_col"), x.alias("to_key"))]
        rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        return rows.select(F.explode(F.array(*two)).alias("b")).select(F.lit(t).alias("table_index"), "b.*").distinct()

    bridges = both(0, read(spark, d, "customer"), "c_custkey", "c_nationkey").unionByName(both(1, read(spark, d, "nation"), "n_nationkey", "n_regionkey"))
    region = read(spark, d, "region").select(F.lit(2).alias("table_index"), F.lit(0).alias("key_col_index"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("key"))
    keys = bridges.select("table_index", "key_col_index", "key").unionByName(region).distinct()
    return bridges, keys


def _order_customers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").where(F.col("o_custkey").isNotNull()).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("key"))


_HOPS = """roots as (select distinct 'c' || o_custkey as root from orders where o_custkey is not null),
    h1 as (select 'c' || c_custkey as root, c_nationkey from customer where ('c' || c_custkey) in (select root from roots) and c_nationkey is not null),
    h2 as (select root, n_regionkey from h1 join nation on n_nationkey = c_nationkey), h3 as (select root, r_regionkey from h2 join region on r_regionkey = n_regionkey)"""


@query(f"""with {_HOPS} select 0 as table_index, 0 as key_col_index, 1 as hop, count(distinct root) as roots from h1
    union all select 1, 0, 2, count(distinct root) from h2 union all select 2, 0, 3, count(distinct root) from h3""")
def join_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    bridges, keys = _bridges(spark, d)
    got = hops.edges(hops.join_graph(bridges, keys, _order_customers(spark, d), "key", 0.5, 3))
    return got.select("table_index", "key_col_index", "hop", "roots")


@query(f"with {_HOPS} select root, 'r' || r_regionkey as key from h3 group by all")
def two_hop_join(spark: SparkSession, d: str) -> DataFrame:
    """Regions reached from the customers of orders, over nations."""
    bridges, keys = _bridges(spark, d)
    got = hops.join_graph(bridges, keys, _order_customers(spark, d), "key", 0.5, 3)
    return got.where(F.col("hop") == 3).select("root", "key")


@query(f"""with {_HOPS}, n as (select 'n' || n_nationkey as key, n_nationkey::double as value from nation)
    select h1.root as key, 1 as table_index, 'id' as feature, round(avg(c_nationkey::double), 6) as value from h1 where c_nationkey in (select n_nationkey from nation) group by 1""")
def hop_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of nations in terms of the customers of orders, which reach them over the customers' table."""
    bridges, _ = _bridges(spark, d)
    nation = read(spark, d, "nation").select(F.lit(1).alias("table_index"), F.lit("nation").alias("table_name"), F.lit(0).alias("key_col_index"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"), F.lit("id").alias("feature"), F.lit("id").alias("base_col"), F.col("n_nationkey").cast("double").alias("value"))
    customer = read(spark, d, "customer").select(F.lit(0).alias("table_index"), F.lit("customer").alias("table_name"), F.lit(0).alias("key_col_index"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), F.lit("balance").alias("feature"), F.lit("balance").alias("base_col"), F.col("c_acctbal").alias("value"))
    a = api.Augmenter(customer.unionByName(nation), "regression", max_hops=2, bridges=bridges)
    return rounded(a.reachable_features(_order_customers(spark, d), "key").where("table_index = 1").select("key", "table_index", "feature", "value"))


@query("""with o as (select o_orderkey, o_custkey from orders), c as (select c_custkey, c_nationkey from customer qualify row_number() over (partition by c_custkey) = 1), n as (select n_nationkey, n_name from nation)
    select o_orderkey, c_nationkey as nation_key, n_name as nation from o left join c on c_custkey = o_custkey left join n on n_nationkey = c_nationkey""")
def chain_join(spark: SparkSession, d: str) -> DataFrame:
    path = [(read(spark, d, "customer").select("c_custkey", "c_nationkey"), "o_custkey", "c_custkey"), (read(spark, d, "nation").select("n_nationkey", "n_name"), "t1.c_nationkey", "n_nationkey")]
    out = hops.chain_join(path, read(spark, d, "orders").select("o_orderkey", "o_custkey"))
    return out.select("o_orderkey", F.col("`t1.c_nationkey`").alias("nation_key"), F.col("`t2.n_name`").alias("nation"))


@query(f"""with {_LAKE}, v as (select distinct 'n_nationkey' as q_col, n_nationkey::varchar as value from nation union select distinct 'n_regionkey', n_regionkey::varchar from nation)
    select q_col, table_index, key_col_index, count(*) as overlap from v join keys on keys.key = v.value group by 1, 2, 3""")
def union_seek(spark: SparkSession, d: str) -> DataFrame:
    values = union.stacked_values(read(spark, d, "nation"), ["n_nationkey", "n_regionkey"])
    return union.seek_keys(values, retrieval.lake_keys(lake(spark, d)))


@query("""
    with q as (select distinct category as value from cat_state where table_index = (select min(table_index) from cat_state) and category is not null),
    k as (select distinct table_index, col_name, category from cat_state where category is not null)
    select 'category' as q_col, table_index, col_name as r_col, count(*) as overlap from k join q on q.value = k.category group by 2, 3""")
def union_seek_categories(spark: SparkSession, d: str) -> DataFrame:
    cats = read(spark, d, "cat_state").where(F.col("category").isNotNull())
    first = cats.agg(F.min("table_index").alias("t"))
    values = union.stacked_values(cats.where(F.col("table_index") == first.scalar()), ["category"])
    return union.seek_categories(values, cats)


@query()
def union_peer(spark: SparkSession, d: str) -> DataFrame:
    """The lake table that the suppliers' keys and nations go with best."""
    features = lake(spark, d)
    values = union.stacked_values(read(spark, d, "supplier"), ["s_suppkey", "s_nationkey"])
    names = features.select("table_index", "key_col_index", F.col("key_col").alias("r_col")).distinct()
    hits = union.seek_keys(values, retrieval.lake_keys(features)).join(names, ["table_index", "key_col_index"]).orderBy(F.desc("overlap"), "table_index", "q_col").limit(200)
    rows = [(r["q_col"], r["table_index"], r["r_col"], r["overlap"]) for r in hits.collect()]
    tables = {i: (f"{t}.parquet", 1 + len(c), read(spark, d, t).count()) for i, t, _, c in LAKE}
    peer = union.find_union_peer(rows, tables, 2, read(spark, d, "supplier").count(), 0.3)
    return spark.createDataFrame([(peer.table_name, k, v) for k, v in sorted(peer.mapping.items())] if peer else [], "table_name string, q_col string, r_col string")


@query()
def random_forest_score(spark: SparkSession, d: str) -> DataFrame:
    from lakeseek.operators.prepare import random_forest_score as score

    got = score(read(spark, d, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber")), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "id", "regression")
    return spark.createDataFrame(sorted(got.items()), "metric string, value double")
