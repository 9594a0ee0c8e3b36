"""Queries of the other ways to discover and augment, and of the streaming path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.baselines import augmenters, cells, set_search, statistics
from lakeseek.plans.catalogue import Catalogue, read
from lakeseek.plans.queries_discovery import _LAKE, customers, lake
from lakeseek.plans.queries_features import rounded
from lakeseek.sources.shared import materialize, scratch

query = Catalogue()
PERMS = 16

_SETS = " union ".join(f"select distinct '{t}.{c}' as set_id, trim({c}::varchar) as token from {t} where trim({c}::varchar) <> '' and not regexp_matches(trim({c}::varchar), '^[0-9]+$')" for t, c in (("part", "p_name"), ("part", "p_brand"), ("part", "p_type"), ("customer", "c_name"), ("customer", "c_mktsegment"), ("supplier", "s_name"), ("orders", "o_orderpriority"), ("documents", "lang"), ("documents", "source")))
_LAKE_SETS = "select distinct table_index || '.' || key_col_index as set_id, trim(key) as token from overlap_table where trim(key) <> '' and not regexp_matches(trim(key), '^[0-9]+$')"


def column_sets(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t, columns in {"part": ["p_name", "p_brand", "p_type"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"], "orders": ["o_orderpriority"], "documents": ["lang", "source"]}.items():
        part = set_search.token_sets(read(spark, d, t), columns, t)
        out = part if out is None else out.unionByName(part)
    return out


def lake_sets(spark: SparkSession, d: str) -> DataFrame:
    """Key columns of the inverted index as sets."""
    df = read(spark, d, "overlap_table").select(F.concat_ws(".", "table_index", "key_col_index").alias("set_id"), F.trim("key").alias("token"))
    return df.where(set_search.is_token(F.col("token"))).distinct()


@query(f"""with s as ({_LAKE_SETS}), q as (select distinct table_index as query_id, trim(key) as token from overlap_table where table_index % 100 = 0)
    select query_id, set_id, count(*) as overlap from q join s using (token) group by 1, 2 qualify row_number() over (partition by query_id order by count(*) desc, set_id) <= 10""")
def exact_set_overlap_topk(spark: SparkSession, d: str) -> DataFrame:
    """For every table whose index is divisible by 100 the key columns that share most tokens with its keys."""
    asked = read(spark, d, "overlap_table").where(F.col("table_index") % 100 == 0).select(F.col("table_index").alias("query_id"), F.trim("key").alias("token"))
    return set_search.exact_topk_many(lake_sets(spark, d), asked, 10)


@query(f"with s as ({_SETS}), f as (select token, count(*) as frequency from s group by 1) select token, frequency, row_number() over (order by frequency, token) as token_id from f")
def token_order(spark: SparkSession, d: str) -> DataFrame:
    return set_search.token_order(column_sets(spark, d))


@query(f"with s as ({_SETS}), l as (select token, list_sort(list(distinct set_id)) as sets from s group by 1) select len(sets)::int as frequency, sets, count(*) as tokens from l group by 2")
def posting_groups(spark: SparkSession, d: str) -> DataFrame:
    return set_search.posting_groups(column_sets(spark, d)).select("frequency", "sets", "tokens")


_SIGNED = f"select set_id, [{', '.join(f'min((h * {a} + {b}) % {set_search.PRIME})' for a, b in set_search.permutations(PERMS))}] as signature, count(*) as size from (select set_id, ('0x' || substr(md5(token), 1, 7))::bigint as h from s) group by 1"


@query(f"with s as ({_SETS}) {_SIGNED}")
def minhash_signature(spark: SparkSession, d: str) -> DataFrame:
    return set_search.minhash(column_sets(spark, d), PERMS)


@query(f"with s as ({_LAKE_SETS}), sg as ({_SIGNED}), b as (select set_id, i as band, signature[i * 2 + 1:i * 2 + 2] as bucket from sg, range(8) t(i)) select distinct x.set_id as query_id, y.set_id from b x join b y on x.band = y.band and x.bucket = y.bucket and x.set_id <> y.set_id")
def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    signed = materialize(set_search.minhash(lake_sets(spark, d), PERMS), "signed")
    return set_search.band_candidates(signed, signed, 8, 2)


@query(f"""with s as ({_LAKE_SETS}), q as (select * from s where split_part(set_id, '.', 1)::bigint % 100 = 0), n as (select set_id as query_id, count(*) as n from q group by 1),
    c as (select q.set_id as query_id, s.set_id, count(*) as shared from q join s using (token) where q.set_id <> s.set_id group by 1, 2)
    select query_id, set_id, shared, round(shared / n, 6) as containment from c join n using (query_id) where shared / n >= 0.1 qualify row_number() over (partition by query_id order by shared / n desc, set_id) <= 20""")
def containment_join_paths(spark: SparkSession, d: str) -> DataFrame:
    """For every set of a table whose index is divisible by 100 the sets that hold most of it."""
    asked = F.substring_index("set_id", ".", 1).cast("bigint") % 100 == 0
    return rounded(set_search.containment_paths(lake_sets(spark, d), asked))


@query(f"""with s as ({_LAKE_SETS}), n as (select set_id, count(*) as n from s group by 1),
    c as (select a.set_id as query_id, b.set_id, count(*) as shared from s a join s b using (token) where a.set_id <> b.set_id group by 1, 2)
    select query_id, c.set_id, shared, round(shared / n, 6) as containment from c join n on n.set_id = query_id where shared >= ceil(n * 0.8 - 1e-9)""")
def ensemble_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of sets of which one holds at least 0.8 of the other, with their exact containment."""
    return rounded(set_search.containing_sets(lake_sets(spark, d), 0.8))


@query("""select q.vec_id as query_id, e.vec_id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) as similarity from embeddings q, embeddings e where q.vec_id % 100 = 0
    qualify row_number() over (partition by q.vec_id order by list_cosine_similarity(e.embedding::double[], q.embedding::double[]) desc, e.vec_id) <= 10""")
def embedding_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    vectors = read(spark, d, "embeddings")
    return rounded(set_search.nearest_many(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10, "vec_id", "embedding"))


@query()
def column_embedding_topk(spark: SparkSession, d: str) -> DataFrame:
    """Columns by the similarity of their most frequent values to those of the parts' brands."""
    texts = set_search.column_text(read(spark, d, "part"), ["p_name", "p_brand", "p_type"], "part").unionByName(set_search.column_text(read(spark, d, "customer"), ["c_name", "c_mktsegment"], "customer"))
    vectors = texts.select("set_id", set_search.hashed_ngrams(F.col("text")).alias("v"))
    asked = vectors.where(F.col("set_id") == "part.p_brand").first()["v"]
    return rounded(set_search.nearest(vectors, asked, 5, "set_id", "v"))


_SKETCH = """per as (select o_custkey::varchar as key, avg(o_totalprice) as m from orders where o_custkey is not null and o_totalprice is not null group by 1),
    sk as (select key, sign(m - (select avg(m) from per))::int as side from per order by ('0x' || substr(md5(key), 1, 8))::bigint, key limit 512)"""


@query(f"with {_SKETCH} select key, side from sk")
def qcr_bottomk_sketch(spark: SparkSession, d: str) -> DataFrame:
    return statistics.label_sketch(read(spark, d, "orders"), "o_custkey", "o_totalprice", 512)


@query(f"""with {_LAKE}, {_SKETCH}, m as (select table_index, key_col_index, feature, avg(value) as m from lake group by 1, 2, 3),
    s as (select table_index, key_col_index, feature, key, sign(value - m)::int as side from lake join m using (table_index, key_col_index, feature)),
    h as (select table_index, key_col_index, feature, count(*) as met, sum((s.side * sk.side > 0)::int)::bigint as same, sum((s.side * sk.side < 0)::int)::bigint as opposite from s join sk using (key) group by 1, 2, 3)
    select *, round(greatest(same, opposite) / greatest(met, 1), 6) as score from h""")
def qcr_search(spark: SparkSession, d: str) -> DataFrame:
    asked = statistics.label_sketch(read(spark, d, "orders"), "o_custkey", "o_totalprice", 512)
    ids = ["table_index", "key_col_index", "feature"]
    features = lake(spark, d)
    sides = features.join(features.groupBy(*ids).agg(F.avg("value").alias("m")), ids).select(*ids, "key", F.signum(F.col("value") - F.col("m")).cast("int").alias("side"))
    return rounded(statistics.label_hits(asked, sides, ids))


_CELLS = """select 1 as table_id, c_custkey as row_id, 0 as col_id, c_nationkey::varchar as value from customer where c_nationkey is not null union all select 1, c_custkey, 1, c_mktsegment from customer where c_mktsegment is not null
    union all select 2, o_orderkey, 0, o_orderstatus from orders where o_orderstatus is not null union all select 2, o_orderkey, 1, o_orderpriority from orders where o_orderpriority is not null"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    c = cells.to_cells(read(spark, d, "customer"), 1, "c_custkey", ["c_nationkey", "c_mktsegment"])
    return c.unionByName(cells.to_cells(read(spark, d, "orders"), 2, "o_orderkey", ["o_orderstatus", "o_orderpriority"]))


@query(f"""with cells as ({_CELLS}), ex as (select distinct c_nationkey::varchar as x, c_mktsegment as y from customer where c_nationkey is not null and c_mktsegment is not null),
    h as (select a.table_id, a.col_id as col_x, b.col_id as col_y, ex.x, ex.y from cells a join ex on a.value = ex.x join cells b on b.table_id = a.table_id and b.row_id = a.row_id and b.value = ex.y and b.col_id <> a.col_id)
    select table_id, col_x, col_y, count(distinct (x, y)) as examples from h group by 1, 2, 3 having count(distinct (x, y)) >= 2""")
def column_pair_search(spark: SparkSession, d: str) -> DataFrame:
    """Column pairs by the (nation, segment) pairs of all customers."""
    examples = read(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("x"), F.col("c_mktsegment").alias("y"))
    return cells.column_pairs(_cells(spark, d), examples)


@query("select c_custkey as row_id, c_nationkey::varchar as nation, c_mktsegment as segment from customer where c_nationkey is not null or c_mktsegment is not null")
def table_pivot(spark: SparkSession, d: str) -> DataFrame:
    return cells.rebuild(_cells(spark, d), 1, ["nation", "segment"])


@query("""with r as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2 as a, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2 as b
    from lineitem where l_quantity is not null and l_extendedprice is not null) select round(corr(a, b), 6) as rho from r""")
def spearman_rank_corr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.spearman(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query("""select c_mktsegment as category, count(*) as n, round((select corr((o.c_mktsegment = c.c_mktsegment)::int, o.c_acctbal) from customer o where o.c_acctbal is not null and o.c_mktsegment is not null), 6) as corr
    from customer c where c_acctbal is not null and c_mktsegment is not null group by 1""")
def onehot_max_corr(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "customer").where(F.col("c_mktsegment").isNotNull())
    return rounded(statistics.onehot_correlations(df, "c_mktsegment", "c_acctbal"))


@query(f"""with {_LAKE}, q as (select c_custkey::varchar as key, c_acctbal as y from customer where c_custkey is not null)
    select table_index, key_col_index, feature, count(*) as n, round(case when var_pop(value) * count(*) > 1e-12 * sum(value * value) then regr_r2(y, value) end, 6) as r2 from q join lake using (key) group by 1, 2, 3""")
def best_r2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.best_r2(customers(spark, d), "key", "y", lake(spark, d)))


_MI = """with c as (select lang as a, source as b, count(*) as n from documents where lang is not null and source is not null group by 1, 2), t as (select sum(n)::double as t from c),
    a as (select a, sum(n) as na from c group by 1), b as (select b, sum(n) as nb from c group by 1)"""


@query(f"{_MI} select round(sum(n / t * ln(n * t / (na * nb))), 6) as mi from c join a using (a) join b using (b), t")
def mutual_information(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.mutual_information(read(spark, d, "documents"), "lang", "source"))


@query(f"{_MI} select round(-sum(n / t * ln(n / nb)), 6) as h from c join b using (b), t")
def conditional_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.conditional_entropy(read(spark, d, "documents"), "lang", "source"))


@query("""with r as (select lang as a, kind as b, source as c, count(*) as n from documents where lang is not null and kind is not null and source is not null group by 1, 2, 3), t as (select sum(n)::double as t from r)
    select round(sum(n / t * ln(n * nc / (nac * nbc))), 6) as cmi from r join (select a, c, sum(n)::double as nac from r group by 1, 2) using (a, c) join (select b, c, sum(n)::double as nbc from r group by 1, 2) using (b, c) join (select c, sum(n)::double as nc from r group by 1) using (c), t""")
def conditional_mutual_information(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.conditional_mutual_information(read(spark, d, "documents"), "lang", "kind", "source"))


@query("""with r as (select c_mktsegment as c, c_acctbal as v from customer where c_mktsegment is not null and c_acctbal is not null), p as (select c, count(*) as n, avg(v) as m, var_pop(v) as var from r group by 1)
    select round(sqrt(sum(n * pow(m - (select avg(v) from r), 2)) / (sum(n * pow(m - (select avg(v) from r), 2)) + sum(n * var))), 6) as ratio from p""")
def correlation_ratio(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.correlation_ratio(read(spark, d, "customer"), "c_mktsegment", "c_acctbal"))


@query("""with m as (select l_suppkey, median(l_extendedprice) as m from lineitem group by 1) select l_suppkey, round(median(abs(l_extendedprice - m)) / any_value(abs(m)), 6) as dispersion from lineitem join m using (l_suppkey) group by 1""")
def robust_dispersion(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.robust_dispersion(read(spark, d, "lineitem"), "l_suppkey", "l_extendedprice"))


@query("""with recursive e as (select n_regionkey::varchar as source, ((n_regionkey + 1 + n_nationkey) % 5)::varchar as target, count(*) / 10.0::double as weight from nation group by 1, 2),
    p as (select [source, target] as path, weight, 1 as len from e where source = '0' and target <> '0' union all select list_append(path, e.target), p.weight * e.weight, len + 1 from p join e on e.source = p.path[-1] where len < 3 and not list_contains(path, e.target))
    select path, round(weight, 6) as weight from p""")
def simple_paths(spark: SparkSession, d: str) -> DataFrame:
    from lakeseek.operators.hops import simple_paths as paths

    nation = read(spark, d, "nation")
    edges = nation.groupBy(F.col("n_regionkey").cast("string").alias("source"), ((F.col("n_regionkey") + 1 + F.col("n_nationkey")) % 5).cast("string").alias("target")).agg((F.count(F.lit(1)) / 10).alias("weight"))
    return rounded(paths(edges.where("source <> target"), "0", 3))


def _information(a: str, b: str) -> str:
    return f"""(with c as (select {a}::varchar as a, {b}::varchar as b, count(*) as n from documents where {a} is not null and {b} is not null group by 1, 2),
        j as (select n, sum(n) over (partition by a) as na, sum(n) over (partition by b) as nb, (sum(n) over ())::double as t from c) select sum(n / t * ln(n * t / (na * nb))) from j)"""


_FEATURES = ["lang", "kind", "table_index"]


@query(" union all ".join(f"select '{f}' as feature, round({_information(f, 'source')}, 6) as relevance, round(({' + '.join(_information(f, g) for g in _FEATURES if g != f)}) / 2, 6) as redundancy, round({_information(f, 'source')} - ({' + '.join(_information(f, g) for g in _FEATURES if g != f)}) / 2, 6) as score" for f in _FEATURES))
def mrmr_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.redundancy_scores(read(spark, d, "documents"), _FEATURES, "source"))


def _tables(spark: SparkSession, d: str) -> dict:
    supplier = read(spark, d, "supplier").select("s_nationkey", "s_acctbal")
    nation = read(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name")
    return {"supplier": (supplier, "s_nationkey"), "nation": (nation, "n_nationkey")}


def _nation_query(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("key"), F.col("c_acctbal").alias("y"))


@query("""
    select c_custkey as id, n_name as nation from customer left join nation on n_nationkey = c_nationkey""")
def budgeted_joins(spark: SparkSession, d: str) -> DataFrame:
    out = augmenters.budgeted_joins(_nation_query(spark, d), "key", "y", _tables(spark, d)).table
    return out.select("id", F.col("`nation.n_name`").alias("nation"))


@query()
def random_injection(spark: SparkSession, d: str) -> DataFrame:
    got = augmenters.random_injection(_nation_query(spark, d), "key", "y", _tables(spark, d), "id", rounds=2, trees=5)
    return spark.createDataFrame(got.plan, "feature string, share double")


@query()
def path_search(spark: SparkSession, d: str) -> DataFrame:
    got = augmenters.path_search(_nation_query(spark, d), "key", "y", _tables(spark, d), [("", "key", "nation", "n_nationkey"), ("nation", "n_nationkey", "supplier", "s_nationkey"), ("", "key", "supplier", "s_nationkey")])
    return spark.createDataFrame(got.plan, "feature string, score double")


@query(f"""with {_LAKE.replace('lake as (', 'lake as materialized (', 1)}, q as (select c_custkey::varchar as key, c_acctbal as y from customer where c_custkey is not null),
    r as (select table_index, key_col_index, feature, case when var_pop(value) * count(*) > 1e-12 * sum(value * value) then regr_r2(y, value) end as r2 from q join lake using (key) group by 1, 2, 3),
    one as (select * from r where r2 is not null and r2 >= 0.001 order by r2 desc, table_index, key_col_index, feature limit 1),
    z as (select q.key, q.y, coalesce(l.value, avg(l.value) over ()) as z from q left join (select lake.key, lake.value from lake join one using (table_index, key_col_index, feature)) l using (key)),
    m as (select regr_slope(y, z) as b, regr_intercept(y, z) as a from z), res as (select key, y - a - b * z as e from z, m),
    r2 as (select table_index, key_col_index, feature, case when var_pop(value) * count(*) > 1e-12 * sum(value * value) then regr_r2(e, value) end as r2 from res join lake using (key) anti join one using (table_index, key_col_index, feature) group by 1, 2, 3),
    two as (select * from r2 where r2 is not null and r2 >= 0.001 order by r2 desc, table_index, key_col_index, feature limit 1)
    select feature, round(r2, 6) as r2 from one union all select feature, round(r2, 6) from two""")
def residual_r2(spark: SparkSession, d: str) -> DataFrame:
    got = augmenters.residual_r2(customers(spark, d), "key", "y", lake(spark, d), rounds=2)
    return rounded(spark.createDataFrame(got.plan, "feature string, r2 double"))


@query()
def label_sketch_augment(spark: SparkSession, d: str) -> DataFrame:
    return augmenters.label_sketch_augment(customers(spark, d), "key", "y", lake(spark, d), 3).table


@query()
def rank_correlation_augment(spark: SparkSession, d: str) -> DataFrame:
    got = augmenters.rank_correlation_augment(_nation_query(spark, d), "key", "y", _tables(spark, d))
    return spark.createDataFrame(got.plan, "feature string, score double")


@query()
def profile_search(spark: SparkSession, d: str) -> DataFrame:
    """Which facts about the documents help to tell the length that their source reports."""
    docs = read(spark, d, "documents")
    facts = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("length"), F.coalesce("table_index", F.lit(-1)).alias("table_index"), F.hour("fetched_at").alias("hour"))
    query_ = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("key"), F.coalesce(F.col("n_chars"), F.lit(0)).cast("double").alias("y"))
    got = augmenters.profile_search(query_, "key", "y", {"facts": (facts, "doc_id")}, "id", queries=3, trees=5)
    return spark.createDataFrame(got.plan, "feature string, gain double")


@query("""select regexp_replace(user_id::varchar, '\\.0', '') as key, 'value' as col_name, count(value) as count_, round(sum(value), 4) as sum_, min(value) as min_, max(value) as max_, list_sort(list(value)) as values_
    from events where user_id is not null and value is not null group by 1""")
def stream_append_update(spark: SparkSession, d: str) -> DataFrame:
    """The events read as a stream and merged batch by batch; the state is that of the whole table."""
    from lakeseek.streaming.append import StateStore, append_updates

    root = scratch(spark, "stream")
    store = StateStore(spark, f"{root}/state")
    schema = read(spark, d, "events").schema
    append_updates(spark, f"{d}/events.parquet", schema, "user_id", ["value"], store, f"{root}/checkpoint").awaitTermination()
    return store.read().withColumn("sum_", F.round("sum_", 4))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    from lakeseek.streaming.append import windowed_counts as counts

    return counts(read(spark, d, "events"), "ts", "event_type")
