"""Queries of per-key features, statistics, imputation, state and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.functions.text import STOP_WORDS, clean_text, normalize_key, snake_case
from lakeseek.operators import features as feat
from lakeseek.operators import materialize as mat
from lakeseek.operators import prepare, sampling, state
from lakeseek.plans.catalogue import Catalogue, read
from lakeseek.plans.config import EngineConfig
from lakeseek.plans.index import LakeIndex
from lakeseek.sources.lake import archive, catalog, resolve_sources, split_types, with_clean_names
from lakeseek.sources.shared import scratch

query = Catalogue()


def norm(c: str) -> str:
    return f"regexp_replace(strip_accents(lower(replace({c}::varchar, '.0', ''))), '[^a-z0-9]', '', 'g')"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines agree whatever the order of a sum."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def numeric_sql(table: str, key: str, columns: list[str]) -> str:
    means = ", ".join(f"(select avg({c}) from {table} where {key} is not null) as m_{c}" for c in columns)
    aggs = ", ".join(f"round(avg(coalesce({c}, m_{c})), 6) as {c}_mean, round(median(coalesce({c}, m_{c})), 6) as {c}_median, round(max(coalesce({c}, m_{c})), 6) as {c}_max, round(min(coalesce({c}, m_{c})), 6) as {c}_min" for c in columns)
    return f"select {norm(key)} as key, {aggs} from (select *, {means} from {table} where {key} is not null) group by 1"


@query(f"select distinct c_name as raw, {norm('c_name')} as key from customer union select distinct p_name, {norm('p_name')} from part union select distinct (s_acctbal * 100)::bigint::varchar || '.0', {norm('(s_acctbal * 100)::bigint::varchar')} from supplier")
def key_normalize(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "customer").select(F.col("c_name").alias("raw")).union(read(spark, d, "part").select("p_name"))
    numbers = read(spark, d, "supplier").select(F.concat((F.round(F.col("s_acctbal") * 100)).cast("bigint").cast("string"), F.lit(".0")).alias("raw"))
    return names.union(numbers).distinct().select("raw", normalize_key(F.col("raw")).alias("key"))


_CAMEL = "lower(split_part(p_type, ' ', 1)) || upper(left(split_part(p_type, ' ', 2), 1)) || lower(substr(split_part(p_type, ' ', 2), 2)) || ' ' || split_part(p_type, ' ', 3) || left(p_name, 3)"


@query(f"""with r as (select distinct {_CAMEL} as raw from part union select distinct p_type from part)
    select raw, trim(lower(regexp_replace(regexp_replace(regexp_replace(raw, '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g')), '_') as snake from r""")
def snake_names(spark: SparkSession, d: str) -> DataFrame:
    """Types of parts as they are, and in camelCase, as lower case words."""
    part = read(spark, d, "part")
    raw = part.select(F.expr(_CAMEL).alias("raw")).union(part.select("p_type")).distinct()
    return raw.select("raw", snake_case(F.col("raw")).alias("snake"))


ALL_TABLES = sorted(["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "overlap_table", "num_state", "cat_state", "tables_meta", "sync_runs", "sync_ledger", "aug_sketch", "eval_items"])


@query(" union all ".join(f"select {i} as table_index, '{t}.parquet' as table_name, count(*) as n_rows from {t}" for i, t in enumerate(ALL_TABLES)))
def lake_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The tables of a folder, found by listing it, and their rows."""
    sources = [*resolve_sources(spark, d)]
    out = None
    for s in sources:
        part = s.read(spark).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(s.table_index).alias("table_index"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return catalog(spark, sources).join(out, "table_index").select("table_index", "table_name", "n_rows")


@query("""select 'orders.csv' as table_name, 'ocustkey' as "column", count(*) as n, count(distinct o_custkey) as distinct_values from orders union all
    select 'nation.csv', 'nname', count(*), count(distinct n_name) from nation union all select 'customer.tsv.gz', 'cmktsegment', count(*), count(distinct c_mktsegment) from customer""")
def lake_of_texts(spark: SparkSession, d: str) -> DataFrame:
    """Tables written as CSV in a folder, as CSV in a zip and as TSV in a tar.gz, found and read again by the lake's readers."""
    root = scratch(spark, "texts")
    export = {"orders.csv": ("o_orderkey", "o_custkey", "o_orderpriority"), "nation.csv": ("n_nationkey", "n_name"), "customer.tsv.gz": ("c_custkey", "c_mktsegment")}
    kept = {"orders.csv": "ocustkey", "nation.csv": "nname", "customer.tsv.gz": "cmktsegment"}
    folders = {"orders.csv": "folder", "nation.csv": "zipped", "customer.tsv.gz": "tarred"}
    for name, columns in export.items():
        df = read(spark, d, name.partition(".")[0]).select(*columns)
        if folders[name] == "folder":
            df.write.option("header", True).csv(f"{root}/folder/{name}")
        else:  # an archive holds whole files
            df.coalesce(1).write.option("header", True).option("sep", "\t" if "tsv" in name else ",").option("compression", "gzip" if name.endswith("gz") else "none").csv(f"{root}/plain/{name}")
            archive(spark, f"{root}/{folders[name]}{'.zip' if name.endswith('csv') else '.tar.gz'}", {name: f"{root}/plain/{name}"})
    sources = [s for p in (f"{root}/folder", f"{root}/zipped.zip", f"{root}/tarred.tar.gz") for s in resolve_sources(spark, p)]
    out = None
    for s in sources:
        df = with_clean_names(s.read(spark))
        part = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(kept[s.name]).alias("distinct_values")).select(F.lit(s.name).alias("table_name"), F.lit(kept[s.name]).alias("column"), "n", "distinct_values")
        out = part if out is None else out.unionByName(part)
    return out


@query(numeric_sql("lineitem", "l_suppkey", ["l_quantity", "l_extendedprice"]))
def numeric_key_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(feat.numeric_features(read(spark, d, "lineitem"), "l_suppkey", ["l_quantity", "l_extendedprice"]))


@query(numeric_sql("events", "user_id", ["value"]))
def numeric_key_aggregates_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(feat.numeric_features(read(spark, d, "events"), "user_id", ["value"]))


def text_sql(table: str, key: str, column: str) -> str:
    return f"""
        with m as (select {column} as v from {table} where {key} is not null and {column} is not null group by 1 order by count(*) desc, 1 limit 1),
        r as (select {norm(key)} as key, coalesce({column}, (select v from m)) as v, count(*) as r from {table} where {key} is not null group by 1, 2),
        n as (select count(distinct v) as n from r)
        select key, round(sum(r) / any_value(n * n), 6) as {column}_mean, round(max(r) / any_value(n), 6) as {column}_max, count(distinct r)::double as {column}_nunique
        from r, n where v is not null group by key"""


@query(text_sql("customer", "c_nationkey", "c_mktsegment"))
def text_key_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(feat.text_features(read(spark, d, "customer"), "c_nationkey", ["c_mktsegment"]))


@query(text_sql("documents", "source", "lang"))
def text_key_counts_with_nulls(spark: SparkSession, d: str) -> DataFrame:
    return rounded(feat.text_features(read(spark, d, "documents"), "source", ["lang"]))


@query(f"""
    with c as (select o_orderpriority as v, count(*) as n from orders where o_custkey is not null group by 1),
    top as (select v, row_number() over (order by n desc, v) as r, sum(n) over () as total from c where v is not null qualify r <= 5),
    s as (select {norm('o_custkey')} as key, o_orderpriority as v from orders where o_custkey is not null),
    names as (select v, 'o_orderpriority_' || regexp_replace(lower(v), '[^a-z0-9]', '', 'g') || '_share' as feature from top where r > 1 or total > (select count(*) from s) )
    select key, feature, round(avg(case when s.v = names.v then 1.0::double else 0.0::double end), 6) as value from s, names group by key, feature""")
def category_shares(spark: SparkSession, d: str) -> DataFrame:
    shares = feat.category_shares(read(spark, d, "orders"), "o_custkey", ["o_orderpriority"])
    return rounded(feat.to_long(shares, 0, "orders", 0, "o_custkey").select("key", "feature", "value"))


@query("""
    with f as (select c_custkey as key, avg(c_acctbal) as c_acctbal_mean, median(c_acctbal) as c_acctbal_median, max(c_acctbal) as c_acctbal_max, min(c_acctbal) as c_acctbal_min
               from customer where c_custkey is not null group by 1),
    e as (select bool_and(c_acctbal_mean = c_acctbal_median) a, bool_and(c_acctbal_median = c_acctbal_max) b, bool_and(c_acctbal_max = c_acctbal_min) c from f)
    select unnest(['c_acctbal_mean', 'c_acctbal_median', 'c_acctbal_max', 'c_acctbal_min']) as feature,
           unnest([case when a and b and c then 'c_acctbal_min' end, case when b and c then 'c_acctbal_min' end, case when c then 'c_acctbal_min' end, 'c_acctbal_min']) as kept from e""")
def duplicate_columns(spark: SparkSession, d: str) -> DataFrame:
    wide = feat.numeric_features(read(spark, d, "customer"), "c_custkey", ["c_acctbal"])
    columns = [c for c in wide.columns if c != "key"]
    rows = [(c, group[-1]) for group in feat.duplicate_columns(wide, "key", columns) for c in group]
    return spark.createDataFrame(rows, "feature string, kept string")


@query("""
    with f as (select n_regionkey as key, max(1)::double as one, avg(n_nationkey) as mean_id from nation group by 1),
    s as (select sign(one - (select avg(one) from f)) as one, sign(mean_id - (select avg(mean_id) from f)) as mean_id from f)
    select feature from (select 'one' as feature, min(one) = max(one) as c from s union all select 'mean_id', min(mean_id) = max(mean_id) from s) where c""")
def constant_columns(spark: SparkSession, d: str) -> DataFrame:
    wide = read(spark, d, "nation").groupBy(F.col("n_regionkey").alias("key")).agg(F.max(F.lit(1.0)).cast("double").alias("one"), F.avg("n_nationkey").alias("mean_id"))
    return spark.createDataFrame([(c,) for c in feat.constant_columns(wide, ["one", "mean_id"])], "feature string")


@query()
def combined_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of orders by customer, without equal and constant columns, in long form."""
    df, numeric, text = split_types(read(spark, d, "orders").drop("o_orderkey", "o_orderdate"))
    wide = feat.combined_features(df, "o_custkey", numeric, text, shares=True)
    return rounded(feat.to_long(wide, 0, "orders", 0, "o_custkey").select("key", "feature", "base_col", "value"))


_STATS = " union all ".join(f"""
    select '{c}' as "column", sum(n)::bigint as "rows", coalesce(sum(n) filter (v is null), 0)::bigint as nulls, count(v)::bigint as uniq, (max(n) filter (v is not null))::bigint as top,
           round(sum(length(v) * n) filter (v is not null) / sum(n) filter (v is not null), 6) as avg_len from (select {c}::varchar as v, count(*) as n from {t} group by 1)""" for t, c in (("documents", "text"), ("documents", "lang"), ("documents", "source"), ("documents", "table_index"), ("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("orders", "o_custkey")))


@query(_STATS)
def column_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = feat.column_stats(read(spark, d, "documents").select("text", "lang", "source", "table_index"))
    orders = feat.column_stats(read(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey"))
    return rounded(docs.unionByName(orders).drop("least"))


@query("""
    with c as (select unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) as "column", unnest([count(distinct p_partkey), count(distinct p_name), count(distinct p_brand), count(distinct p_type), count(distinct p_size), count(distinct p_retailprice)]) as n from part)
    select "column" from c where n > 1 and not regexp_matches("column", 'desc|text|comment|remark|note|memo|content|message|feedback|log|msg|uuid|guid|key|code|ref|hash|token|identifier|unnamed|^id|id$')""")
def key_candidates(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in feat.key_candidates(read(spark, d, "part"))], "column string")


@query("""select event_id, round(coalesce(value, (select avg(value) from events)), 6) as value from events""")
def impute_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(feat.fill_means(read(spark, d, "events").select("event_id", "value"), ["value"]))


@query("""select doc_id, coalesce(lang, (select lang from documents where lang is not null group by 1 order by count(*) desc, lang limit 1)) as lang from documents""")
def impute_mode(spark: SparkSession, d: str) -> DataFrame:
    return feat.fill_modes(read(spark, d, "documents").select("doc_id", "lang"), ["lang"])


@query("select o_orderkey, round(o_totalprice, 6) as o_totalprice, round(pow(o_totalprice, 2), 2) as squared, round(pow(o_totalprice / 1000, 3), 3) as cubed from orders")
def polynomial_features(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") / 1000).alias("k"))
    out = mat.power_columns(mat.power_columns(df, "o_totalprice", 2), "k", 3)
    return out.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"), F.round(F.col("`o_totalprice^2`"), 2).alias("squared"), F.round(F.col("`k^3`"), 3).alias("cubed"))


@query("""
    with e as (select list_distinct(quantile_cont(o_totalprice, [0.25, 0.5, 0.75])) as e from orders)
    select o_orderkey, len(list_filter(e, lambda x: x <= o_totalprice)) as bin from orders, e""")
def quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "orders")
    edges = mat.bin_edges(df, "o_totalprice", 4)
    return df.select("o_orderkey", mat.bin_index(F.col("o_totalprice"), edges).cast("bigint").alias("bin"))


# -- state ------------------------------------------------------------------------------------------------------------

_NUMERIC_STATE = f"""select {norm('o_custkey')} as key, 'o_totalprice' as col_name, count(o_totalprice) as count_, round(sum(o_totalprice), 4) as sum_, min(o_totalprice) as min_, max(o_totalprice) as max_,
    list_sort(list(o_totalprice)) as values_ from orders where o_custkey is not null and o_totalprice is not null group by 1"""


@query(_NUMERIC_STATE)
def state_numeric(spark: SparkSession, d: str) -> DataFrame:
    return state.numeric_state(read(spark, d, "orders"), "o_custkey", ["o_totalprice"]).withColumn("sum_", F.round("sum_", 4))


@query(f"""select {norm('o_custkey')} as key, 'o_orderpriority' as col_name, o_orderpriority as category, count(*) as raw_count from orders where o_custkey is not null and o_orderpriority is not null group by 1, 3""")
def state_text(spark: SparkSession, d: str) -> DataFrame:
    return state.text_state(read(spark, d, "orders"), "o_custkey", ["o_orderpriority"])


def _chunks(df: DataFrame) -> list[DataFrame]:
    return [df.where(F.col("o_orderdate") < "1995-01-01"), df.where(F.col("o_orderdate").between("1995-01-01", "1996-06-30")), df.where((F.col("o_orderdate") > "1996-06-30") | F.col("o_orderdate").isNull())]


@query(_NUMERIC_STATE)
def state_merge(spark: SparkSession, d: str) -> DataFrame:
    parts = [state.numeric_state(p, "o_custkey", ["o_totalprice"]) for p in _chunks(read(spark, d, "orders"))]
    return state.merge_numeric(parts, ["key", "col_name"]).withColumn("sum_", F.round("sum_", 4))


_INDEXED = f"""
    n as (select {norm('l_suppkey')} as key, avg(l_quantity) as lquantity_mean, median(l_quantity) as lquantity_median, max(l_quantity) as lquantity_max, min(l_quantity) as lquantity_min from lineitem where l_suppkey is not null group by 1),
    r as (select {norm('l_suppkey')} as key, l_returnflag as v, count(*) as r from lineitem where l_suppkey is not null and l_returnflag is not null group by 1, 2),
    t as (select key, sum(r) / any_value(u * u) as lreturnflag_mean, max(r) / any_value(u) as lreturnflag_max, count(distinct r)::double as lreturnflag_nunique from r, (select count(distinct v) as u from r) group by 1),
    wide as (select key, lquantity_mean, lquantity_median, lquantity_max, lquantity_min, lreturnflag_mean, lreturnflag_max, lreturnflag_nunique from n join t using (key)),
    long as (unpivot wide on columns(* exclude (key)) into name feature value value)"""


def _lines(spark: SparkSession, d: str) -> tuple[LakeIndex, DataFrame]:
    index = LakeIndex(spark, "lines", EngineConfig(scratch(spark, "index")))
    return index, read(spark, d, "lineitem").select("l_linenumber", "l_suppkey", "l_quantity", "l_returnflag")


_NO_TWINS = "select key, feature, base_col, round(value, 6) as value from (select key, feature, regexp_replace(feature, '_(mean|median|max|min|nunique)$', '') as base_col, value, count(distinct value) over (partition by feature) as u from long) where u > 1"


@query(f"with {_INDEXED} {_NO_TWINS}")
def index_features(spark: SparkSession, d: str) -> DataFrame:
    """A table indexed by its supplier key: its features in the index; constant ones aren't kept."""
    index, lines = _lines(spark, d)
    index.add_table(lines.drop("l_linenumber"), 0, "lines", key_columns=["l_suppkey"])
    return rounded(index.read("features").select("key", "feature", "base_col", "value"))


@query("select 0 as table_index, 'lines' as table_name, count(distinct l_suppkey) as keys, (select count(*) from lineitem) as n_rows, ['lsuppkey'] as key_columns from lineitem where l_suppkey is not null")
def index_catalog(spark: SparkSession, d: str) -> DataFrame:
    """What the index knows of the table."""
    index, lines = _lines(spark, d)
    index.add_table(lines.drop("l_linenumber"), 0, "lines", key_columns=["l_suppkey"])
    return index.indexed_tables().join(index.read("meta"), ["table_index", "table_name"]).select("table_index", "table_name", "keys", "n_rows", "key_columns")


@query(f"with {_INDEXED} select key, feature, round(value, 6) as value from long")
def update_equals_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """A table indexed with some of its rows and updated with the others, one update being delivered twice."""
    index, lines = _lines(spark, d)
    parts = [lines.where(F.col("l_linenumber") % 3 == i).drop("l_linenumber") for i in range(3)]
    index.add_table(parts[0], 0, "lines", key_columns=["l_suppkey"], update_support=True)
    for delta, part in (("one", parts[1]), ("one", parts[1]), ("two", parts[2])):
        index.update_table("lines", part, delta)
    return rounded(index.read("features").select("key", "feature", "value"))


@query("""select table_index, key_col_index, key, col_name, sum(count_)::bigint as count_, case when not isnan(min(min_)) then min(min_) end as min_, case when not isnan(max(max_)) then max(max_) end as max_,
           list_transform(list_sort(flatten(list(values_)), 'ASC', 'NULLS FIRST'), lambda x: case when not isnan(x) then x end) as values_
    from (select distinct * from num_state) group by table_index, key_col_index, key, col_name""")
def lake_state_merge(spark: SparkSession, d: str) -> DataFrame:
    """Days of the lake's numeric state, written twice or not, merged whole per table, key column, key and column.

    ``sum_`` is merged but not shown: with sentinels of 1e18 among its parts it depends on the order of addition. NaN is
    shown as null, as it equals nothing in a comparison.
    """
    merged = state.merge_numeric([read(spark, d, "num_state").distinct()], ["table_index", "key_col_index", "key", "col_name"])
    known = lambda v: F.when(~F.isnan(v), v)
    shown = merged.withColumns({"min_": known(F.col("min_")), "max_": known(F.col("max_")), "values_": F.transform("values_", known)})
    return shown.drop("sum_")


# -- sampling ---------------------------------------------------------------------------------------------------------

_UNIT = "((('0x' || substr(md5({c}::varchar), 1, 13))::bigint + 1) / 4503599627370496.0::double)"


@query(f"""
    with r as (select o_orderkey, o_totalprice * o_totalprice as norm2, {_UNIT.format(c='o_orderkey')} / (o_totalprice * o_totalprice) as rank from orders where o_totalprice <> 0),
    o as (select *, row_number() over (order by rank, o_orderkey) as pos from r qualify pos <= 501)
    select o_orderkey, round(greatest(1.0, 1 / sqrt(least(1.0, norm2 * (select rank from o where pos = 501)))), 6) as scale from o where pos <= 500""")
def priority_sample(spark: SparkSession, d: str) -> DataFrame:
    got = sampling.priority_sample(read(spark, d, "orders"), "o_orderkey", ["o_totalprice"], 500)
    return rounded(got.select("o_orderkey", "scale"))


@query("""select o_orderkey, o_custkey from orders qualify row_number() over (partition by o_custkey order by md5(o_orderkey::varchar), o_orderkey) = 1""")
def one_row_per_key(spark: SparkSession, d: str) -> DataFrame:
    return sampling.one_row_per_key(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey")


@query(f"""select o_orderkey, case when {_UNIT.format(c='o_orderkey')} <= 0.2 then 'test' else 'train' end as part from orders""")
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    train, test = sampling.train_test_split(read(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("""
    with c as (select o_orderkey, o_orderpriority, count(*) over (partition by o_orderpriority) as n, count(*) over () as total,
                      row_number() over (partition by o_orderpriority order by md5(o_orderkey::varchar), o_orderkey) as pos from orders)
    select o_orderkey, o_orderpriority from c where total <= 1000 or pos <= greatest(1, round(n / total * 1000))""")
def proportional_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.proportional_values(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 1000)


# -- query tables -----------------------------------------------------------------------------------------------------


@query(f"""
    with codes as (select c_mktsegment, row_number() over (order by min(c_custkey), c_mktsegment) - 1 as code from customer where c_mktsegment is not null and c_nationkey is not null group by 1)
    select {norm('c_nationkey')} as c_nationkey, round(coalesce(c_acctbal, (select median(c_acctbal) from customer where c_mktsegment is not null and c_nationkey is not null)), 6) as c_acctbal, code::double as c_mktsegment
    from customer join codes using (c_mktsegment) where c_nationkey is not null""")
def prepare_query_table(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return rounded(prepare.prepare_query_table(df, "c_nationkey", "c_mktsegment", "c_custkey"))


@query("""
    with l as (select l_extendedprice as y, l_extendedprice * 2 + 1 as copy, l_quantity as q, l_discount as d, l_tax as t from lineitem)
    select "column" from (select unnest(['copy', 'l_quantity', 'l_discount', 'l_tax']) as "column", unnest([corr(copy, y), corr(q, y), corr(d, y), corr(t, y)]) as c from l) where abs(c) >= 0.99""")
def target_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Columns that give the price away once a copy of it is among them."""
    df = read(spark, d, "lineitem").withColumn("copy", F.col("l_extendedprice") * 2 + 1)
    found = prepare.target_leaks(df, "l_extendedprice", ["copy", "l_quantity", "l_discount", "l_tax"])
    return spark.createDataFrame([(c,) for c in found], "column string")


@query(f"""select doc_id, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '),
    lambda w: w <> '' and not list_contains({STOP_WORDS}, w)), ' ') as cleaned from documents where text is not null""")
def cleaned_text(spark: SparkSession, d: str) -> DataFrame:
    """The ASCII words of every document, without stop words."""
    docs = read(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", clean_text(F.col("text")).alias("cleaned"))
