"""The p-queries of the operators in this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.llm import encode, leakage, lookalike, percentiles, set_overlap, top_n, truncation
from lakeseek.sources.shared import materialize


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """(col_name, key) with at least 40 values whose 90th percentile is more than 8 times their median."""
    df = spark.read.parquet(f"{d}/num_state.parquet")
    return percentiles.ratio_exceeds(df, ["col_name", "key"], "values_", ["table_index", "key_col_index", "state_day"], 0.9, 0.5, 8.0, 40)


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Bounded-error quartiles and 90th percentile of every (col_name, key)."""
    df = spark.read.parquet(f"{d}/num_state.parquet")
    states = percentiles.sketch(df, ["col_name", "key"], "values_", ["table_index", "key_col_index", "state_day"])
    return percentiles.percentiles(states, ["col_name", "key"], {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9})


def p1_combined(spark: SparkSession, d: str) -> DataFrame:
    """Every day and table sketched apart and their states merged: (col_name, key), its values, and whether the bounds hold the truth."""
    df = spark.read.parquet(f"{d}/num_state.parquet")
    group, part, qs = ["col_name", "key"], ["table_index", "state_day"], {"p50": 0.5, "p90": 0.9}
    states = percentiles.sketch(df, [*group, *part], "values_", ["key_col_index"], k=128)
    known = percentiles.percentiles(materialize(percentiles.combine(states, group, part, k=128), "states"), group, qs)
    return percentiles.hold_truth(df, known, group, "values_", ["table_index", "key_col_index", "state_day"], qs)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The three keys with most distinct rows of every key column."""
    group = ["table_index", "key_col_index"]
    df = spark.read.parquet(f"{d}/overlap_table.parquet").where(F.col("key").isNotNull() & (F.col("key") != ""))
    # Written once: the sizes of groups, the sampled ranges and both branches read the counts, not the rows.
    counts = materialize(top_n.distinct_rows(df, [*group, "key"], "row_index"), "counts")
    return top_n.top_n(counts, group, "n", ["key"], 3).select(*group, "key")


_PAIR = [f"{c}_{s}" for s in "ab" for c in ("table_index", "key_col_index")]


def p4_shared(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of key columns of at least 40 keys that share at least half of the keys of the smaller one, with the exact sizes."""
    df = spark.read.parquet(f"{d}/overlap_table.parquet").select("table_index", "key_col_index", "key")
    pairs = set_overlap.overlapping_pairs(df, ["table_index", "key_col_index"], "key", 0.5, 40)
    return pairs.select(*[F.col(f"set_{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("table_index", "key_col_index")], "n_a", "n_b", "shared")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of ``p4_shared``."""
    return p4_shared(spark, d).select(*_PAIR)


def _looks(spark: SparkSession, d: str, of: Callable[[DataFrame, tuple], DataFrame]) -> DataFrame:
    """``of`` applied to the texts of both fields under the rules of all of them; the tables are read once."""
    fields = {"key": "overlap_table", "base_column": "aug_sketch"}
    texts = {f: lookalike.distinct_texts(spark.read.parquet(f"{d}/{t}.parquet"), "table_index", f) for f, t in fields.items()}
    rules = lookalike.fit(lookalike.code_point_counts([t.select("text", "n") for t in texts.values()]))
    parts = [of(t, rules).withColumn("field", F.lit(f)).withColumnRenamed("scope", "table_index") for f, t in texts.items()]
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different stored keys, and of base columns, of one table that look the same."""
    return _looks(spark, d, lookalike.pairs_of).select("field", "table_index", "text_a", "text_b")


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every stored key and base column that looks like another one of its table, with the representative of its class."""
    return _looks(spark, d, lookalike.classes_of).select("field", "table_index", "text", "representative", "n", "size")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    df = spark.read.parquet(f"{d}/documents.parquet")
    return encode.with_ids(df, "doc_id", "text", f"{encode.VOCABULARIES}/byte_bpe_50k.tiktoken")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least 10 consecutive words of an evaluation item."""
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "eval_items"))
    found = leakage.leaks(docs, "doc_id", "text", items, "item_id", "text", window=10, item_radius=None)
    return found.where("same_passage").select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a passage like a whole evaluation item, also with words changed, or with ten of its words."""
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "eval_items"))
    return leakage.leaks(docs, "doc_id", "text", items, "item_id", "text", window=10)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text was cut."""
    judged = truncation.truncated(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text", "source")
    return judged.where(F.col("how").isNotNull()).select(F.col("id").alias("doc_id"))


def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts its texts."""
    return truncation.by_source(truncation.truncated(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text", "source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_percentiles, p1_combined, p2_found, p4_found, p4_shared, p6_found, p6_classes, p7_ids, p8_found, p8_leaks, p9_found, p9_sources)}


_VALUES = """
            with rows_once as (select distinct table_index, key_col_index, key, col_name, state_day, values_ from num_state),
            v as (select col_name, key, unnest(values_) as x from rows_once),
            good as (select col_name, key, x from v where x is not null and not isnan(x) and abs(x) <= 1e17)"""
_OVERLAPS = """
            with m as (select distinct table_index * 4294967296 + key_col_index as s, table_index, key_col_index, key from overlap_table where key <> ''),
            sizes as (select s, any_value(table_index) as t, any_value(key_col_index) as c, count(*) as n from m group by s having count(*) >= 40),
            k as (select m.s, m.key from m join sizes using (s)),
            shared as (select a.s as sa, b.s as sb, count(*) as n from k a join k b on a.key = b.key and a.s < b.s group by 1, 2)
            select a.t as table_index_a, a.c as key_col_index_a, b.t as table_index_b, b.c as key_col_index_b {more}
            from shared join sizes a on a.s = sa join sizes b on b.s = sb where 2 * shared.n >= least(a.n, b.n)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_combined": f"""{_VALUES}
            select col_name, key, count(*) as n, true as p50_held, true as p90_held from good group by col_name, key""",
        "p1_found": f"""{_VALUES},
            ranked as (select col_name, key, x, row_number() over (partition by col_name, key order by x) as r,
                              count(*) over (partition by col_name, key) as n from good),
            q as (select col_name, key, max(case when r = (n + 1) // 2 then x end) as p50, max(case when r = (9 * n + 9) // 10 then x end) as p90, max(n) as n
                  from ranked group by col_name, key)
            select col_name, key from q where n >= 40 and p90 > 8 * p50""",
        "p2_found": """
            with counts as (select table_index, key_col_index, key, count(*) as n
                            from (select distinct table_index, key_col_index, key, row_index from overlap_table where key <> '') group by all),
            ranked as (select *, row_number() over (partition by table_index, key_col_index order by n desc, key) as r from counts)
            select table_index, key_col_index, key from ranked where r <= 3""",
        "p4_found": _OVERLAPS.format(more=""),
        "p4_shared": _OVERLAPS.format(more=", a.n as n_a, b.n as n_b, shared.n as shared"),
    }
