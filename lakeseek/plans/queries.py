"""All queries of the core, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.operators import incremental, stitch
from lakeseek.plans import queries_baselines, queries_discovery, queries_features
from lakeseek.plans.catalogue import Query
from lakeseek.sources.shared import materialize, scratch

_PARTS = (queries_features.query, queries_discovery.query, queries_baselines.query)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """For every key of at least 20 distinct rows the table that holds most of them."""
    df = spark.read.parquet(f"{d}/overlap_table.parquet")
    best = stitch.most_frequent_value(df, "key", "table_index", ["key_col_index", "row_index"], 20)
    return best.select("key", F.col("value").alias("table_index"))


_RECORD = ["table_name", "last_updated", "n_rows"]


def _sync(spark: SparkSession, d: str) -> tuple[incremental.Arrivals, DataFrame]:
    """The numbered log of table records, and the gaps that the successful runs of the ledger leave."""
    ledger, runs = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("sync_ledger", "sync_runs"))
    lines = ledger.join(runs.where(F.col("status") == "ok").select("run_id").distinct(), "run_id", "left_semi")
    root = scratch(spark, "sync")
    log, done = incremental.Arrivals(spark, root, _RECORD, "last_updated"), incremental.Progress(spark, root, incremental.FILE)
    log.take_in(f"{d}/tables_meta.parquet")
    done.commit("ledger", lines, incremental.to_intervals(log.numbers(lines), [*incremental.FILE], "seq"))
    return log, materialize(done.gaps(log.ranges()), "gaps")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Tables whose newest record no successful run has taken: of the records in the gaps, those that are their table's newest."""
    log, gaps = _sync(spark, d)
    newest = log.ids().groupBy("table_name").agg(F.max(F.struct("last_updated", "n_rows", "file", "seq")).alias("r")).select("r.file", "r.seq")
    return log.records(f"{d}/tables_meta.parquet", gaps).join(newest, ["file", "seq"], "left_semi").select("table_index").distinct()


def p5_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Records not taken by a successful run, as intervals of their places in the file that brought them first."""
    return _sync(spark, d)[1]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {f.__name__: f for f in (p3_found, p5_found, p5_gaps)}
    for part in _PARTS:
        out |= part.queries
    return out


_OK = "select distinct table_name, last_updated, n_rows from sync_ledger where run_id in (select run_id from sync_runs where status = 'ok')"


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _PARTS for k, v in part.sql.items()} | {
        "p3_found": """
            with counts as (select key, table_index, count(*) as n from (select distinct * from overlap_table where key <> '') group by all),
            ranked as (select *, sum(n) over (partition by key) as total, row_number() over (partition by key order by n desc, table_index) as r from counts)
            select key, table_index from ranked where r = 1 and total >= 20""",
        "p5_found": f"""
            with ok as ({_OK}),
            newest as (select table_index, table_name, last_updated, n_rows,
                              row_number() over (partition by table_name order by last_updated desc, n_rows desc nulls last) as r
                       from tables_meta where last_updated is not null)
            select distinct table_index from newest n where r = 1 and not exists (
                select 1 from ok where ok.table_name = n.table_name and ok.last_updated = n.last_updated and ok.n_rows is not distinct from n.n_rows)""",
        "p5_gaps": f"""
            with ok as ({_OK}),
            arrived as (select *, row_number() over () - 1 as place from tables_meta),
            records as (select table_name, last_updated, n_rows, min(place) as seq from arrived where last_updated is not null group by all),
            open as (select seq, exists (
                select 1 from ok where ok.table_name is not distinct from r.table_name and ok.last_updated = r.last_updated
                                       and ok.n_rows is not distinct from r.n_rows) as taken from records r),
            runs as (select seq, seq - row_number() over (order by seq) as island from open where not taken)
            select 'tables_meta.parquet' as file, min(seq) as first, max(seq) as last from runs group by island""",
    }
