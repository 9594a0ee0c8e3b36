"""Discovery over several joins: tables reached from the query's keys through bridge columns of reached tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.operators.retrieval import PAIR
from lakeseek.sources.shared import materialize


def first_hop(keys: DataFrame, query: DataFrame, key: str = "key", threshold: float = 0.5) -> DataFrame:
    """(table_index, key_col_index, key, root, hop, joinability): pairs that hold at least that share of the query's keys."""
    asked = query.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key")).distinct()
    hits = keys.join(asked, "key")
    total = asked.agg(F.count(F.lit(1)).alias("n"))
    reach = hits.groupBy(*PAIR).agg((F.count(F.lit(1)) / total.scalar()).alias("joinability")).where(F.col("joinability") >= threshold)
    return hits.join(reach, PAIR).select(*PAIR, "key", F.col("key").alias("root"), F.lit(1).alias("hop"), "joinability", F.lit(None).cast("int").alias("from_table"), F.lit(None).cast("int").alias("via_key_col"))


def next_hop(bridges: DataFrame, keys: DataFrame, reached: DataFrame, roots: DataFrame, threshold: float, hop: int) -> DataFrame:
    """Pairs reached from the last hop's tables through their other key columns.

    ``bridges``: distinct (table_index, key_col_index, key, to_key_col, to_key): keys that stand in one source row.
    ``roots``: distinct root keys. A pair is kept if at least ``threshold`` of all roots reach it. Known pairs and
    the same table are out. All bridges of a hop go through one join and one aggregate.
    """
    here = reached.where(F.col("hop") == hop - 1).select(*PAIR, "key", "root")
    crossed = here.join(bridges, [*PAIR, "key"]).select(F.col("table_index").alias("from_table"), F.col("to_key_col").alias("via_key_col"), F.col("to_key").alias("key"), "root").distinct()
    known = reached.select(*PAIR).distinct()
    hits = crossed.join(keys, "key").where(F.col("table_index") != F.col("from_table")).join(known, PAIR, "left_anti")
    total = roots.agg(F.count(F.lit(1)).alias("n"))
    edge = [*PAIR, "from_table", "via_key_col"]
    reach = hits.groupBy(*edge).agg((F.countDistinct("root") / total.scalar()).alias("joinability")).where(F.col("joinability") >= threshold)
    return hits.join(reach, edge).select(*PAIR, "key", "root", F.lit(hop).alias("hop"), "joinability", "from_table", "via_key_col").distinct()


def join_graph(bridges: DataFrame, keys: DataFrame, query: DataFrame, key: str = "key", threshold: float = 0.5, max_hops: int = 2) -> DataFrame:
    """All reached (pair, key, root) rows up to ``max_hops``; keys of further hops stand beside the query key (root)."""
    reached = materialize(first_hop(keys, query, key, threshold), "hop1")
    roots = query.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("root")).distinct()
    for hop in range(2, max_hops + 1):
        reached = materialize(reached.unionByName(next_hop(bridges, keys, reached, roots, threshold, hop)), f"hop{hop}")
    return reached


def edges(reached: DataFrame) -> DataFrame:
    """The tree: a row for each pair and way to it; the query is the null parent."""
    return reached.groupBy("from_table", "via_key_col", *PAIR, "hop").agg(F.max("joinability").alias("joinability"), F.countDistinct("root").alias("roots"))


def root_features(features: DataFrame, reached: DataFrame) -> DataFrame:
    """Features of reached pairs in terms of the query's keys: the mean over the keys that a root reaches."""
    rows = features.join(reached.select(*PAIR, "key", "root").distinct(), [*PAIR, "key"])
    return rows.groupBy("table_index", "table_name", "key_col_index", "feature", "base_col", F.col("root").alias("key")).agg(F.avg("value").alias("value"))


def simple_paths(edges_: DataFrame, start: str, max_length: int) -> DataFrame:
    """(path, weight): paths without repeated nodes from ``start`` over edges (source, target, weight), up to a length.

    The weight of a path is the product of its edges'. One join a step; the frontier is never collected.
    """
    steps = edges_.select(F.col("source").alias("s"), F.col("target").alias("t"), F.col("weight").alias("w"))
    frontier = steps.where(F.col("s") == start).select(F.array("s", "t").alias("path"), F.col("w").cast("double").alias("weight"))
    out = frontier
    for _ in range(max_length - 1):
        last = F.element_at("path", -1)
        frontier = frontier.join(steps, last == F.col("s")).where(~F.array_contains("path", F.col("t")))
        frontier = materialize(frontier.select(F.array_append("path", F.col("t")).alias("path"), (F.col("weight") * F.col("w")).alias("weight")), "paths")
        out = out.unionByName(frontier)
    return out


def chain_join(tables: list[tuple[DataFrame, str, str]], base: DataFrame) -> DataFrame:
    """Left joins along a path of (table, left column, right column), many to one; columns get the prefix ``t<i>.``.

    Rows of a table that share the join value are reduced to one before the join, so no row is added.
    """
    out = base
    for i, (df, left, right) in enumerate(tables, 1):
        one = one_per_key(df, right)
        renamed = one.toDF(*[f"t{i}.{c}" for c in one.columns])
        out = out.join(renamed, out[f"`{left}`"].cast("string") == renamed[f"`t{i}.{right}`"].cast("string"), "left")
    return out


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row of each key, the first by the hash of the row, as an aggregate with map-side reduction."""
    order = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    best = df.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), order).alias("r"))
    return best.select(*[F.col("r").getField(c).alias(c) for c in df.columns])
