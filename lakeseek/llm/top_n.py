"""Top n items of every group, whatever the sizes of the groups.

Exact group counts send each group one way: the rows of hot groups are range partitioned on (group, score, tie), so that
sampled quantiles split a hot group over as many tasks as its size asks for, and each range, which acts as the salt,
keeps its first n; those few rows are ranked again. All other groups go through one window. The results are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.operators.skew import HotGroups

#: Rows from which a group counts as hot.
HOT_ROWS = 20_000
#: Row numbers that are counted together.
BLOCK = 1 << 14


def _ranked(df: DataFrame, group: list[str], order: list[Column], n: int, name: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= n)


def distinct_rows(df: DataFrame, keys: list[str], number: str, name: str = "n") -> DataFrame:
    """``keys`` and how many different values of the integer column ``number`` they have (null is one).

    Rows are shuffled once, on the keys and the block of the number: copies meet, a key of any number of rows is spread
    over its blocks, and a block is one row from then on.
    """
    rows = df.select(*keys, number, F.floor(F.col(number) / BLOCK).alias("__block"))
    blocks = rows.repartition(*keys, "__block").distinct().groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias(name))
    return blocks.groupBy(*keys).agg(F.sum(name).alias(name))


def top_n(df: DataFrame, group: list[str], score: str, tie: list[str], n: int, sizes: DataFrame | None = None, hot_rows: int = HOT_ROWS, rank: str = "rank") -> DataFrame:
    """The ``n`` rows of every group with the highest ``score``, and their place in the column ``rank`` (from 1).

    Ties go to the smaller values of ``tie``, strings by code points; rows that tie in all of these are told apart
    arbitrarily but n are kept. A group of fewer rows is kept whole. Null scores come last, null ties first; null
    group keys form a group. An empty table gives an empty one. ``rank`` must be a new name.

    ``sizes``: rows whose counts per group are at least those of ``df``, for example the rows before an aggregation,
    where counting them is cheaper than counting ``df``.
    """
    if rank in df.columns:
        raise ValueError(f"column {rank} exists already")
    order = [F.desc_nulls_last(score), *(F.asc_nulls_first(t) for t in tie)]
    hot = HotGroups((df if sizes is None else sizes).select(*group), group, hot_rows)
    light = _ranked(hot.cold(df), group, order, n, rank)
    if hot.empty:
        return light
    ranged = hot.hot(df).repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id())
    firsts = _ranked(ranged, [*group, "__range"], order, n, rank).drop("__range", rank)
    return light.unionByName(_ranked(firsts, group, order, n, rank))
