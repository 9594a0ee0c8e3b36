"""Consecutive numbers over a total order, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.sources.shared import materialize

_LOCAL = (1 << 33) - 1


def number_rows(df: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """``df`` with consecutive numbers from 1 in the column ``name``, in the ascending order of ``order``.

    Rows are range partitioned and sorted; a row's number is its place in its partition plus the rows ahead of the
    partition, of which there is one count a partition. The sorted rows are written first, since a second range
    partitioning would sample other bounds. Nulls come first; rows that tie get different numbers in any order; an empty
    table gives an empty one.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    ranged = materialize(ranged.withColumn("__part", F.shiftright("__id", 33)), "numbered")
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    # As many rows as partitions: one small sort, and small enough to broadcast whatever the table's size.
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))
    number = F.col("__before") + F.col("__id").bitwiseAND(F.lit(_LOCAL)) + 1
    return ranged.join(F.broadcast(offsets), "__part").withColumn(name, number).drop("__id", "__part", "__before")
