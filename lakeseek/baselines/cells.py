"""Search over a table of cells (table_id, row_id, col_id, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_cells(df: DataFrame, table_id: int, row_id: str, columns: list[str]) -> DataFrame:
    """The table as cells; ``row_id`` names its rows, ``col_id`` is a column's place in ``columns``; nulls have no cell."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("col_id"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns)]))
    return df.select(F.lit(table_id).alias("table_id"), F.col(row_id).cast("bigint").alias("row_id"), cells.alias("c")).select("table_id", "row_id", "c.*").where(F.col("value").isNotNull())


def column_pairs(cells: DataFrame, examples: DataFrame, least: int = 2) -> DataFrame:
    """(table_id, col_x, col_y, examples): ordered column pairs of one table that hold at least ``least`` different
    example pairs (x, y) in one row. Only cells with an example's value take part in the join."""
    both = examples.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("x", "y").distinct()
    cx = cells.join(both, cells["value"] == both["x"]).select("table_id", "row_id", F.col("col_id").alias("col_x"), "x", "y")
    cy = cells.select("table_id", "row_id", F.col("col_id").alias("col_y"), F.col("value").alias("y"))
    hits = cx.join(cy, ["table_id", "row_id", "y"]).where(F.col("col_x") != F.col("col_y"))
    found = hits.groupBy("table_id", "col_x", "col_y").agg(F.countDistinct("x", "y").alias("examples"))
    return found.where(F.col("examples") >= least)


def rebuild(cells: DataFrame, table_id: int, columns: list[str]) -> DataFrame:
    """A table from its cells: one row a row_id."""
    picked = [F.max(F.when(F.col("col_id") == i, F.col("value"))).alias(c) for i, c in enumerate(columns)]
    return cells.where(F.col("table_id") == table_id).groupBy("row_id").agg(*picked)


def numeric_clean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as numbers: those of at most half unreadable values keep the rest as their mean, nulls become 0; columns
    with more unreadable values stay text."""
    tried = {c: F.expr(f"try_cast(`{c}` as double)") for c in columns}
    stats = df.agg(*[F.avg((F.col(c).isNotNull() & t.isNull()).cast("double")).alias(f"b_{c}") for c, t in tried.items()], *[F.avg(t).alias(f"m_{c}") for c, t in tried.items()]).first()
    out = {}
    for c, t in tried.items():
        if stats[f"b_{c}"] is not None and stats[f"b_{c}"] <= 0.5:
            out[c] = F.when(F.col(c).isNull(), 0.0).otherwise(F.coalesce(t, F.lit(stats[f"m_{c}"]), F.lit(0.0)))
    return df.withColumns(out) if out else df


def composite_key(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.concat_ws("_", *[F.col(c).cast("string") for c in columns]))


def sample_columns(catalog: DataFrame, n: int, order: str) -> DataFrame:
    """``n`` rows of a catalog in md5 order: a benchmark's query set."""
    return catalog.orderBy(F.md5(F.col(order).cast("string")), order).limit(n)
