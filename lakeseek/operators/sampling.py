"""Sampling operators. Where an order is "random" it is the md5 of the row or its id: the same on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit_hash(c: Column) -> Column:
    """A number in (0, 1] from the md5 of a value: its first 13 hexadecimal digits."""
    return (F.conv(F.substring(F.md5(c.cast("string")), 1, 13), 16, 10).cast("double") + 1) / F.lit(float(16**13))


def priority_sample(df: DataFrame, row_id: str, columns: list[str], k: int) -> DataFrame:
    """Priority sampling by row norm: the ``k`` rows with the smallest hash / norm^2; ``tau`` is the next one's rank.

    Rows with norm 0 are never drawn. ``scale`` = 1 / sqrt(min(1, norm^2 tau)) makes sums of squares unbiased. With at
    most k rows of positive norm all are kept, tau is null and scale 1.
    """
    norm = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) ** 2 for c in columns), F.lit(0.0))
    ranked = df.withColumn("norm2", norm).where(F.col("norm2") > 0).withColumn("rank", unit_hash(F.col(row_id)) / F.col("norm2"))
    best = ranked.orderBy("rank", row_id).limit(k + 1)
    numbered = best.withColumn("at", F.row_number().over(Window.orderBy("rank", row_id)))  # k + 1 rows
    tau = numbered.where(F.col("at") == k + 1).agg(F.max("rank").alias("tau"))
    kept = numbered.where(F.col("at") <= k).withColumn("tau", tau.scalar())
    return kept.withColumn("scale", F.coalesce(1 / F.sqrt(F.least(F.lit(1.0), F.col("norm2") * F.col("tau"))), F.lit(1.0))).drop("at")


def row_norm(df: DataFrame, numeric: list[str], text: list[str]) -> Column:
    """Squared norm of a row whose text columns are one-hot: the numbers squared plus the texts that aren't null."""
    numbers = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) ** 2 for c in numeric), F.lit(0.0))
    return numbers + sum((F.col(c).isNotNull().cast("double") for c in text), F.lit(0.0))


def one_row_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row whose ``order`` value has the smallest md5: an aggregate, reduced before its shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(F.col(key).alias("__k")).agg(F.min_by(row, F.struct(F.md5(F.col(order).cast("string")), F.col(order))).alias("r"))
    return best.select(*[F.col("r").getField(c).alias(c) for c in df.columns])


def hash_sample(df: DataFrame, order: str, n: int) -> DataFrame:
    """``n`` rows in md5 order of ``order``."""
    return df.orderBy(F.md5(F.col(order).cast("string")), order).limit(n)


def train_test_split(df: DataFrame, row_id: str, test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """A partition of the rows by the hash of their id; copies of an id stay together. One pass, no shuffle."""
    h = unit_hash(F.col(row_id))
    return df.where(h > test_share), df.where(h <= test_share)


def proportional_values(df: DataFrame, column: str, order: str, most: int = 10_000) -> DataFrame:
    """About ``most`` rows with the values of ``column`` in proportion, at least one row a value."""
    w = Window.partitionBy(column)
    total = df.agg(F.count(F.lit(1)).alias("n"))
    take = F.greatest(F.lit(1), F.round(F.count(F.lit(1)).over(w) / total.scalar() * most))
    ranked = df.withColumns({"__take": take, "__at": F.row_number().over(w.orderBy(F.md5(F.col(order).cast("string")), order))})
    return ranked.where((total.scalar() <= most) | (F.col("__at") <= F.col("__take"))).drop("__take", "__at")
