"""Mergeable state of a table's features: what an update adds to instead of rebuilding.

Numeric state holds count, sum, ends and the sorted values of a (key, column); text state holds counts of categories.
Merging is adding, so the order of updates, late ones included, plays no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.functions.text import stored_key


def numeric_state(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, col_name, count_, sum_, min_, max_, values_`` (sorted); null keys and null values are passed over."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(c).cast("double").alias("v")) for c in columns]))
    rows = df.where(F.col(key).isNotNull()).select(stored_key(F.col(key)).alias("key"), cells.alias("c")).select("key", "c.*").where(F.col("v").isNotNull())
    return rows.groupBy("key", "col_name").agg(F.count("v").alias("count_"), F.sum("v").alias("sum_"), F.min("v").alias("min_"), F.max("v").alias("max_"), F.sort_array(F.collect_list("v")).alias("values_"))


def text_state(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, col_name, category, raw_count``; null keys and null categories are passed over."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(c).cast("string").alias("category")) for c in columns]))
    rows = df.where(F.col(key).isNotNull()).select(stored_key(F.col(key)).alias("key"), cells.alias("c")).select("key", "c.*").where(F.col("category").isNotNull())
    return rows.groupBy("key", "col_name", "category").agg(F.count(F.lit(1)).alias("raw_count"))


def merge_numeric(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """States added up per ``by``."""
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df.groupBy(*by).agg(F.sum("count_").alias("count_"), F.sum("sum_").alias("sum_"), F.min("min_").alias("min_"), F.max("max_").alias("max_"), F.sort_array(F.flatten(F.collect_list("values_"))).alias("values_"))


def merge_text(parts: list[DataFrame], by: list[str]) -> DataFrame:
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df.groupBy(*by).agg(F.sum("raw_count").alias("raw_count"))


def median_of(values: str):
    """The median of a sorted array: the middle one or the mean of the two in the middle."""
    n = F.size(values)
    return (F.element_at(values, F.floor((n + 1) / 2).cast("int")) + F.element_at(values, F.floor((n + 2) / 2).cast("int"))) / 2


def derive(numeric: DataFrame | None, text: DataFrame | None) -> DataFrame:
    """Features in long form (``key, feature, value``) of the keys that have a value in every column of both states."""
    parts, whole = [], []
    if numeric is not None:
        cells = {"mean": F.col("sum_") / F.col("count_"), "median": median_of("values_"), "max": F.col("max_"), "min": F.col("min_")}
        parts.append(numeric.select("key", F.explode(F.array(*[F.struct(F.concat("col_name", F.lit(f"_{a}")).alias("feature"), v.alias("value")) for a, v in cells.items()])).alias("c")).select("key", "c.*"))
        whole.append(numeric.select("key", "col_name"))
    if text is not None:
        n = text.select("col_name", "category").distinct().groupBy("col_name").agg(F.count(F.lit(1)).alias("n"))
        per_key = text.groupBy("key", "col_name").agg(F.sum("raw_count").alias("s"), F.max("raw_count").alias("x"), F.countDistinct("raw_count").alias("u")).join(n, "col_name")
        cells = {"mean": F.col("s") / (F.col("n") * F.col("n")), "max": F.col("x") / F.col("n"), "nunique": F.col("u").cast("double")}
        parts.append(per_key.select("key", F.explode(F.array(*[F.struct(F.concat("col_name", F.lit(f"_{a}")).alias("feature"), v.alias("value")) for a, v in cells.items()])).alias("c")).select("key", "c.*"))
        whole.append(text.select("key", "col_name").distinct())
    columns = whole[0] if len(whole) == 1 else whole[0].unionByName(whole[1])
    total = columns.select("col_name").distinct().agg(F.count(F.lit(1)).alias("n"))
    complete = columns.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == total.scalar()).select("key")
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.join(complete, "key", "left_semi")
