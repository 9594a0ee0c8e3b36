"""Selected features onto the query table; the query table gains columns and never rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def power_columns(df: DataFrame, column: str, degree: int) -> DataFrame:
    """``<column>^2`` to ``<column>^<degree>``."""
    return df.withColumns({f"{column}^{k}": F.pow(F.col(f"`{column}`"), F.lit(float(k))) for k in range(2, degree + 1)})


def bin_edges(df: DataFrame, column: str, n_bins: int) -> list[float]:
    """Inner quantile edges (linear interpolation), without repeats."""
    qs = [k / n_bins for k in range(1, n_bins)]
    row = df.agg(F.percentile(column, F.array(*map(F.lit, qs))).alias("e")).first()
    return sorted(set(row["e"] or []))


def bin_index(c: Column, edges: list[float]) -> Column:
    """How many edges are not above the value; null for a null."""
    return F.when(c.isNotNull(), sum(((c >= F.lit(e)).cast("int") for e in edges), F.lit(0)))


def bin_indicators(df: DataFrame, column: str, n_bins: int) -> DataFrame:
    """``<column>=bin_<i>`` (0 or 1) for the bins that hold a value."""
    edges = bin_edges(df, column, n_bins)
    at = bin_index(F.col(f"`{column}`"), edges)
    held = sorted(r[0] for r in df.select(at.alias("b")).distinct().collect() if r[0] is not None)
    return df.withColumns({f"{column}=bin_{i}": F.coalesce((at == i).cast("double"), F.lit(0.0)) for i in held})


def interaction(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumn(f"{a}*{b}", F.col(f"`{a}`") * F.col(f"`{b}`"))


def friendly_names(selected: list[tuple[int, int, str, str]]) -> list[str]:
    """Names of (table_index, key_col_index, table_name, feature): ``<table>.<feature>``, with ids where two would clash."""
    plain = [f"{table}.{feature}" for _, _, table, feature in selected]
    return [n if plain.count(n) == 1 else f"{n}__{t}_{k}_{i}" for i, (n, (t, k, _, _)) in enumerate(zip(plain, selected, strict=True))]


def pivot_features(features: DataFrame, selected: list[tuple[int, int, str]], names: list[str]) -> DataFrame:
    """One row a key with the selected (table_index, key_col_index, feature) as columns: one aggregate for all."""
    at = lambda t, k, f: (F.col("table_index") == t) & (F.col("key_col_index") == k) & (F.col("feature") == f)
    hit = F.lit(False)
    for s in selected:
        hit = hit | at(*s)
    return features.where(hit).groupBy("key").agg(*[F.max(F.when(at(*s), F.col("value"))).alias(n) for s, n in zip(selected, names, strict=True)])


def augment(query: DataFrame, key: str, features: DataFrame, selected: list[tuple[int, int, str]], names: list[str]) -> DataFrame:
    """The query table with the selected features; keys without a match have nulls. One left join, whatever is selected."""
    if not selected:
        return query
    wide = pivot_features(features, selected, names).withColumnRenamed("key", "__key")
    return query.join(wide, F.col(key).cast("string") == F.col("__key"), "left").drop("__key")
