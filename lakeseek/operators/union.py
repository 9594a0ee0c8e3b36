"""Union search: the lake table whose columns hold the same values as a given table's."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.operators.retrieval import PAIR


@dataclass(frozen=True)
class UnionPeer:
    """The best peer: which of its columns each query column goes with."""

    table_index: int
    table_name: str
    mapping: dict[str, str]
    coverage: float
    score: float


def stacked_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct (q_col, value) of the columns, as text; null values are out."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("q_col"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    return df.select(cells.alias("c")).select("c.*").where(F.col("value").isNotNull()).distinct()


def seek_keys(values: DataFrame, keys: DataFrame, exclude: list[int] | None = None) -> DataFrame:
    """(q_col, table_index, key_col_index, overlap): distinct keys of each pair that occur among a column's values."""
    keys = keys.where(~F.col("table_index").isin(exclude)) if exclude else keys
    hits = values.join(keys.withColumnRenamed("key", "value"), "value")
    return hits.groupBy("q_col", *PAIR).agg(F.count(F.lit(1)).alias("overlap"))


def seek_categories(values: DataFrame, cat_state: DataFrame, exclude: list[int] | None = None) -> DataFrame:
    """(q_col, table_index, r_col, overlap): distinct categories of each text column that occur among the values."""
    known = cat_state.select("table_index", F.col("col_name").alias("r_col"), F.col("category").alias("value")).distinct()
    known = known.where(~F.col("table_index").isin(exclude)) if exclude else known
    return values.join(known, "value").groupBy("q_col", "table_index", "r_col").agg(F.count(F.lit(1)).alias("overlap"))


def best_matching(weights: dict[tuple[str, str], float]) -> dict[str, str]:
    """The one-to-one assignment of query to peer columns with the greatest total weight (a few dozen columns).

    Augmenting by shortest paths over potentials; pairs without weight are never used.
    """
    left = sorted({a for a, _ in weights})
    right = sorted({b for _, b in weights})
    n, m = len(left), max(len(left), len(right))
    top = max(weights.values(), default=0.0)
    cost = [[top - weights.get((a, right[j]) if j < len(right) else ("", ""), 0.0) for j in range(m)] for a in left]
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, step, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    reduced = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if reduced < low[j]:
                        low[j], way[j] = reduced, j0
                    if low[j] < step:
                        step, j1 = low[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += step
                    v[j] -= step
                else:
                    low[j] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    pairs = {left[match[j] - 1]: right[j - 1] for j in range(1, len(right) + 1) if match[j]}
    return {a: b for a, b in pairs.items() if weights.get((a, b), 0) > 0}


def find_union_peer(hits: list[tuple[str, int, str, float]], tables: dict[int, tuple[str, int, int]], q_columns: int, q_rows: int, min_cols: float = 0.5, threshold: float = 0.0, top: int = 10) -> UnionPeer | None:
    """The best peer among ``hits`` (q_col, table_index, r_col, overlap), which are aggregates of a few rows a table.

    ``tables``: table_index to (name, columns, rows). The ``top`` tables by total overlap are matched; one needs coverage
    2 x matched / (columns of both) of ``min_cols`` and score (matched overlap) / (rows of both) of ``threshold``.
    """
    total: dict[int, float] = {}
    for _, t, _, n in hits:
        total[t] = total.get(t, 0) + n
    best: UnionPeer | None = None
    for t in sorted(total, key=lambda t: (-total[t], t))[:top]:
        weights: dict[tuple[str, str], float] = {}
        for q, table, r, n in hits:
            if table == t:
                weights[q, r] = max(weights.get((q, r), 0), n)
        mapping = best_matching(weights)
        name, columns, rows = tables[t]
        coverage = 2 * len(mapping) / (q_columns + max(columns, 1))
        score = sum(weights[p] for p in mapping.items()) / max(q_rows + rows, 1)
        if coverage >= min_cols and score >= threshold and (best is None or (score, coverage) > (best.score, best.coverage)):
            best = UnionPeer(t, name, mapping, coverage, score)
    return best
