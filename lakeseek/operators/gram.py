"""Gram matrices of a query table joined with features, from per-key statistics instead of joined rows.

With n, s = sum of x and y = sum of the target per key and one value z of a feature per key: X'Z = sum of s z,
Z'Z = sum of n z z', Z'y = sum of y z. The joined table never exists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def query_sketch(query: DataFrame, key: str, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Per key (and ``by``, such as the class): ``n``, ``sum_<c>`` and ``gram_<a>_<b>`` (a before or equal b)."""
    aggs = [F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("double")).alias(f"sum_{c}") for c in columns]]
    aggs += [F.sum(F.col(a).cast("double") * F.col(b)).alias(f"gram_{a}_{b}") for i, a in enumerate(columns) for b in columns[i:]]
    return query.groupBy(key, *(by or [])).agg(*aggs)


def gram_cells(df: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """``a``, ``b``, ``g`` = sum of weight * a * b for a few columns, in one aggregate without any Python."""
    w = F.col(weight) if weight else F.lit(1.0)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = df.agg(*[F.sum(w * F.col(a) * F.col(b)).alias(f"g{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"g{i}").alias("g")) for i, (a, b) in enumerate(pairs)])
    return sums.select(F.explode(cells).alias("c")).select("c.*")


@dataclass
class Gram:
    """Sums over the rows of the joined table: names of columns, n, sums and Gram matrix; ``base`` columns come first.

    The target is the last column for regression. ``classes`` has one such block per class for classification.
    """

    names: list[str]
    n: float
    sums: np.ndarray
    matrix: np.ndarray
    base: int
    classes: dict[object, Gram] = field(default_factory=dict)

    def centred(self) -> np.ndarray:
        return self.matrix - np.outer(self.sums, self.sums) / max(self.n, 1)

    def standardized(self) -> tuple[np.ndarray, np.ndarray]:
        """(centred Gram divided by the standard deviations, the deviations); a constant column has deviation 1 there."""
        c = self.centred()
        var = np.clip(np.diag(c) / max(self.n, 1), 0, None)
        tiny = var <= 1e-10 * np.maximum(1.0, np.diag(self.matrix) / max(self.n, 1))
        std = np.where(tiny, 1.0, np.sqrt(var))
        return c / np.outer(std, std), std


def _partials(width: int, columns: list[str]):
    """Per partition the weighted Gram of rows (1, columns...): n, sums and cross products are its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column(0).dictionary_encode()
            of = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            named = [*enumerate(codes.dictionary.to_pylist()), *([(-1, None)] if codes.null_count else [])]
            w = b.column(1).to_numpy(zero_copy_only=False)
            # sums of x and y are per key already: row = (n, s_1.., y) against z with weight n
            m = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[2:]])
            for code, label in named:
                at = of == code
                rows = np.column_stack([np.ones(at.sum()), m[at]])
                part = (rows * w[at, None]).T @ rows
                total[label] = total.get(label, 0) + part
        for label, t in total.items():
            n = len(t)
            yield pa.RecordBatch.from_arrays([pa.array([label] * n), pa.array(range(n), pa.int32()), pa.array(list(t), pa.list_(pa.float64()))], names=["label", "i", "row"])

    return run


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"label": [pdf["label"].iloc[0]], "i": [pdf["i"].iloc[0]], "row": [np.sum(np.stack(pdf["row"].to_numpy()), axis=0)]})


def blocked_gram(df: DataFrame, columns: list[str], weight: str | None = None, label: str | None = None) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """{label: (n, sums, matrix)} of many columns: one dense product per Arrow batch, one small matrix per partition.

    Shuffled are (columns + 1) rows a partition and label; collected is one matrix a label.
    """
    rows = df.select((F.col(label).cast("string") if label else F.lit("")).alias("label"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), *[F.col(f"`{c}`").cast("double") for c in columns])
    parts = rows.mapInArrow(_partials(len(columns), columns), "label string, i int, row array<double>")
    summed = parts.groupBy("label", "i").applyInPandas(_summed, "label string, i int, row array<double>").collect()
    out: dict[str, np.ndarray] = {}
    for r in summed:
        out.setdefault(r["label"], np.zeros((len(columns) + 1, len(columns) + 1)))[r["i"]] = r["row"]
    return {k: (m[0, 0], m[0, 1:], m[1:, 1:]) for k, m in out.items()}


def joined_gram(query: DataFrame, key: str, base: list[str], target: str | None, wide: DataFrame, candidates: list[str], label: str | None = None) -> Gram:
    """Gram of query rows left-joined with ``wide`` (one row per key, column ``key``); missing values are filled before.

    Only the base block needs query rows; all blocks with candidates come from per-key sums, so the product has one row
    a key. ``label``: column of classes, for a block per class.
    """
    own = [*base, *([target] if target else [])]
    by = [label] if label else []
    per_key = query_sketch(query, key, own, by)
    joined = per_key.join(wide.withColumnRenamed("key", "__key"), F.col(key).cast("string") == F.col("__key"), "left")
    # One row, in one job; as many subqueries would each read the table again.
    fills = wide.agg(*[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(candidates)]).first() if candidates else None
    joined = joined.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(fills[f"m{i}"]), F.lit(0.0)) for i, c in enumerate(candidates)})
    # Per key the mean of x stands for x in the products with z, which are exact, as z is the same in all rows of a key.
    means = {f"m_{c}": F.col(f"sum_{c}") / F.col("n") for c in own}
    blocks = blocked_gram(joined.withColumns(means), [*means, *candidates], "n", label)
    exact = per_key.groupBy(*([F.col(label).cast("string").alias("label")] if label else [F.lit("").alias("label")])).agg(*[F.sum(f"gram_{a}_{b}").alias(f"{a}|{b}") for i, a in enumerate(own) for b in own[i:]] or [F.count(F.lit(1)).alias("k")])
    true = {r["label"]: r.asDict() for r in exact.collect()}
    grams = {}
    order = [*range(len(base)), *range(len(own), len(own) + len(candidates)), *([len(base)] if target else [])]
    for k, (n, sums, m) in blocks.items():
        for i, a in enumerate(own):
            for j, b in enumerate(own[i:], i):
                m[i, j] = m[j, i] = true[k][f"{a}|{b}"]
        names = [*base, *candidates, *([target] if target else [])]
        grams[k] = Gram(names, n, sums[order], m[np.ix_(order, order)], len(base))
    if not label:
        return grams[""]
    total = Gram(names, sum(g.n for g in grams.values()), sum(g.sums for g in grams.values()), sum(g.matrix for g in grams.values()), len(base))
    total.classes = dict(sorted(grams.items()))
    return total
