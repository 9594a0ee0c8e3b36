"""Query tables: preparing them, finding leaks of the target, measuring what features are worth."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeseek.functions.text import stored_key
from lakeseek.operators.gram import blocked_gram
from lakeseek.operators.materialize import bin_edges, bin_index
from lakeseek.operators.sampling import unit_hash

#: Columns with larger values hold sentinels.
SENTINEL = 1e17


def _codes(df: DataFrame, column: str, order: str) -> DataFrame:
    """(value, code): codes 0, 1 ... by first appearance in ``order``; a row a distinct value."""
    from pyspark.sql import Window

    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.min(order).alias("first"))
    return first.select("value", (F.row_number().over(Window.orderBy("first", "value")) - 1).cast("double").alias("code"))


def encode_by_appearance(df: DataFrame, column: str, order: str, fill_mode: bool) -> DataFrame:
    """The column as codes by first appearance; with ``fill_mode`` nulls get the most frequent code."""
    codes = _codes(df, column, order).withColumnRenamed("value", "__value")
    out = df.join(codes, F.col(column).cast("string") == F.col("__value"), "left")
    value: Column = F.col("code")
    if fill_mode:
        mode = out.agg(F.mode("code", True).alias("m"))
        value = F.coalesce(value, mode.scalar(), F.lit(0.0))
    return out.withColumn(column, value).drop("__value", "code")


def prepare_query_table(df: DataFrame, key: str, target: str, order: str, features: list[str] | None = None, task: str = "classification", n_bins: int | None = None) -> DataFrame:
    """Key (normalised), features (numbers without nulls), target, in this order; rows without key or target are out.

    Numbers: nulls and NaN become the median. Text: codes by first appearance in ``order`` (a column that orders rows,
    itself no feature), nulls the mode. Columns with values beyond 1e17 are dropped. Classes are coded the same way,
    regression targets are cast. ``n_bins`` turns features into quantile-bin indicators without the first bin.
    """
    if task not in ("classification", "regression"):
        raise ValueError(f"task {task!r} is neither classification nor regression")
    for c in (key, target):
        if c not in df.columns:
            raise KeyError(f"column {c!r} is not in the query table")
    features = [c for c in df.columns if c not in (key, target, order)] if features is None else features
    if missing := [c for c in features if c not in df.columns]:
        raise KeyError(f"feature columns not in the query table: {missing}")
    out = df.dropna(subset=[key, target])
    numeric = [f.name for f in df.schema if f.name in features and isinstance(f.dataType, T.NumericType)]
    for c in features:
        if c not in numeric:
            out = encode_by_appearance(out, c, order, True)
    cleaned = {c: F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double")) for c in numeric}
    out = out.withColumns(cleaned) if cleaned else out
    if numeric:
        medians = out.agg(*[F.median(c).alias(c) for c in numeric], *[F.max(F.abs(c)).alias(f"__max_{c}") for c in numeric]).first()
        if medians is None:
            raise ValueError("no rows left after dropping null keys and targets")
        numeric = [c for c in numeric if (medians[f"__max_{c}"] or 0) <= SENTINEL]
        out = out.fillna({c: medians[c] if medians[c] is not None else 0.0 for c in numeric})
    kept = [c for c in features if c in numeric or c not in cleaned]
    if task == "classification":
        out = encode_by_appearance(out, target, order, False)
    else:
        out = out.withColumn(target, F.col(target).cast("double"))
    if n_bins is not None:
        if n_bins < 2:
            raise ValueError(f"n_bins must be at least 2, got {n_bins}")
        binned = []
        for c in kept:
            edges = bin_edges(out, c, n_bins)
            at = bin_index(F.col(c), edges)
            binned += [(at == i).cast("double").alias(f"{c}_{i}") for i in range(1, len(edges) + 1)]
        return out.select(stored_key(F.col(key)).alias(key), *binned, target)
    return out.select(stored_key(F.col(key)).alias(key), *kept, target)


def clean_augmented(df: DataFrame, columns: list[str], rounds: int = 1) -> DataFrame:
    """Numeric columns of an augmented table made whole: infinite and sentinel values are nulls, nulls are predicted.

    A null becomes the prediction of a ridge regression on the other columns (filled with their medians); columns
    without any value are dropped. The regressions come from one Gram matrix.
    """
    masked = {c: F.when(F.isnan(F.col(f"`{c}`").cast("double")) | (F.abs(F.col(f"`{c}`").cast("double")) > SENTINEL), None).otherwise(F.col(f"`{c}`").cast("double")) for c in columns}
    df = df.withColumns(masked)
    med = df.agg(*[F.median(F.col(f"`{c}`")).alias(c) for c in columns]).first().asDict()
    gone = [c for c in columns if med[c] is None]
    columns = [c for c in columns if med[c] is not None]
    df = df.drop(*gone)
    for _ in range(rounds):
        filled = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(med[c])).alias(c) for c in columns])
        n, sums, m = blocked_gram(filled, columns).get("", (0.0, np.zeros(len(columns)), np.zeros((len(columns),) * 2)))
        if not n:
            return df
        mean = sums / n
        cov = m / n - np.outer(mean, mean)
        guess = {}
        for j, c in enumerate(columns):
            rest = [i for i in range(len(columns)) if i != j]
            b = np.linalg.solve(cov[np.ix_(rest, rest)] + 1e-6 * np.eye(len(rest)) * max(np.trace(cov) / len(columns), 1e-12), cov[rest, j]) if rest else np.zeros(0)
            value = F.lit(float(mean[j]))
            for i, coef in zip(rest, b, strict=True):
                value = value + F.lit(float(coef)) * (F.coalesce(F.col(f"`{columns[i]}`"), F.lit(med[columns[i]])) - F.lit(float(mean[i])))
            guess[c] = F.coalesce(F.col(f"`{c}`"), value)
        df = df.withColumns(guess)
    return df


def target_leaks(df: DataFrame, target: str, columns: list[str], corr: float = 0.99, r2: float = 0.999, impact: float = 0.01) -> list[str]:
    """Columns that give the target away, in the order found.

    As long as one correlates beyond ``corr`` the strongest goes. Then, if all together explain more than ``r2``, the
    columns go whose standardised coefficient is at least ``impact`` of the largest. One Gram matrix serves all steps.
    """
    usable = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in [*columns, target]]).dropna()
    got = blocked_gram(usable, [*columns, target]).get("")
    if not got or not got[0]:
        return []
    n, sums, m = got
    cov = m / n - np.outer(sums, sums) / n**2
    std = np.sqrt(np.clip(np.diag(cov), 0, None))
    if std[-1] <= 1e-12:
        return []
    live = [i for i in range(len(columns)) if std[i] > 1e-12]
    r = cov / np.outer(np.where(std > 1e-12, std, 1), np.where(std > 1e-12, std, 1))
    out: list[str] = []
    while live:
        strongest = max(live, key=lambda i: abs(r[i, -1]))
        if abs(r[strongest, -1]) > corr:
            out.append(columns[strongest])
            live.remove(strongest)
            continue
        b = np.linalg.lstsq(r[np.ix_(live, live)], r[live, -1], rcond=1e-10)[0]
        if b @ r[live, -1] <= r2:
            break
        size = np.abs(b)
        leaking = [i for i, s in zip(live, size, strict=True) if s >= impact * size.max()]
        out += [columns[i] for i in leaking]
        live = [i for i in live if i not in leaking]
    return out


def random_forest_score(df: DataFrame, features: list[str], target: str, row_id: str, task: str = "classification", trees: int = 20, depths: tuple[int, ...] = (5,), leaves: tuple[int, ...] = (10,), folds: int | None = None, seed: int = 42) -> dict[str, float]:
    """Hold-out quality of a random forest: r2 and rmse, or accuracy, weighted f1 and (two classes) roc_auc.

    ``folds`` cross-validates over ``depths`` and ``leaves`` on the training part; else their first values are used.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    clean = {c: f"f{i}" for i, c in enumerate(features)}
    rows = df.select(F.col(row_id).alias("id"), F.col(f"`{target}`").cast("double").alias("label"), *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(n) for c, n in clean.items()]).where(F.col("label").isNotNull())
    rows = VectorAssembler(inputCols=list(clean.values()), outputCol="features").transform(rows).select("id", "label", "features")
    h = unit_hash(F.col("id"))
    train, test = rows.where(h > 0.2), rows.where(h <= 0.2)
    kind = RandomForestClassifier if task == "classification" else RandomForestRegressor
    model = kind(numTrees=trees, maxDepth=depths[0], minInstancesPerNode=leaves[0], seed=seed)
    metric = MulticlassClassificationEvaluator(metricName="f1") if task == "classification" else RegressionEvaluator(metricName="r2")
    if folds:
        grid = ParamGridBuilder().addGrid(model.maxDepth, list(depths)).addGrid(model.minInstancesPerNode, list(leaves)).build()
        model = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=metric, numFolds=folds, seed=seed)
    scored = model.fit(train).transform(test)
    if task == "regression":
        return {m: RegressionEvaluator(metricName=m).evaluate(scored) for m in ("r2", "rmse")}
    out = {"accuracy": MulticlassClassificationEvaluator(metricName="accuracy").evaluate(scored), "f1_weighted": metric.evaluate(scored)}
    if rows.select("label").distinct().limit(3).count() == 2:
        out["roc_auc"] = BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(scored)
    return out


def evaluate_augmentation(base: DataFrame, augmented: DataFrame, key: str, target: str, row_id: str, task: str, trees: int = 20) -> dict[str, dict[str, float]]:
    """Quality before and after: clean, drop leaks of the target, score both tables the same way."""
    out = {}
    for name, df in (("base", base), ("augmented", augmented)):
        columns = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in (key, target, row_id)]
        if not columns:
            out[name] = {}
            continue
        df = clean_augmented(df, columns)
        columns = [c for c in columns if c in df.columns]
        leaks = set(target_leaks(df, target, columns))
        out[name] = random_forest_score(df, [c for c in columns if c not in leaks], target, row_id, task, trees)
    return out
