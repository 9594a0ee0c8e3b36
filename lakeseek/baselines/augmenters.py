"""Whole augmenters for comparison. All share a contract: ``run(query, key, target, tables, ...)`` gives an ``Outcome``.

``tables``: name to (DataFrame, key column). Candidate tables are joined one row a key, so query rows are never repeated.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeseek.baselines import statistics as st
from lakeseek.operators.gram import blocked_gram
from lakeseek.operators.hops import one_per_key
from lakeseek.operators.sampling import unit_hash

Tables = dict[str, tuple[DataFrame, str]]


@dataclass
class Outcome:
    """The augmented table, seconds spent on finding and on selecting, and what was selected with its score."""

    table: DataFrame
    discovery_s: float
    selection_s: float
    plan: list[tuple[str, float]] = field(default_factory=list)


def _numeric(df: DataFrame, but: list[str]) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in but]


def _left(query: DataFrame, key: str, name: str, df: DataFrame, right: str) -> DataFrame:
    one = one_per_key(df, right)
    one = one.toDF(*[f"{name}.{c}" for c in one.columns])
    return query.join(one, query[f"`{key}`"].cast("string") == one[f"`{name}.{right}`"].cast("string"), "left").drop(f"{name}.{right}")


def budgeted_joins(query: DataFrame, key: str, target: str, tables: Tables, max_columns: int = 100) -> Outcome:
    """Left joins in the order of the tables until the column budget is spent; generated code is never run."""
    began, plan = time.monotonic(), []
    for name, (df, right) in tables.items():
        if len(query.columns) + len(df.columns) - 1 > max_columns:
            continue
        query = _left(query, key, name, df, right)
        plan.append((name, float(len(df.columns) - 1)))
    return Outcome(query, time.monotonic() - began, 0.0, plan)


def random_injection(query: DataFrame, key: str, target: str, tables: Tables, row_id: str, task: str = "regression", share: float = 0.2, rounds: int = 3, thresholds: tuple[float, ...] = (0.3, 0.5, 0.7, 0.9), trees: int = 10) -> Outcome:
    """Features that a random forest ranks above injected random ones in enough of the rounds.

    Each round adds ``share`` times as many random columns and counts the real features ahead of the first of them; the
    threshold on the share of rounds is the one with the best hold-out score.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    from lakeseek.operators.prepare import random_forest_score

    began = time.monotonic()
    joined = budgeted_joins(query, key, target, tables, 10_000).table
    found = time.monotonic()
    names = _numeric(joined, [key, target, row_id])
    kind = RandomForestClassifier if task == "classification" else RandomForestRegressor
    wins = np.zeros(len(names))
    noise = max(1, round(share * len(names)))
    base = joined.select(F.col(row_id).alias("id"), F.col(f"`{target}`").cast("double").alias("label"), *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(names)]).where(F.col("label").isNotNull())
    for k in range(rounds):
        noisy = base.withColumns({f"r{j}": unit_hash(F.concat_ws("|", F.lit(f"{k}.{j}"), F.col("id"))) for j in range(noise)})
        inputs = [*(f"f{i}" for i in range(len(names))), *(f"r{j}" for j in range(noise))]
        model = kind(numTrees=trees, maxDepth=5, seed=42 + k).fit(VectorAssembler(inputCols=inputs, outputCol="features").transform(noisy).select("features", "label"))
        weight = model.featureImportances.toArray()
        wins += weight[: len(names)] > weight[len(names) :].max()
    best, chosen = -np.inf, []
    metric = "f1_weighted" if task == "classification" else "r2"
    tried: set[tuple[str, ...]] = set()
    for t in thresholds:
        kept = tuple(n for n, w in zip(names, wins, strict=True) if w / rounds >= t)
        if not kept or kept in tried:
            continue
        tried.add(kept)
        score = random_forest_score(joined, list(kept), target, row_id, task, trees)[metric]
        if score > best:
            best, chosen = score, list(kept)
    kept_columns = [*query.columns, *[c for c in chosen if c not in query.columns]]
    return Outcome(joined.select(*[F.col(f"`{c}`") for c in kept_columns]), found - began, time.monotonic() - found, [(c, float(w)) for c, w in zip(names, wins, strict=True) if c in chosen])


def path_search(query: DataFrame, key: str, target: str, tables: Tables, edges: list[tuple[str, str, str, str]], completeness: float = 0.5, top: int = 5, max_hops: int = 2) -> Outcome:
    """Breadth-first search over join paths: of each joined table the ``top`` features by rank correlation with the
    target, less their mean correlation with features taken before; tables with too few matches end a path.

    ``edges``: (from, from column, to, to column); the query is ``""``. Joins along a path add up.
    """
    began, plan, joined, frontier = time.monotonic(), [], query, [("", 0)]
    seen, taken = {""}, []
    while frontier:
        here, hops = frontier.pop(0)
        if hops == max_hops:
            continue
        for a, left, b, right in edges:
            if a != here or b in seen:
                continue
            column = left if a == "" else f"{a}.{left}"
            if column not in joined.columns:
                continue
            df, _ = tables[b]
            tried = _left(joined, column, b, df, right)
            new = [c for c in tried.columns if c.startswith(f"{b}.")]
            filled = tried.agg(F.avg(F.greatest(*[F.col(f"`{c}`").isNotNull().cast("double") for c in new], F.lit(0.0)))).first()[0] if new else 0.0
            if (filled or 0) < completeness:
                continue
            seen.add(b)
            joined = tried
            numbers = [c for c in _numeric(tried, []) if c in new]
            scores = {}
            for c in numbers:
                pair = tried.select(F.col(f"`{c}`").cast("double").alias("x"), F.col(f"`{target}`").cast("double").alias("y"))
                scores[c] = abs(st.spearman(pair, "x", "y").first()["rho"] or 0.0)
            for c in sorted(scores, key=lambda c: (-scores[c], c))[:top]:
                others = [abs(tried.agg(F.corr(F.col(f"`{c}`").cast("double"), F.col(f"`{o}`").cast("double"))).first()[0] or 0.0) for o in taken]
                score = scores[c] - (sum(others) / len(others) if others else 0.0)
                if score > 0:
                    taken.append(c)
                    plan.append((c, score))
            frontier.append((b, hops + 1))
    out = joined.select(*[F.col(f"`{c}`") for c in [*query.columns, *taken]])
    return Outcome(out, time.monotonic() - began, 0.0, sorted(plan, key=lambda p: (-p[1], p[0])))


def residual_r2(query: DataFrame, key: str, target: str, features: DataFrame, rounds: int = 3, least: float = 1e-3) -> Outcome:
    """Each round adds the feature that explains most of what the model so far leaves of the target.

    The residual is a column expression over the features taken before; per round there is one join and one aggregate.
    """
    from lakeseek.operators.materialize import friendly_names, pivot_features

    began, taken, plan = time.monotonic(), [], []
    rows = query.withColumn("__res", F.col(target).cast("double") - query.agg(F.avg(target).alias("m")).scalar())
    residual = rows
    for _ in range(rounds):
        scores = st.best_r2(residual, key, "__res", features)
        for t in taken:
            scores = scores.where(~((F.col("table_index") == t[0]) & (F.col("key_col_index") == t[1]) & (F.col("feature") == t[2])))
        best = scores.where(F.col("r2").isNotNull()).orderBy(F.desc("r2"), "table_index", "key_col_index", "feature").first()
        if best is None or best["r2"] < least:
            break
        taken.append((best["table_index"], best["key_col_index"], best["feature"]))
        plan.append((best["feature"], float(best["r2"])))
        names = [f"__z{i}" for i in range(len(taken))]
        wide = pivot_features(features, taken, names).withColumnRenamed("key", "__key")
        joined = rows.join(wide, F.col(key).cast("string") == F.col("__key"), "left").drop("__key")
        means = joined.agg(*[F.avg(n).alias(n) for n in names]).first()
        joined = joined.withColumns({n: F.coalesce(F.col(n), F.lit(means[n] or 0.0)) for n in names})
        n, sums, m = blocked_gram(joined.withColumn("__y", F.col(target).cast("double")), [*names, "__y"])[""]
        cov = m / n - np.outer(sums, sums) / n**2
        b = np.linalg.lstsq(cov[:-1, :-1], cov[:-1, -1], rcond=1e-10)[0]
        fit = sum((F.lit(float(c)) * (F.col(z) - F.lit(float(s / n))) for c, z, s in zip(b, names, sums[:-1], strict=True)), F.lit(float(sums[-1] / n)))
        residual = joined.withColumn("__res", F.col(target).cast("double") - fit)
    found = time.monotonic()
    from lakeseek.operators.materialize import augment

    known = {(r["table_index"], r["key_col_index"], r["feature"]): r["table_name"] for r in features.select("table_index", "key_col_index", "feature", "table_name").distinct().collect()}
    labels = friendly_names([(*t[:2], known[t], t[2]) for t in taken])
    return Outcome(augment(query, key, features, taken, labels), found - began, time.monotonic() - found, plan)


def label_sketch_augment(query: DataFrame, key: str, target: str, features: DataFrame, k: int = 5, size: int = 512) -> Outcome:
    """The ``k`` features whose sides agree (or disagree) most with the target's on the keys of its label sketch."""
    from lakeseek.operators.materialize import augment, friendly_names

    began = time.monotonic()
    asked = st.label_sketch(query, key, target, size)
    ids = ["table_index", "key_col_index", "feature"]
    means = features.groupBy(*ids).agg(F.avg("value").alias("m"))
    sides = features.join(means, ids).select(*ids, "key", F.signum(F.col("value") - F.col("m")).cast("int").alias("side"))
    top = st.label_hits(asked, sides, ids).orderBy(F.desc(F.greatest("same", "opposite")), *ids).limit(k).collect()
    found = time.monotonic()
    chosen = [tuple(r[i] for i in ids) for r in top]
    known = {(r["table_index"], r["key_col_index"], r["feature"]): r["table_name"] for r in features.select(*ids, "table_name").distinct().collect()}
    names = friendly_names([(*t[:2], known[t], t[2]) for t in chosen])
    return Outcome(augment(query, key, features, chosen, names), found - began, time.monotonic() - found, [(r["feature"], float(r["score"])) for r in top])


def rank_correlation_augment(query: DataFrame, key: str, target: str, tables: Tables, k_tables: int = 5, k_columns: int = 5) -> Outcome:
    """The tables that hold most query keys, then their columns with the greatest rank correlation (numbers) or
    one-hot correlation (text) with the target; unmatched rows take the middle rank."""
    began, hits = time.monotonic(), []
    asked = query.select(F.col(f"`{key}`").cast("string").alias("k")).where(F.col("k").isNotNull()).distinct()
    for name, (df, right) in tables.items():
        n = df.select(F.col(f"`{right}`").cast("string").alias("k")).distinct().join(asked, "k").count()
        hits.append((n, name))
    scores = []
    for _, name in sorted(hits, key=lambda h: (-h[0], h[1]))[:k_tables]:
        df, right = tables[name]
        joined = _left(query, key, name, df, right)
        for f in joined.schema:
            if not f.name.startswith(f"{name}."):
                continue
            pair = joined.select(F.col(f"`{f.name}`").alias("x"), F.col(f"`{target}`").cast("double").alias("y"))
            if isinstance(f.dataType, T.NumericType):
                ranked = st.average_rank(st.average_rank(pair, "x", "rx"), "y", "ry")
                middle = F.ceil(pair.agg(F.count("x").alias("n")).scalar() / 2)
                value = ranked.agg(F.corr(F.coalesce(F.col("rx"), middle.cast("double")), F.col("ry"))).first()[0]
            elif isinstance(f.dataType, T.StringType):
                value = st.onehot_correlations(pair, "x", "y").agg(F.max(F.abs("corr"))).first()[0]
            else:
                continue
            scores.append((f.name, abs(value or 0.0), name))
    found = time.monotonic()
    best = sorted(scores, key=lambda s: (-s[1], s[0]))[:k_columns]
    out = query
    for name in dict.fromkeys(s[2] for s in best):
        df, right = tables[name]
        keep = [right, *[s[0].removeprefix(f"{name}.") for s in best if s[2] == name]]
        out = _left(out, key, name, df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(keep)]), right)
    return Outcome(out, found - began, time.monotonic() - found, [(s[0], s[1]) for s in best])


def profile_search(query: DataFrame, key: str, target: str, tables: Tables, row_id: str, task: str = "regression", goal: float = 0.9, queries: int = 10, clusters: int = 4, trees: int = 10) -> Outcome:
    """Goal-oriented search: candidate columns are clustered by profile (name similarity, correlation, fill), an oracle
    (a random forest's hold-out score) is asked about the candidate with the best weighted profile of a cluster, and the
    profile weights follow the gains seen, by least squares. It stops at the goal or after so many questions."""
    from lakeseek.operators.prepare import random_forest_score

    began = time.monotonic()
    joined = budgeted_joins(query, key, target, tables, 10_000).table
    names = [c for c in _numeric(joined, [key, target, row_id]) if c not in query.columns]
    metric = "f1_weighted" if task == "classification" else "r2"
    stats = joined.agg(*[F.corr(F.col(f"`{c}`").cast("double"), F.col(f"`{target}`").cast("double")).alias(f"c{i}") for i, c in enumerate(names)], *[F.avg(F.col(f"`{c}`").isNotNull().cast("double")).alias(f"n{i}") for i, c in enumerate(names)]).first() if names else {}
    grams = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    similar = lambda a, b: len(grams(a) & grams(b)) / max(1, len(grams(a) | grams(b)))
    profiles = np.array([[similar(c.lower(), target.lower()), abs(stats[f"c{i}"] or 0.0), stats[f"n{i}"] or 0.0] for i, c in enumerate(names)]) if names else np.zeros((0, 3))
    found = time.monotonic()
    # k-centre clustering: each new centre is the profile farthest from all centres.
    centres = [0] if names else []
    while len(centres) < min(clusters, len(names)):
        centres.append(int(np.argmax(np.min(np.linalg.norm(profiles[:, None] - profiles[centres], axis=2), axis=1))))
    cluster = np.argmin(np.linalg.norm(profiles[:, None] - profiles[centres], axis=2), axis=1) if names else np.zeros(0, int)
    base = _numeric(query, [key, target, row_id])
    ask = lambda cols: random_forest_score(joined, cols, target, row_id, task, trees)[metric] if cols else 0.0
    have, score, weights, seen, gains, plan = list(base), ask(base), np.ones(3), [], [], []
    open_ = set(range(len(names)))
    worth = np.ones(max(len(centres), 1))
    while open_ and len(seen) < queries and score < goal:
        at = max(open_, key=lambda i: (worth[cluster[i]], profiles[i] @ weights, -i))
        open_.discard(at)
        new = ask([*have, names[at]])
        seen.append(profiles[at])
        gains.append(new - score)
        worth[cluster[at]] = 0.5 * worth[cluster[at]] + (1.0 if new > score else 0.0)
        if new > score:
            have, plan, score = [*have, names[at]], [*plan, (names[at], new - score)], new
        if len(seen) > 1:
            weights = np.linalg.lstsq(np.array(seen), np.array(gains), rcond=None)[0]
    kept = [*query.columns, *[c for c, _ in plan]]
    return Outcome(joined.select(*[F.col(f"`{c}`") for c in kept]), found - began, time.monotonic() - found, plan)
