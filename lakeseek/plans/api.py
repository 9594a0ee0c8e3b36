"""The facade: an index, and an augmenter that brings its features to a query table."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeseek.operators import hops
from lakeseek.operators import materialize as mat
from lakeseek.operators import retrieval as ret
from lakeseek.operators.gram import joined_gram
from lakeseek.plans import select
from lakeseek.plans.config import DiscoveryConfig
from lakeseek.plans.errors import EmptyAugmentation, KeyNotFoundError, UserTableHasDuplicates, UserTableNotProcessed
from lakeseek.plans.planner import PlanStep, execute
from lakeseek.sources.shared import materialize

log = logging.getLogger(__name__)
# Model, metric, tolerance and pruning threshold of each task unless others are given.
DEFAULTS = {
    "classification": {"model": "ClassificationCholesky", "metric": "conditional_mahalanobis", "tol": 0.05, "threshold": 0.3},
    "regression": {"model": "RegressionCholesky", "metric": "conditional_gcv", "tol": 0.05, "threshold": 0.1},
}
#: Most columns of one Gram matrix in a forward selection (doubles: 5,000 are 200 MB); more candidates are scored in blocks.
MAX_COLUMNS = 5_000


@dataclass
class AugmentationResult:
    """The augmented table, the selected features in order, the steps that ran, and the seconds it took."""

    table: DataFrame
    plan: list[dict[str, Any]]
    runtime_seconds: float
    steps: list[PlanStep] = field(default_factory=list)

    @property
    def n_selected(self) -> int:
        return len(self.plan)

    def __iter__(self) -> Iterator:
        return iter((self.table, self.plan))


def check_query(query: DataFrame, key: str, target: str) -> list[str]:
    """The base features of a prepared query table; raises if it isn't prepared."""
    if len(set(query.columns)) != len(query.columns):
        raise UserTableHasDuplicates("repeated column names")
    if missing := [c for c in (key, target) if c not in query.columns]:
        raise UserTableNotProcessed(f"columns {missing} are missing")
    base = [c for c in query.columns if c not in (key, target)]
    if bad := [f.name for f in query.schema if f.name in [*base, target] and not isinstance(f.dataType, T.NumericType)]:
        raise UserTableNotProcessed(f"columns {bad} aren't numbers; prepare the table first")
    return base


def l1_classes(query: DataFrame, key: str, target: str, base: list[str], wide: DataFrame, names: list[str], alphas: list[float], folds: int) -> dict[str, float]:
    """Candidate columns with a non-zero coefficient in an L1 logistic regression over the joined rows, and its size.

    The penalty is cross-validated; missing values are the column's mean; Spark standardises the columns.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    joined = query.join(wide.withColumnRenamed("key", "__key"), F.col(key).cast("string") == F.col("__key"), "left")
    inputs = {c: f"f{i}" for i, c in enumerate([*base, *names])}
    means = joined.agg(*[F.avg(f"`{c}`").alias(f) for c, f in inputs.items()]).first()
    rows = joined.select(F.col(target).cast("double").alias("label"), *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(means[f] or 0.0)).alias(f) for c, f in inputs.items()])
    rows = VectorAssembler(inputCols=list(inputs.values()), outputCol="features").transform(rows).select("label", "features")
    model = LogisticRegression(elasticNetParam=1.0, maxIter=50)
    grid = ParamGridBuilder().addGrid(model.regParam, alphas).build()
    found = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="f1"), numFolds=folds, seed=42).fit(rows).bestModel
    size = abs(found.coefficientMatrix.toArray()).max(axis=0)
    return {c: float(v) for c, v in zip(inputs, size, strict=True) if c in names and v > 1e-9}


@dataclass
class Augmenter:
    """Finds joinable tables, prunes, scores from statistics, selects greedily, joins the winners once.

    ``threshold=None`` turns pruning off; ``...`` stands for the task's default. With ``max_hops`` above 1 and the ``bridges``
    of the lake (keys that stand in one source row), tables that are reached through others are candidates as well.
    """

    features: DataFrame
    task: str = "classification"
    top_k: int = 20
    metric: str | None = None
    tol: float | None = None
    strategy: str = "ForwardSelection"
    threshold: Any = ...
    budget_seconds: float | None = None
    exclude_tables: list[str] | None = None
    features_stop_list: dict[str, list[str]] | None = None
    prune_mode: str = "abs"
    trajectory: str | None = None
    history: str | None = None
    params: dict[str, Any] = field(default_factory=dict)
    model: str | None = None
    max_hops: int = 1
    bridges: DataFrame | None = None
    reach: float = 0.5

    def __post_init__(self) -> None:
        if self.task not in DEFAULTS:
            raise ValueError(f"task {self.task!r} is none of {sorted(DEFAULTS)}")
        d = DEFAULTS[self.task]
        self.metric, self.tol = self.metric or d["metric"], float(self.tol if self.tol is not None else d["tol"])
        self.model = self.model or d["model"]
        self.threshold = d["threshold"] if self.threshold is ... else self.threshold
        if self.max_hops > 1 and self.bridges is None:
            raise ValueError("more than one hop needs the bridges of the lake")

    def config(self) -> DiscoveryConfig:
        if self.strategy == "LassoFeatureSelector":
            model, metric = ("LinRegL1", "mse") if self.task == "regression" else ("LogRegL1", "f1_weighted")
            self.params = {"metric": metric, "alphas": [0.001, 0.01, 0.1], "cv": 3} | self.params
            return DiscoveryConfig(self.task, "passthrough", self.strategy, model, self.params)
        ranking = "passthrough" if self.strategy in ("ForwardSelection", "IncrementalSelection") else "correlation" if self.task == "regression" else "eta"
        params = {"metric": self.metric, "tol": self.tol} | ({"table_batch_size": 1} if self.strategy == "IncrementalSelection" else {}) | self.params
        return DiscoveryConfig(self.task, ranking, self.strategy, self.model, params)

    # -- steps ------------------------------------------------------------------------------------------------------

    def reachable_features(self, query: DataFrame, key: str) -> DataFrame:
        """The features of the lake; those of tables reached over further joins in terms of the query's keys, as means."""
        if self.max_hops == 1:
            return self.features
        reached = hops.join_graph(self.bridges, ret.lake_keys(self.features), query, key, self.reach, self.max_hops)
        far = reached.where("hop > 1").select(*ret.PAIR, "key", "root")
        near = self.features.join(far.select(*ret.PAIR).distinct(), ret.PAIR, "left_anti")
        return materialize(near.unionByName(hops.root_features(self.features, far), allowMissingColumns=True), "reachable")

    def _over_hops(self, query: DataFrame, key: str) -> Augmenter:
        """This augmenter on the features that the query reaches; then one join brings any of them."""
        return self if self.max_hops == 1 else replace(self, features=self.reachable_features(query, key), max_hops=1)

    def _hits(self, query: DataFrame, key: str) -> DataFrame:
        excluded = ret.resolve_tables(self.features.select("table_index", "table_name").distinct(), self.exclude_tables) if self.exclude_tables else None
        hits = ret.overlap_topk(ret.lake_keys(self.features), query, self.top_k, key, excluded)
        rows = hits.collect()  # at most top_k rows
        if not rows:
            raise KeyNotFoundError("no lake table holds a key of the query")
        return query.sparkSession.createDataFrame(rows, hits.schema)

    def _pruned(self, hits: DataFrame, query: DataFrame, key: str, target: str) -> DataFrame:
        got = ret.fetch(ret.stop_features(self.features, self.features_stop_list or {}), hits, query, key)
        if self.threshold is None:
            return materialize(got, "fetched")
        whole = self.features.join(F.broadcast(hits.select(*ret.PAIR)), ret.PAIR, "left_semi")
        scores = ret.side_scores(whole, query, key, target, self.prune_mode) if self.task == "regression" else ret.eta_squared(got, query, key, target)
        return materialize(ret.prune(got, scores, self.threshold), "fetched")

    def _known(self, fetched: DataFrame) -> list:
        """What is known of each candidate feature."""
        known = fetched.groupBy("table_index", "key_col_index", "table_name", "feature", "base_col").agg(F.count(F.lit(1)).alias("n")).orderBy("table_index", "key_col_index", "feature").collect()
        if not known:
            raise EmptyAugmentation("no feature survived pruning")
        return known

    def _candidates(self, fetched: DataFrame, known: list) -> tuple:
        """A row a key with all columns of the candidates: values, powers, bin indicators."""
        ids = [(r["table_index"], r["key_col_index"], r["feature"]) for r in known]
        wide = mat.pivot_features(fetched, ids, [f"z{i}" for i in range(len(ids))])
        columns, names = [[f"z{i}"] for i in range(len(ids))], [f"z{i}" for i in range(len(ids))]
        for i in range(len(ids)):
            for k in range(2, self._degree() + 1):
                wide = wide.withColumn(f"z{i}p{k}", F.pow(f"z{i}", F.lit(float(k))))
                columns[i].append(f"z{i}p{k}")
                names.append(f"z{i}p{k}")
        edges = self._edges(wide, len(ids))
        bins = {i: [f"z{i}b{j}" for j in range(1, len(e) + 1)] for i, e in edges.items()}
        for i, e in edges.items():
            at = mat.bin_index(F.col(f"z{i}"), e)
            wide = wide.withColumns({n: (at == j).cast("double") for j, n in enumerate(bins[i], 1)})
            names += bins[i]
        return ids, columns, names, wide, edges, bins

    def _scored(self, query: DataFrame, key: str, target: str, base: list[str], known: list, columns: list[list[str]], names: list[str], wide: DataFrame, bins: dict[int, list[str]]) -> tuple:
        """The one Gram matrix of a search, and the candidates as its columns."""
        label = target if self.task == "classification" else None
        gram = joined_gram(query, key, base, None if label else target, wide, names, label)
        place = {n: len(base) + i for i, n in enumerate(names)}
        family = [(r["table_index"], r["key_col_index"], r["base_col"]) for r in known]
        candidates = [select.Candidate(str(i), tuple(place[c] for c in columns[i]), family[i]) for i in range(len(known))]
        candidates += [select.Candidate(f"{i}=dummies", tuple(place[c] for c in b), family[i]) for i, b in bins.items()]
        return gram, candidates

    def explain(self, query: DataFrame, key: str, target: str) -> DataFrame:
        """(table_name, feature, score, collinear) of all features that survive pruning, best first; selects nothing."""
        base = check_query(query, key, target)
        self = self._over_hops(query, key)
        DiscoveryConfig(f"{self.task} explanation", "correlation" if self.task == "regression" else "eta")
        fetched = self._pruned(self._hits(query, key), query, key, target)
        known = self._known(fetched)
        _, columns, names, wide, _, bins = self._candidates(fetched, known)
        gram, candidates = self._scored(query, key, target, base, known, columns, names, wide, bins)
        rows = [(known[int(n.partition("=")[0])]["table_name"], known[int(n.partition("=")[0])]["feature"] + ("=dummies" if "=" in n else ""), v, bad) for n, v, bad in select.explanation(gram, candidates)]
        return query.sparkSession.createDataFrame(rows, "table_name string, feature string, score double, collinear boolean")

    def _selected(self, fetched: DataFrame, query: DataFrame, key: str, target: str, base: list[str]) -> tuple[list[dict], select.Selection]:
        known = self._known(fetched)
        width = len(known) * (self._degree() + (self.params["dummify_features"].get("n_bins", 4) - 1 if self.params.get("dummify_features", {}).get("enabled") else 0))
        if self.strategy == "ForwardSelection" and width > MAX_COLUMNS:
            return self._forward_in_blocks(fetched, known, width, query, key, target, base)
        ids, columns, names, wide, edges, bins = self._candidates(fetched, known)
        label = target if self.task == "classification" else None
        if label and self.strategy == "LassoFeatureSelector":
            got = l1_classes(query, key, target, base, wide, names, self.params["alphas"], self.params["cv"])
            chosen = [i for i in range(len(ids)) if set(columns[i]) & set(got)]
            out = select.Selection([select.Candidate(str(i), (), ()) for i in chosen])
            return [known[i].asDict() | {"score": max(got[c] for c in columns[i] if c in got)} for i in chosen], out
        gram, candidates = self._scored(query, key, target, base, known, columns, names, wide, bins)
        budget = select.Budget(self.budget_seconds)
        if self.strategy == "BackwardElimination":
            candidates = select.rank_by_separation(gram, candidates) if label else select.rank_by_correlation(gram, candidates)
            out = select.backward(gram, candidates, self.metric, self.tol, budget=budget, model=self.model)
        elif self.strategy == "IncrementalSelection":
            out = select.incremental(gram, candidates, self.metric, self.tol, self.params.get("table_batch_size", 1), budget, self.model)
        elif self.strategy == "LassoFeatureSelector":
            out = select.lasso_selection(gram, candidates, self.params["alphas"])
        else:
            out = select.forward(gram, candidates, self.metric, self.tol, budget, select.Trajectory(self.trajectory), model=self.model)
        return self._plan(out, known, edges), out

    def _plan(self, out: select.Selection, known: list, edges: dict[int, list[float]]) -> list[dict]:
        if self.history:
            select.write_history(out, self.history)
        plan = []
        for c, score in zip(out.accepted, [*out.scores, *[None] * len(out.accepted)], strict=False):
            i, _, dummies = c.name.partition("=")
            plan.append(known[int(i)].asDict() | {"score": score, "edges": edges[int(i)] if dummies else None})
        return plan

    def _forward_in_blocks(self, fetched: DataFrame, known: list, width: int, query: DataFrame, key: str, target: str, base: list[str]) -> tuple[list[dict], select.Selection]:
        """Forward selection over more columns than one matrix may have: at every step one Gram matrix for each block of
        candidates beside the base columns and the chosen ones. The result is that of one matrix.
        """
        each = max(1, MAX_COLUMNS * len(known) // width)
        blocks = [range(at, min(at + each, len(known))) for at in range(0, len(known), each)]
        edges: dict[int, list[float]] = {}

        def of(places: list[int]) -> tuple:
            """The Gram matrix of these candidates, and its columns by name of the candidate."""
            part = [known[i] for i in places]
            _, columns, names, wide, some, bins = self._candidates(fetched, part)
            edges.update({places[i]: e for i, e in some.items()})
            gram, got = self._scored(query, key, target, base, part, columns, names, wide, bins)
            full = lambda n: f"{places[int(n.partition('=')[0])]}{''.join(n.partition('=')[1:])}"
            return gram, {full(c.name): c.columns for c in got}

        gram, first = of([*blocks[0]])
        s = select.scorer(gram, self.metric, self.model)
        base_score = s.of([*range(len(base))]) if self.task == "regression" else None
        family = [(r["table_index"], r["key_col_index"], r["base_col"]) for r in known]
        pool = [select.Candidate(n, (), family[int(n.partition("=")[0])]) for n in first]
        for b in blocks[1:]:
            pool += [select.Candidate(n, (), family[int(n.partition("=")[0])]) for n in of([*b])[1]]
        pool.sort(key=lambda c: ("=" in c.name, int(c.name.partition("=")[0])))

        def score(chosen: list[select.Candidate], pool: list[select.Candidate]) -> np.ndarray:
            have = sorted({int(c.name.partition("=")[0]) for c in chosen})
            out: dict[str, float] = {}
            for b in blocks:
                asked = [c.name for c in pool if int(c.name.partition("=")[0]) in b]
                if asked:
                    gram, columns = of([*have, *(i for i in b if i not in have)])
                    taken = [*range(len(base)), *(i for c in chosen for i in columns[c.name])]
                    out |= dict(zip(asked, select.scorer(gram, self.metric, self.model).score(taken, [list(columns[n]) for n in asked]), strict=True))
            return np.array([out[c.name] for c in pool])

        out = select.greedy(score, pool, base_score, self.tol, select.Budget(self.budget_seconds), select.Trajectory(self.trajectory))
        return self._plan(out, known, edges), out

    def _degree(self) -> int:
        p = self.params.get("polynomial_features", {})
        return p.get("degree", 2) if p.get("enabled") else 1

    def _edges(self, wide: DataFrame, n: int) -> dict[int, list[float]]:
        """Inner quantile edges of each candidate, if bin indicators are asked for: one aggregate for all."""
        p = self.params.get("dummify_features", {})
        if not p.get("enabled"):
            return {}
        qs = F.array(*[F.lit(k / p.get("n_bins", 4)) for k in range(1, p.get("n_bins", 4))])
        row = wide.agg(*[F.percentile(f"z{i}", qs).alias(f"z{i}") for i in range(n)]).first()
        return {i: e for i in range(n) if (e := sorted(set(row[f"z{i}"] or [])))}

    def _joined(self, fetched: DataFrame, chosen: tuple[list[dict], select.Selection], query: DataFrame, key: str) -> DataFrame:
        plan = chosen[0]
        ids = [(p["table_index"], p["key_col_index"], p["feature"]) for p in plan]
        names = mat.friendly_names([(p["table_index"], p["key_col_index"], p["table_name"], p["feature"]) for p in plan])
        out = mat.augment(query, key, fetched, ids, names)
        for name, p in zip(names, plan, strict=True):
            if p.get("edges"):
                at = mat.bin_index(F.col(f"`{name}`"), p["edges"])
                out = out.withColumns({f"{name}=bin_{j}": (at == j).cast("double") for j in range(1, len(p["edges"]) + 1)}).drop(name)
            elif self._degree() > 1:
                out = mat.power_columns(out, name, self._degree())
        return out

    def augment(self, query: DataFrame, key: str, target: str, debug: bool = False) -> AugmentationResult:
        """The query table with the selected features. On a failure the table as it was and an empty plan; with
        ``debug`` the error."""
        began = time.monotonic()
        steps: list[PlanStep] = []
        try:
            base = check_query(query, key, target)
            self.config()
            self = self._over_hops(query, key)
            steps = [
                PlanStep("find_joinable_tables", lambda: self._hits(query, key)),
                PlanStep("prune_features", lambda hits: self._pruned(hits, query, key, target), ("find_joinable_tables",)),
                PlanStep("select_features", lambda got: self._selected(got, query, key, target, base), ("prune_features",)),
                PlanStep("augment", lambda got, chosen: self._joined(got, chosen, query, key), ("prune_features", "select_features")),
            ]
            done = execute(steps)
            return AugmentationResult(done["augment"], done["select_features"][0], time.monotonic() - began, steps)
        except Exception as e:
            if debug:
                raise
            log.error("discovery failed: %s", e)
            return AugmentationResult(query, [], time.monotonic() - began, steps)
