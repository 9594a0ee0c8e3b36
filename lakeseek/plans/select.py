"""Search strategies over one collected Gram matrix: no Spark job runs inside a search."""

from __future__ import annotations

import csv
import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from lakeseek.plans.proxy import ClassScorer, RegressionScorer, collinear, lasso, scorer


@dataclass(frozen=True)
class Candidate:
    """Columns of the Gram matrix that are accepted together; ``family`` is shared by the aggregates of one column."""

    name: str
    columns: tuple[int, ...]
    family: tuple


@dataclass
class Budget:
    """Wall clock of an anytime search, asked between iterations."""

    seconds: float | None = None
    clock: Callable[[], float] = time.monotonic
    started: float = field(init=False)

    def __post_init__(self) -> None:
        self.started = self.clock()

    def spent(self) -> float:
        return self.clock() - self.started

    def over(self) -> bool:
        return self.seconds is not None and self.spent() >= self.seconds


class Trajectory:
    """One CSV row an iteration, on disk before the next begins; an earlier file is cut."""

    def __init__(self, path: str | None):
        self.path = path
        if path:
            with open(path, "w", newline="") as f:
                csv.writer(f).writerow(["iter", "t_s", "n_features", "features_json", "extra_json"])

    def add(self, iteration: int, seconds: float, features: list[str], extra: dict) -> None:
        if self.path:
            with open(self.path, "a", newline="") as f:
                csv.writer(f).writerow([iteration, f"{seconds:.6f}", len(features), json.dumps(features), json.dumps(extra)])
                f.flush()
                os.fsync(f.fileno())


@dataclass
class Selection:
    """What a search accepted, in order, with the score after each step and all scores of each iteration."""

    accepted: list[Candidate] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    base_score: float | None = None
    history: list[dict] = field(default_factory=list)
    expired: bool = False

    def names(self) -> list[str]:
        return [c.name for c in self.accepted]


def write_history(selection: Selection, path: str) -> None:
    """All scores of all iterations as CSV, and beside it (``.json``) what was accepted with its scores."""
    with open(path, "w", newline="") as f:
        w = csv.DictWriter(f, ["iteration", "candidate", "score", "rank", "chosen"])
        w.writeheader()
        w.writerows(selection.history)
    with open(f"{path}.json", "w") as f:
        json.dump({"accepted": selection.names(), "scores": selection.scores, "base_score": selection.base_score, "expired": selection.expired}, f)


def _gain(new: float, old: float) -> float:
    return (new - old) / max(abs(old), 1e-12)


def forward(gram, candidates: list[Candidate], metric: str, tol: float = 0.05, budget: Budget | None = None, trajectory: Trajectory | None = None, require_gain: bool = False, max_features: int | None = None, model: str | None = None) -> Selection:
    """Greedy forward selection: accept the best candidate, drop its family, stop at a relative gain below
    tol / sqrt(pool + 1), at an empty pool or when the budget is spent.

    The first best candidate is accepted in any case unless ``require_gain``. Ties go to the earlier candidate.
    """
    s = scorer(gram, metric, model)
    base = list(range(gram.base))
    columns = lambda chosen: [*base, *(i for c in chosen for i in c.columns)]
    base_score = s.of(base) if isinstance(s, RegressionScorer) else None
    return greedy(lambda chosen, pool: s.score(columns(chosen), [list(c.columns) for c in pool]), candidates, base_score, tol, budget, trajectory, require_gain, max_features)


def greedy(score: Callable[[list[Candidate], list[Candidate]], np.ndarray], candidates: list[Candidate], base_score: float | None, tol: float = 0.05, budget: Budget | None = None, trajectory: Trajectory | None = None, require_gain: bool = False, max_features: int | None = None) -> Selection:
    """The loop of ``forward``; ``score`` gives one score for each candidate of the pool beside those chosen so far."""
    out, budget = Selection(base_score=base_score), budget or Budget()
    pool, last = list(candidates), base_score if require_gain else None
    while pool and not (max_features and len(out.accepted) >= max_features):
        if out.accepted and budget.over():
            out.expired = True
            break
        scores = score(out.accepted, pool)
        best = int(np.argmax(scores))
        out.history += [{"iteration": len(out.accepted), "candidate": c.name, "score": float(v), "rank": int(r), "chosen": k == best} for k, (c, v, r) in enumerate(zip(pool, scores, np.argsort(np.argsort(-scores, kind="stable"), kind="stable") + 1, strict=True))]
        if not np.isfinite(scores[best]):
            break
        if last is not None and _gain(scores[best], last) < tol / np.sqrt(len(pool) + 1):
            break
        chosen, last = pool[best], float(scores[best])
        out.accepted.append(chosen)
        out.scores.append(last)
        pool = [c for c in pool if c.family != chosen.family]
        if trajectory:
            trajectory.add(len(out.accepted), budget.spent(), out.names(), {"score": last})
    return out


def backward(gram, candidates: list[Candidate], metric: str, tol: float = 0.05, rule: str = "loss", budget: Budget | None = None, model: str | None = None) -> Selection:
    """Backward elimination from all independent candidates; base columns are never removed.

    ``rule='loss'``: stop when the best removal would lose more than tol / sqrt(size + 1) relatively.
    ``rule='reference'``: stop when the relative change exceeds minus that bound.
    """
    s, budget, out = scorer(gram, metric, model), budget or Budget(), Selection()
    base = list(range(gram.base))
    std, _ = gram.standardized()
    flat = [*base, *(i for c in candidates for i in c.columns)]
    bad = {flat[j] for j in collinear(std[np.ix_(flat, flat)])}
    kept = [c for c in candidates if not bad & set(c.columns)]
    if candidates and not kept:
        raise np.linalg.LinAlgError("all candidates are collinear")
    last = s.of([*base, *(i for c in kept for i in c.columns)])
    while kept and not budget.over():
        tries = [s.of([*base, *(i for k, c in enumerate(kept) if k != drop for i in c.columns)]) for drop in range(len(kept))]
        best = int(np.argmax(tries))
        gain, bound = _gain(tries[best], last), tol / np.sqrt(len(kept) + 1)
        if (rule == "loss" and gain < -bound) or (rule == "reference" and gain > -bound):
            break
        out.history.append({"iteration": len(out.history), "candidate": kept[best].name, "score": float(tries[best]), "rank": 1, "chosen": True})
        last = float(tries[best])
        kept.pop(best)
    out.accepted, out.scores, out.expired = kept, [last], budget.over()
    return out


def knee(values: list[float]) -> int:
    """How many of the descending values stand before the knee: the point farthest below the chord."""
    if len(values) < 3:
        return len(values)
    y = np.asarray(values, float)
    x = np.arange(len(y))
    span = y[0] - y[-1]
    if span <= 0:
        return len(y)
    return int(np.argmax((1 - x / x[-1]) - (y - y[-1]) / span)) + 1


def incremental(gram, candidates: list[Candidate], metric: str, tol: float = 0.05, table_batch_size: int = 1, budget: Budget | None = None, model: str | None = None) -> Selection:
    """Tables in batches, in the order of the candidates: of each batch the features before the knee of their absolute
    coefficients join the model if the score gains more than tol."""
    s, budget, out = scorer(gram, metric, model), budget or Budget(), Selection()
    have = list(range(gram.base))
    last = s.of(have)
    out.base_score = last
    tables = list(dict.fromkeys(c.family[:2] for c in candidates))
    std, _ = gram.standardized()
    for at in range(0, len(tables), table_batch_size):
        if out.accepted and budget.over():
            out.expired = True
            break
        batch = [c for c in candidates if c.family[:2] in tables[at : at + table_batch_size]]
        columns = [*have, *(i for c in batch for i in c.columns)]
        bad = {columns[j] for j in collinear(std[np.ix_(columns, columns)])}
        batch = [c for c in batch if not bad & set(c.columns)]
        if not batch:
            continue
        if isinstance(s, RegressionScorer):
            columns = [*have, *(i for c in batch for i in c.columns)]
            size = dict(zip(columns, np.abs(s.coefficients(columns)), strict=True))
            weight = [max(size[i] for i in c.columns) for c in batch]
        else:
            weight = list(s.score(have, [list(c.columns) for c in batch]))
        order = sorted(range(len(batch)), key=lambda k: -weight[k])
        chosen = [batch[k] for k in order[: knee([weight[k] for k in order])]]
        score = s.of([*have, *(i for c in chosen for i in c.columns)])
        if np.isfinite(score) and _gain(score, last) > tol:
            out.accepted += chosen
            out.scores.append(score)
            have, last = [*have, *(i for c in chosen for i in c.columns)], score
    return out


def lasso_selection(gram, candidates: list[Candidate], lambdas: list[float]) -> Selection:
    """Features with a non-zero coefficient at the penalty of the best generalised cross-validation score."""
    s = RegressionScorer(gram, "gcv_rmse")
    columns = [*range(gram.base), *(i for c in candidates for i in c.columns)]
    g, c = s.g[np.ix_(columns, columns)] / s.n, s.c[columns] / s.n
    best, out = -np.inf, Selection()
    for lam in lambdas:
        b = lasso(g, c, lam, gram.base)
        held = [i for i, v in zip(columns, b, strict=True) if abs(v) > 1e-12 or i < gram.base]
        score = s.of(held)
        if score > best:
            best, chosen = score, set(held)
            out = Selection([k for k in candidates if chosen & set(k.columns)], [score])
    return out


def rank_by_separation(gram, candidates: list[Candidate]) -> list[Candidate]:
    """Candidates by how far they alone separate the classes; all are kept."""
    scores = ClassScorer(gram).score([], [list(c.columns) for c in candidates])
    return [candidates[k] for k in np.argsort(-scores, kind="stable")]


def explanation(gram, candidates: list[Candidate]) -> list[tuple[str, float, bool]]:
    """(name, score, collinear) of each candidate, best first: |correlation| with a numeric target or the separation of
    classes, and whether it depends on the base and the better ones."""
    classes = bool(gram.classes)
    ranked = rank_by_separation(gram, candidates) if classes else rank_by_correlation(gram, candidates, 1.0)
    if classes:
        score = dict(zip((c.name for c in ranked), ClassScorer(gram).score([], [list(c.columns) for c in ranked]), strict=True))
    else:
        s = RegressionScorer(gram, "r2")
        score = {c.name: float(np.sqrt(max(s.of(list(c.columns)), 0))) for c in ranked}
    std, _ = gram.standardized()
    columns = [*range(gram.base), *(i for c in ranked for i in c.columns)]
    bad = {columns[j] for j in collinear(std[np.ix_(columns, columns)])}
    return [(c.name, float(score[c.name]), bool(bad & set(c.columns))) for c in ranked]


def rank_by_correlation(gram, candidates: list[Candidate], share: float = 0.9) -> list[Candidate]:
    """Candidates by absolute correlation with the target, the upper ``share`` of them."""
    s = RegressionScorer(gram, "r2")
    value = {c.name: max(abs(s.c[i]) / np.sqrt(max(s.yy * s.n, 1e-300)) for i in c.columns) for c in candidates}
    cut = np.quantile(list(value.values()), 1 - share) if value else 0.0
    return sorted((c for c in candidates if value[c.name] >= cut), key=lambda c: -value[c.name])
