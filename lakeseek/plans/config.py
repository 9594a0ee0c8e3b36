"""What may be combined: tasks, rankings, strategies, models and their parameters; and where the index lies."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from lakeseek.plans.errors import ConfigValidationError
from lakeseek.plans.proxy import CLASSIFICATION_METRICS, REGRESSION_METRICS

# Strategies that follow each ranking; None is a ranking alone. The rankings not named can't be combined.
SEARCHES = {
    "regression": {
        "passthrough": [None, "LassoFeatureSelector", "IncrementalSelection", "ForwardSelection"],
        "joinability": ["IncrementalSelection"],
        "correlation": [None, "BackwardElimination", "LassoFeatureSelector"],
    },
    "classification": {
        "passthrough": [None, "LassoFeatureSelector", "IncrementalSelection", "ForwardSelection"],
        "joinability": ["IncrementalSelection"],
        "eta": [None, "BackwardElimination", "LassoFeatureSelector"],
    },
    "regression explanation": {"correlation": [None]},
    "classification explanation": {"eta": [None]},
    "imputation": {"passthrough": ["IterativeImputer"]},
}
# Models of each strategy and task.
MODELS = {
    "LassoFeatureSelector": {"regression": ["LinRegL1"], "classification": ["LogRegL1"]},
    "IncrementalSelection": {"regression": ["RegressionQR", "RegressionCholesky"], "classification": ["ClassificationCholesky"]},
    "ForwardSelection": {"regression": ["RegressionQR", "RegressionCholesky", "IncrementalRegressionFGS"], "classification": ["ClassificationCholesky", "RegressionQR"]},
    "BackwardElimination": {"regression": ["RegressionQR", "RegressionCholesky", "IncrementalRegressionFGS"], "classification": ["ClassificationCholesky", "RegressionQR"]},
    "IterativeImputer": {"imputation": ["WeightedSum"]},
}
_METRICS = REGRESSION_METRICS + CLASSIFICATION_METRICS
_is_positive = lambda x: isinstance(x, float) and x > 0
# Parameters of each strategy: what a value must satisfy, and its description. A "?" marks optional ones.
PARAMETERS = {
    "LassoFeatureSelector": {
        "metric": (lambda x: x in ("mse", "r2", "f1", "f1_weighted"), "mse, r2, f1 or f1_weighted"),
        "alphas": (lambda x: isinstance(x, list) and x and all(isinstance(a, (int, float)) for a in x), "a list of numbers"),
        "cv": (lambda x: isinstance(x, int) and x > 1, "an integer above 1"),
    },
    "IncrementalSelection": {
        "metric": (lambda x: x in _METRICS, f"one of {_METRICS}"),
        "table_batch_size": (lambda x: isinstance(x, int) and x > 0, "a positive integer"),
        "tol": (_is_positive, "a positive float"),
    },
    "ForwardSelection": {
        "metric": (lambda x: x in _METRICS, f"one of {_METRICS}"),
        "tol": (_is_positive, "a positive float"),
        "?polynomial_features": (lambda x: isinstance(x, Mapping) and x.get("degree", 2) >= 2, "a mapping with degree >= 2"),
        "?dummify_features": (lambda x: isinstance(x, Mapping) and x.get("n_bins", 4) >= 2, "a mapping with n_bins >= 2"),
    },
    "BackwardElimination": {
        "metric": (lambda x: x in _METRICS, f"one of {_METRICS}"),
        "tol": (_is_positive, "a positive float"),
        "?polynomial_features": (lambda x: isinstance(x, Mapping) and x.get("degree", 2) >= 2, "a mapping with degree >= 2"),
    },
    "IterativeImputer": {
        "tol": (_is_positive, "a positive float"),
        "n_iterations": (lambda x: isinstance(x, int) and x > 0, "a positive integer"),
    },
}


@dataclass
class DiscoveryConfig:
    """A checked combination; with ``baseline`` only ``params`` are given, for one of the other augmenters."""

    task: str | None = None
    ranking: str | None = None
    strategy: str | None = None
    model: str | None = None
    params: dict[str, Any] = field(default_factory=dict)
    baseline: bool = False

    def __post_init__(self) -> None:
        if self.baseline:
            if any((self.task, self.ranking, self.strategy, self.model)):
                raise ConfigValidationError("a baseline takes parameters only")
            return
        if self.task not in SEARCHES:
            raise ConfigValidationError(f"task {self.task!r} is none of {sorted(SEARCHES)}")
        rankings = SEARCHES[self.task]
        if self.ranking not in rankings:
            raise ConfigValidationError(f"ranking {self.ranking!r} doesn't go with {self.task}; use one of {sorted(rankings)}")
        if self.strategy not in rankings[self.ranking]:
            raise ConfigValidationError(f"strategy {self.strategy!r} doesn't go with ranking {self.ranking}; use one of {rankings[self.ranking]}")
        if self.strategy is None:
            return
        allowed = MODELS[self.strategy].get(self.task, [])
        if self.model not in allowed:
            raise ConfigValidationError(f"model {self.model!r} doesn't go with {self.strategy}; use one of {allowed}")
        for name, (fits, what) in PARAMETERS[self.strategy].items():
            optional, name = name.startswith("?"), name.lstrip("?")
            if name not in self.params:
                if not optional:
                    raise ConfigValidationError(f"{self.strategy} needs the parameter {name}")
            elif not fits(self.params[name]):
                raise ConfigValidationError(f"parameter {name} must be {what}, got {self.params[name]!r}")


def valid_options(task: str, ranking: str | None = None, strategy: str | None = None) -> list:
    """What may be chosen next: rankings of a task, strategies of a ranking, models of a strategy."""
    if task not in SEARCHES:
        raise ConfigValidationError(f"task {task!r} is none of {sorted(SEARCHES)}")
    if ranking is None:
        return sorted(SEARCHES[task])
    if strategy is None:
        return list(SEARCHES[task].get(ranking, []))
    return list(MODELS.get(strategy, {}).get(task, []))


@dataclass(frozen=True)
class EngineConfig:
    """Where indexes lie. An argument goes before LAKESEEK_ROOT, that before a JSON file, that before the default."""

    root: str = "lakeseek-index"

    @staticmethod
    def resolve(root: str | None = None, file: str | None = None) -> EngineConfig:
        stored: dict[str, Any] = json.loads(Path(file).read_text()) if file and Path(file).exists() else {}
        return EngineConfig(root or os.environ.get("LAKESEEK_ROOT") or stored.get("root") or EngineConfig.root)
