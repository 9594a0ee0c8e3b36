"""Names for models, strategies, augmenters and plan functions; entries may be imported on first use."""

from __future__ import annotations

from importlib import import_module
from typing import Any


class Registry:
    """Objects by name; ``module:attribute`` texts are imported when asked for."""

    def __init__(self, kind: str, entries: dict[str, Any] | None = None):
        self.kind, self._entries = kind, dict(entries or {})

    def register(self, name: str, entry: Any) -> None:
        self._entries[name] = entry

    def names(self) -> list[str]:
        return sorted(self._entries)

    def resolve(self, name: str) -> Any:
        if name not in self._entries:
            raise KeyError(f"unknown {self.kind} {name!r}; known: {', '.join(self.names())}")
        entry = self._entries[name]
        if isinstance(entry, str):
            module, _, attribute = entry.partition(":")
            try:
                entry = getattr(import_module(module), attribute)
            except ImportError as e:
                raise ImportError(f"{self.kind} {name!r} needs {e.name or module}") from e
            self._entries[name] = entry
        return entry


models = Registry("model", {
    "RegressionQR": "lakeseek.plans.proxy:QRScorer",
    "RegressionCholesky": "lakeseek.plans.proxy:RegressionScorer",
    "IncrementalRegressionFGS": "lakeseek.plans.proxy:IncrementalScorer",
    "ClassificationCholesky": "lakeseek.plans.proxy:ClassScorer",
    "LinRegL1": "lakeseek.plans.proxy:lasso",
    "LogRegL1": "pyspark.ml.classification:LogisticRegression",
})
strategies = Registry("strategy", {
    "ForwardSelection": "lakeseek.plans.select:forward",
    "BackwardElimination": "lakeseek.plans.select:backward",
    "IncrementalSelection": "lakeseek.plans.select:incremental",
    "LassoFeatureSelector": "lakeseek.plans.select:lasso_selection",
})
augmenters = Registry("augmenter", {
    "random_injection": "lakeseek.baselines.augmenters:random_injection",
    "path_search": "lakeseek.baselines.augmenters:path_search",
    "residual_r2": "lakeseek.baselines.augmenters:residual_r2",
    "label_sketch": "lakeseek.baselines.augmenters:label_sketch_augment",
    "rank_correlation": "lakeseek.baselines.augmenters:rank_correlation_augment",
    "profile_search": "lakeseek.baselines.augmenters:profile_search",
    "budgeted_joins": "lakeseek.baselines.augmenters:budgeted_joins",
})
