"""Proxy models on collected statistics: how good a set of features is, without rows. Higher is better.

Regression scores work on the standardised Gram matrix, classification scores on class means and covariances scaled by the
total deviation, so units play no part. All of it is small dense algebra on the driver.
"""

from __future__ import annotations

import numpy as np

from lakeseek.operators.gram import Gram

RIDGE = 1e-3
REGRESSION_METRICS = ["mse", "rmse", "gcv_rmse", "conditional_gcv", "r2", "adj_r2"]
CLASSIFICATION_METRICS = ["average_mahalanobis", "average_bhattacharyya", "robust_moment", "conditional_mahalanobis"]


def least_squares(g: np.ndarray, c: np.ndarray, method: str = "cholesky") -> np.ndarray:
    """Coefficients of the normal equations; singular systems raise ``numpy.linalg.LinAlgError``."""
    if not len(c):
        return np.zeros(0)
    if method == "qr":
        q, r = np.linalg.qr(g)
        if np.min(np.abs(np.diag(r))) <= np.finfo(float).eps * np.max(np.abs(np.diag(r))):
            raise np.linalg.LinAlgError("singular")
        return np.linalg.solve(r, q.T @ c)
    lower = np.linalg.cholesky(g)
    return np.linalg.solve(lower.T, np.linalg.solve(lower, c))


def collinear(g: np.ndarray, tolerance: float = 1e-4) -> list[int]:
    """Columns that depend on those before them: the triangular factor's diagonal falls below ``tolerance`` of its largest."""
    out: list[int] = []
    top = np.sqrt(max(np.max(np.diag(g)), 0)) if len(g) else 0.0
    left = np.array(g, float)  # what the columns kept so far leave of the others
    for j in range(len(g)):
        if not np.isfinite(left[j, j]) or np.sqrt(max(left[j, j], 0)) <= tolerance * top:
            out.append(j)
        else:
            left[j + 1 :, j + 1 :] -= np.outer(left[j + 1 :, j], left[j, j + 1 :] / left[j, j])
    return out


def lasso(g: np.ndarray, c: np.ndarray, lam: float, free: int = 0, steps: int = 1000, tol: float = 1e-9) -> np.ndarray:
    """Coordinate descent on the Gram matrix; the first ``free`` columns carry no penalty."""
    b = np.zeros(len(c))
    for _ in range(steps):
        moved = 0.0
        for j in range(len(c)):
            if g[j, j] <= 0:
                continue
            r = c[j] - g[j] @ b + g[j, j] * b[j]
            new = r / g[j, j] if j < free else np.sign(r) * max(abs(r) - lam, 0) / g[j, j]
            moved, b[j] = max(moved, abs(new - b[j])), new
        if moved < tol:
            break
    return b


class RegressionScorer:
    """Scores of base and selected columns plus each group of candidates, for a numeric target (the last column)."""

    method = "cholesky"

    def __init__(self, gram: Gram, metric: str = "conditional_gcv", ridge: float = RIDGE):
        if metric not in REGRESSION_METRICS:
            raise ValueError(f"metric {metric!r} is none of {REGRESSION_METRICS}")
        self.gram, self.metric, self.ridge = gram, metric, ridge
        c, self.std = gram.standardized()
        raw = gram.centred()
        self.g = c[:-1, :-1]
        self.c = raw[:-1, -1] / self.std[:-1]
        self.yy = raw[-1, -1]
        self.n = gram.n

    def _value(self, rss: np.ndarray, p: np.ndarray) -> np.ndarray:
        n, rss = self.n, np.maximum(rss, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.metric == "mse":
                return -rss / n
            if self.metric == "rmse":
                return -np.sqrt(rss / n)
            if self.metric == "gcv_rmse":
                return np.where(p < n, -np.sqrt(rss / n) / (1 - p / n), -np.inf)
            if self.metric == "conditional_gcv":
                return np.where(p < n, -(rss / n) / (1 - p / n) ** 2, -np.inf)
            r2 = 1 - rss / self.yy if self.yy > 0 else np.zeros_like(rss)
            return r2 if self.metric == "r2" else np.where(p < n - 1, 1 - (1 - r2) * (n - 1) / (n - p - 1), -np.inf)

    def _solve(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        try:
            return least_squares(a, b, self.method)
        except np.linalg.LinAlgError:  # base columns that depend on each other: any of their solutions will do
            return np.linalg.lstsq(a, b, rcond=None)[0]

    def score(self, have: list[int], groups: list[list[int]]) -> np.ndarray:
        """One score for each group added to ``have``; a group that makes the system singular gets minus infinity."""
        lam = self.ridge if self.metric == "conditional_gcv" else 0.0
        a = self.g[np.ix_(have, have)] + lam * np.eye(len(have))
        inv_c = self._solve(a, self.c[have]) if have else np.zeros(0)
        rss = self.yy - self.c[have] @ inv_c
        single = np.array([k for k, s in enumerate(groups) if len(s) == 1], int)
        out = np.full(len(groups), -np.inf)
        if len(single):
            z = np.array([groups[k][0] for k in single])
            cross = self._solve(a, self.g[np.ix_(have, z)]) if have else np.zeros((0, len(z)))
            own = np.diag(self.g)[z]
            rest = own - np.sum(self.g[np.ix_(have, z)] * cross, axis=0) + lam
            c = self.c[z] - self.c[have] @ cross
            fine = rest > np.maximum(1e-10 * np.maximum(own, 1), lam * 0.5)
            value = self._value(rss - c**2 / np.where(fine, rest, 1), np.full(len(z), len(have) + 1))
            out[single] = np.where(fine & (own > 0), value, -np.inf)
        for k, s in enumerate(groups):
            if len(s) != 1:
                out[k] = self.of([*have, *s])
        return out

    def of(self, columns: list[int]) -> float:
        """The score of a set of columns; the empty set is the mean alone."""
        lam = self.ridge if self.metric == "conditional_gcv" else 0.0
        g = self.g[np.ix_(columns, columns)] + lam * np.eye(len(columns))
        if columns and np.linalg.cond(g) > 1 / np.finfo(float).eps:
            return float("-inf")
        try:
            rss = self.yy - self.c[columns] @ least_squares(g, self.c[columns], self.method) if columns else self.yy
        except np.linalg.LinAlgError:
            return float("-inf")
        return float(self._value(np.array([rss]), np.array([len(columns)]))[0])

    def coefficients(self, columns: list[int]) -> np.ndarray:
        return least_squares(self.g[np.ix_(columns, columns)] + 1e-12 * np.eye(len(columns)), self.c[columns], self.method)


class QRScorer(RegressionScorer):
    """The same by QR decomposition of the normal equations, which bears worse conditions than Cholesky's."""

    method = "qr"


class IncrementalScorer(RegressionScorer):
    """The same by Gram-Schmidt on the Gram matrix: each selected column is swept out once, and a step only reads what is left.

    A step costs one pass over the matrix for each new column, however many columns are selected already.
    """

    def __init__(self, gram: Gram, metric: str = "conditional_gcv", ridge: float = RIDGE):
        super().__init__(gram, metric, ridge)
        self._restart()

    def _restart(self) -> None:
        self._swept: list[int] = []
        lam = self.ridge if self.metric == "conditional_gcv" else 0.0
        self._left, self._c, self._rss = self.g + lam * np.eye(len(self.g)), self.c.copy(), float(self.yy)
        self._own = np.diag(self._left).copy()

    def score(self, have: list[int], groups: list[list[int]]) -> np.ndarray:
        if self._swept != have[: len(self._swept)]:
            self._restart()
        for j in have[len(self._swept) :]:
            pivot = self._left[j, j]
            if pivot > 1e-10 * max(self._own[j], 1):
                row = self._left[j].copy()
                self._rss -= self._c[j] ** 2 / pivot
                self._c = self._c - row * (self._c[j] / pivot)
                self._left = self._left - np.outer(row, row / pivot)
            self._swept.append(j)
        out = np.full(len(groups), -np.inf)
        lam = self.ridge if self.metric == "conditional_gcv" else 0.0
        for k, s in enumerate(groups):
            if len(s) != 1:
                out[k] = self.of([*have, *s])
        single = np.array([k for k, s in enumerate(groups) if len(s) == 1], int)
        if len(single):
            z = np.array([groups[k][0] for k in single])
            rest, own = np.diag(self._left)[z], np.diag(self.g)[z]
            fine = (rest > np.maximum(1e-10 * np.maximum(own, 1), lam * 0.5)) & (own > 0)
            value = self._value(self._rss - self._c[z] ** 2 / np.where(fine, rest, 1), np.full(len(z), len(have) + 1))
            out[single] = np.where(fine, value, -np.inf)
        return out


class ClassScorer:
    """Scores for a target of classes: how far apart the classes lie in the given columns."""

    def __init__(self, gram: Gram, metric: str = "conditional_mahalanobis", ridge: float = RIDGE):
        if metric not in CLASSIFICATION_METRICS:
            raise ValueError(f"metric {metric!r} is none of {CLASSIFICATION_METRICS}")
        self.metric, self.ridge = metric, ridge
        _, std = gram.standardized()
        blocks = [b for b in gram.classes.values() if b.n > 0]
        self.counts = np.array([b.n for b in blocks])
        self.means = np.stack([b.sums / b.n / std for b in blocks])
        self.covs = np.stack([b.centred() / b.n / np.outer(std, std) for b in blocks])
        self.priors = self.counts / self.counts.sum()

    def score(self, have: list[int], groups: list[list[int]]) -> np.ndarray:
        if self.metric != "conditional_mahalanobis":
            return np.array([self.of([*have, *s]) for s in groups])
        start = self.of(have)
        return np.array([start + self._gain(have, s) for s in groups])

    def of(self, columns: list[int]) -> float:
        if not columns:
            return 0.0
        if self.metric == "conditional_mahalanobis":
            return self._gain([], columns)
        means, covs = self.means[:, columns], self.covs[np.ix_(range(len(self.covs)), columns, columns)]
        try:
            if self.metric == "average_mahalanobis":
                return self._mahalanobis(means, covs)
            if self.metric == "average_bhattacharyya":
                return self._bhattacharyya(means, covs)
            return self._moment_bound(means, covs)
        except np.linalg.LinAlgError:
            return float("-inf")

    def _gain(self, have: list[int], more: list[int]) -> float:
        """What ``more`` separates beyond ``have``: trace of (within, given have)^-1 (between, given have)."""
        pooled = np.tensordot(self.priors, self.covs, 1)
        shift = self.means - self.priors @ self.means
        within, d = pooled[np.ix_(more, more)], shift[:, more]
        if have:
            slope = np.linalg.solve(pooled[np.ix_(have, have)] + self.ridge * np.eye(len(have)), pooled[np.ix_(have, more)])
            within, d = within - pooled[np.ix_(more, have)] @ slope, d - shift[:, have] @ slope
        between = (d * self.priors[:, None]).T @ d
        value = float(np.trace(np.linalg.solve((within + within.T) / 2 + self.ridge * np.eye(len(more)), between)))
        return 0.0 if abs(value) < 1e-10 else value

    def _mahalanobis(self, means: np.ndarray, covs: np.ndarray) -> float:
        weight = np.maximum(self.counts - 1, 0)
        pooled = np.tensordot(weight / max(weight.sum(), 1), covs, 1)
        jitter = 1e-10
        for _ in range(10):
            try:
                lower = np.linalg.cholesky(pooled + (jitter if jitter > 1e-10 else 0) * np.eye(len(pooled)))
                break
            except np.linalg.LinAlgError:
                jitter *= 10
        else:
            raise np.linalg.LinAlgError("not positive definite")
        white = np.linalg.solve(lower, means.T).T
        gaps = [white[a] - white[b] for a in range(len(white)) for b in range(a)]
        return float(sum(g @ g for g in gaps))

    def _bhattacharyya(self, means: np.ndarray, covs: np.ndarray) -> float:
        total = 0.0
        for a in range(len(means)):
            for b in range(a):
                mid = (covs[a] + covs[b]) / 2
                sign, logdet = np.linalg.slogdet(np.stack([mid, covs[a], covs[b]]))
                if np.any(sign <= 0):
                    raise np.linalg.LinAlgError("not positive definite")
                gap = means[a] - means[b]
                total += gap @ np.linalg.solve(mid, gap) / 8 + (logdet[0] - (logdet[1] + logdet[2]) / 2) / 2
        return float(total)

    def _moment_bound(self, means: np.ndarray, covs: np.ndarray, shrink: float = 0.1) -> float:
        """1 - a bound of the error by one-sided Chebyshev inequalities at the best threshold, over pairs by priors."""
        risk = weights = 0.0
        for a in range(len(means)):
            for b in range(a):
                both = covs[a] + covs[b]
                floor = 1e-6 * max(np.trace(both) / (2 * len(both)), 1e-6)
                ca, cb = ((1 - shrink) * c + shrink * np.diag(np.diag(c)) + floor * np.eye(len(c)) for c in (covs[a], covs[b]))
                w = np.linalg.solve(ca + cb, means[b] - means[a])
                gap = float(w @ (means[b] - means[a]))
                pa = self.priors[a] / (self.priors[a] + self.priors[b])
                sa, sb = max(w @ ca @ w, 1e-12), max(w @ cb @ w, 1e-12)
                t = np.linspace(0, gap, 2049)
                pair = float(np.min(pa * sa / (sa + t**2) + (1 - pa) * sb / (sb + (gap - t) ** 2))) if gap > 1e-12 else min(pa, 1 - pa)
                weight = self.priors[a] * self.priors[b]
                risk, weights = risk + weight * min(max(pair, 0.0), 1.0), weights + weight
        return float(1 - risk / weights) if weights else 0.0


def scorer(gram: Gram, metric: str, model: str | None = None):
    """The scorer of a metric, by the named model of the registry if there is one for it."""
    if model:
        from lakeseek.plans.registry import models

        found = models.resolve(model)
        if isinstance(found, type) and issubclass(found, RegressionScorer if metric in REGRESSION_METRICS else ClassScorer):
            return found(gram, metric)
    return RegressionScorer(gram, metric) if metric in REGRESSION_METRICS else ClassScorer(gram, metric)
