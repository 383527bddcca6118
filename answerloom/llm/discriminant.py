"""Regularised quadratic discriminant analysis with cached Cholesky factors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def transformed(x: np.ndarray) -> np.ndarray:
    """Shares and ratios to a scale on which classes are nearer to Gaussian."""
    return np.log(np.maximum(x, 0) + 1e-2)


@dataclass
class Discriminant:
    """Means, Cholesky factors of the shrunk covariances and log terms of both classes; a slope and a shift to probabilities."""

    centre: np.ndarray
    scale: np.ndarray
    mean: tuple[np.ndarray, np.ndarray]
    factor: tuple[np.ndarray, np.ndarray]
    log_term: tuple[float, float]
    slope: float
    shift: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, from Mahalanobis distances."""
        z = (transformed(x) - self.centre) / self.scale
        density = []
        for mean, inverse, log_term in zip(self.mean, self.factor, self.log_term, strict=True):
            density.append(log_term - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(1))
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1. Differences pass through a root first, as tails are far heavier than Gaussian ones."""
        return 1 / (1 + np.exp(-np.clip(self.slope * compressed(self.difference(x)) + self.shift, -40, 40)))


def compressed(d: np.ndarray) -> np.ndarray:
    return np.sign(d) * np.log1p(np.abs(d))


def fit(x: np.ndarray, y: np.ndarray, to_pooled: float = 0.3, to_diagonal: float = 0.1) -> Discriminant:
    """Class covariances shrunk to the pooled one by ``to_pooled``, then to a multiple of the identity by ``to_diagonal``.

    The slope and shift that turn differences into probabilities are fitted by Newton steps on the same
    rows, with a weak prior. A class without rows has the other's moments, so scores are constant.
    """
    z = transformed(x)
    d = z.shape[1]
    centre = z.mean(0) if len(z) else np.zeros(d)
    scale = np.maximum(z.std(0), 1e-3) if len(z) else np.ones(d)
    z = (z - centre) / scale
    pooled, means, spreads = np.zeros((d, d)), [], []
    for k in (0, 1):
        own = z[y == k] if (y == k).any() else z
        means.append(own.mean(0) if len(own) else np.zeros(d))
        centred = own - means[-1]
        spreads.append(centred.T @ centred / max(len(own), 1))
        pooled += spreads[-1] * (len(own) / max(len(z), 1))
    inverses, logs = [], []
    for k in (0, 1):
        s = (1 - to_pooled) * spreads[k] + to_pooled * pooled
        s = (1 - to_diagonal) * s + to_diagonal * max(np.trace(s) / d, 1e-3) * np.eye(d)
        factor = np.linalg.cholesky(s)
        inverses.append(np.linalg.inv(factor))
        logs.append(-float(np.log(np.diag(factor)).sum()))
    model = Discriminant(centre, scale, tuple(means), tuple(inverses), tuple(logs), 0.0, 0.0)
    share = (y.sum() + 1) / (len(y) + 2)
    beta, features = np.array([0.0, np.log(share / (1 - share))]), np.column_stack([compressed(model.difference(x)), np.ones(len(x))]) if len(x) else np.empty((0, 2))
    prior = np.diag([0.1, 0.01])
    for _ in range(25 if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -40, 40)))
        step = np.linalg.solve(features.T @ (features * (p * (1 - p))[:, None]) + prior, features.T @ (y - p) - prior @ [beta[0], 0.0])
        beta = beta + np.clip(step, -2, 2)
    model.slope, model.shift = float(max(beta[0], 0.0)), float(beta[1])
    return model
