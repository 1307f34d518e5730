"""Small decision trees in numpy for bounded training samples, and their form as Spark columns.

A tree is a leaf ``{"value": v}`` or a split ``{"feature", "at", "low", "high"}``: low holds the rows with
feature <= at. NaN never occurs: callers fill in features.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BINS = 48


def cuts(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Candidate split values of each feature: midpoints between distinct values, or quantiles of many."""
    found = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)))
        found.append((values[:-1] + values[1:]) / 2)
    return found


def grow(
    codes: np.ndarray, at: list[np.ndarray], g: np.ndarray, h: np.ndarray, *,
    depth: int, least: float = 5, ridge: float = 1.0, tries: int | None = None, rng: np.random.Generator | None = None,
) -> dict:
    """A tree of Newton steps: leaves are sum(g) / (sum(h) + ridge), splits gain most in sum(g)^2 / (sum(h) + ridge)."""
    total_g, total_h = g.sum(), h.sum()
    leaf = {"value": float(total_g / (total_h + ridge)), "weight": float(len(g))}
    if depth == 0 or len(g) < 2 * least:
        return leaf
    features = range(codes.shape[1])
    if tries and rng is not None:
        features = sorted(rng.choice(codes.shape[1], min(tries, codes.shape[1]), replace=False))
    best, where = 1e-9, None
    for f in features:
        size = len(at[f]) + 1
        if size < 2:
            continue
        low_g = np.cumsum(np.bincount(codes[:, f], g, size))[:-1]
        low_h = np.cumsum(np.bincount(codes[:, f], h, size))[:-1]
        low_n = np.cumsum(np.bincount(codes[:, f], minlength=size))[:-1]
        gain = low_g**2 / (low_h + ridge) + (total_g - low_g) ** 2 / (total_h - low_h + ridge) - total_g**2 / (total_h + ridge)
        gain[(low_n < least) | (len(g) - low_n < least)] = 0
        k = int(gain.argmax())
        if gain[k] > best:
            best, where = gain[k], (f, k)
    if where is None:
        return leaf
    f, k = where
    low = codes[:, f] <= k
    rest = {"depth": depth - 1, "least": least, "ridge": ridge, "tries": tries, "rng": rng}
    return {
        "feature": int(f), "at": float(at[f][k]), "weight": float(len(g)),
        "low": grow(codes[low], at, g[low], h[low], **rest), "high": grow(codes[~low], at, g[~low], h[~low], **rest),
    }


def coded(x: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(at[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1)


def predict(tree: dict, x: np.ndarray) -> np.ndarray:
    if "value" in tree:
        return np.full(len(x), tree["value"])
    low = x[:, tree["feature"]] <= tree["at"]
    out = np.empty(len(x))
    out[low], out[~low] = predict(tree["low"], x[low]), predict(tree["high"], x[~low])
    return out


def boost(x: np.ndarray, y: np.ndarray, *, rounds: int = 40, depth: int = 3, rate: float = 0.2, least: float = 5) -> dict:
    """Boosted trees of the logistic loss: {"bias", "trees"}; the sum of all is a log-odds."""
    at = cuts(x)
    codes = coded(x, at)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(p / (1 - p)))
    f, found = np.full(len(y), bias), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        tree = scaled(grow(codes, at, y - p, p * (1 - p), depth=depth, least=least), rate)
        found.append(tree)
        f += predict(tree, x)
    return {"bias": bias, "trees": found}


def scaled(tree: dict, rate: float) -> dict:
    if "value" in tree:
        return {**tree, "value": tree["value"] * rate}
    return {**tree, "low": scaled(tree["low"], rate), "high": scaled(tree["high"], rate)}


def boosted(model: dict, x: np.ndarray) -> np.ndarray:
    return model["bias"] + sum((predict(t, x) for t in model["trees"]), np.zeros(len(x)))


def forest(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 8, least: float = 3, seed: int = 7) -> list[dict]:
    """A random forest: bootstrap rows and a random part of the features at each split; leaves hold shares of label 1."""
    rng, at = np.random.default_rng(seed), cuts(x)
    codes, found = coded(x, at), []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        found.append(grow(codes[rows], at, y[rows], np.ones(len(y)), depth=depth, least=least, ridge=1e-9, tries=max(1, int(np.sqrt(x.shape[1]) + 0.5)), rng=rng))
    return found


def tree_column(tree: dict, feature) -> Column:
    """The tree as nested conditions; ``feature(i)`` is the column of feature i."""
    if "value" in tree:
        return F.lit(tree["value"])
    return F.when(feature(tree["feature"]) <= F.lit(tree["at"]), tree_column(tree["low"], feature)).otherwise(tree_column(tree["high"], feature))


def used(tree: dict) -> set[int]:
    return set() if "value" in tree else {tree["feature"]} | used(tree["low"]) | used(tree["high"])
