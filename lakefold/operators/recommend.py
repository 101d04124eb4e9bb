"""Recommendation baselines and evaluation: shrunken means, content neighbours, ridge, Gaussian processes, acquisition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakefold.functions import arrays as A


def shrunken_mean(df: DataFrame, key: str, value: str, weight: float = 5.0) -> DataFrame:
    """key, n, score = (sum + weight * mean of all) / (n + weight)"""
    overall = df.agg(F.avg(value).alias("mu"))
    sums = df.groupBy(key).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    return sums.crossJoin(F.broadcast(overall)).select(key, "n", ((F.col("s") + weight * F.col("mu")) / (F.col("n") + weight)).alias("score"))


def content_neighbours(events: DataFrame, items: DataFrame, targets: DataFrame, user: str, item: str, value: str, vector: str) -> DataFrame:
    """user, item, score: the user's mean plus the similarity-weighted deviation of the items that the user rated; only
    positive similarities count. targets: user, item."""
    mean = events.groupBy(user).agg(F.avg(value).alias("mean"))
    rated = events.join(mean, user).join(items, item).select(user, "mean", (F.col(value) - F.col("mean")).alias("gap"), F.col(vector).alias("v"))
    asked = targets.join(items, item).select(user, item, F.col(vector).alias("t"))
    similarity = F.greatest(F.lit(0.0), A.dot(F.col("v"), F.col("t")))
    sums = asked.join(rated, user).withColumn("s", similarity).groupBy(user, item).agg(F.max("mean").alias("mean"), F.sum(F.col("s") * F.col("gap")).alias("num"), F.sum("s").alias("den"))
    return sums.select(user, item, (F.col("mean") + F.coalesce(F.try_divide("num", F.nullif("den", F.lit(0.0))), F.lit(0.0))).alias("score"))


def _by_user(train: DataFrame, test: DataFrame, user: str):
    """The two tables grouped by user; columns of the second are new ones, so that tables of one source can meet."""
    return train.groupBy(user), test.select(*(F.col(c).alias(c) for c in test.columns)).groupBy(user)


def ridge_scores(train: DataFrame, test: DataFrame, user: str, item: str, value: str, vector: str, prior: str, penalty: float = 1.0) -> DataFrame:
    """Per user: the dual ridge of value minus prior on the item vectors, added to the prior. train and test have user,
    item, vector and prior; a user's events are one group."""

    def fit(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        y = b[prior].to_numpy(dtype=np.float64)
        if len(a) and len(b):
            x, t = np.stack(a[vector].to_list()), np.stack(b[vector].to_list())
            y = y + t @ x.T @ np.linalg.solve(x @ x.T + penalty * np.eye(len(x)), a[value].to_numpy() - a[prior].to_numpy())
        return pd.DataFrame({user: b[user], item: b[item], "score": y})

    ddl = f"{user} {test.schema[user].dataType.simpleString()}, {item} {test.schema[item].dataType.simpleString()}, score double"
    a, b = _by_user(train, test, user)
    return a.cogroup(b).applyInPandas(fit, ddl)


# Kernels over small driver-side arrays


def matern52(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
    d = np.sqrt(np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T)) / length
    return (1 + np.sqrt(5) * d + 5 * d**2 / 3) * np.exp(-np.sqrt(5) * d)


def complete_laplacian(n: int) -> np.ndarray:
    return n * np.eye(n) - np.ones((n, n))


def path_laplacian(n: int) -> np.ndarray:
    out = np.diag(np.r_[1.0, np.full(max(0, n - 2), 2.0), 1.0][:n]) if n > 1 else np.zeros((1, 1))
    i = np.arange(n - 1)
    out[i, i + 1] = out[i + 1, i] = -1.0
    return out


def diffusion(laplacian: np.ndarray, tau: float) -> np.ndarray:
    values, vectors = np.linalg.eigh(laplacian)
    return vectors @ np.diag(np.exp(-tau * values)) @ vectors.T


def normalized_gram(k: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.maximum(np.diag(k), 1e-12))
    return k / d[:, None] / d[None]


def solve_with_jitter(k: np.ndarray, y: np.ndarray, first: float = 1e-9, most: float = 1e-2) -> tuple[np.ndarray, np.ndarray]:
    """Cholesky factor and solution; jitter grows tenfold until the factor exists."""
    jitter = 0.0
    while True:
        try:
            factor = np.linalg.cholesky(k + jitter * np.eye(len(k)))
            return factor, np.linalg.solve(factor.T, np.linalg.solve(factor, y))
        except np.linalg.LinAlgError:
            jitter = max(first, jitter * 10)
            if jitter > most:
                raise


def gp_posterior(x: np.ndarray, y: np.ndarray, t: np.ndarray, length: float, noise: float, signal: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance at t."""
    k = signal * matern52(x, x, length) + noise * np.eye(len(x))
    factor, alpha = solve_with_jitter(k, y - y.mean())
    cross = signal * matern52(t, x, length)
    v = np.linalg.solve(factor, cross.T)
    return y.mean() + cross @ alpha, np.maximum(0.0, signal - (v**2).sum(axis=0))


def gp_scores(train: DataFrame, test: DataFrame, user: str, item: str, value: str, vector: str, length: float = 1.0, noise: float = 0.3) -> DataFrame:
    """Per user: user, item, mean, sd of a Matern 5/2 process over the item vectors."""

    def fit(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({user: b[user], item: b[item], "mean": np.nan, "sd": np.nan})
        mean, variance = gp_posterior(np.stack(a[vector].to_list()), a[value].to_numpy(dtype=np.float64), np.stack(b[vector].to_list()), length, noise)
        return pd.DataFrame({user: b[user], item: b[item], "mean": mean, "sd": np.sqrt(variance)})

    ddl = f"{user} {test.schema[user].dataType.simpleString()}, {item} {test.schema[item].dataType.simpleString()}, mean double, sd double"
    a, b = _by_user(train, test, user)
    return a.cogroup(b).applyInPandas(fit, ddl)


def _density(z: np.ndarray) -> np.ndarray:
    return np.exp(-(z**2) / 2) / np.sqrt(2 * np.pi)


def _mass(z: np.ndarray) -> np.ndarray:
    from math import erf

    return 0.5 * (1 + np.vectorize(erf)(z / np.sqrt(2)))


def expected_improvement(mean: np.ndarray, sd: np.ndarray, best: float) -> np.ndarray:
    z = np.divide(mean - best, sd, out=np.zeros_like(mean), where=sd > 0)
    return np.where(sd > 0, (mean - best) * _mass(z) + sd * _density(z), np.maximum(0, mean - best))


def upper_bound(mean: np.ndarray, sd: np.ndarray, beta: float = 2.0) -> np.ndarray:
    return mean + beta * sd


def farthest_points(vectors: np.ndarray, n: int) -> list[int]:
    """Greedy: the first row, then always the row farthest from those chosen; of equals the first."""
    chosen = [0] if len(vectors) else []
    distance = np.full(len(vectors), np.inf)
    while len(chosen) < min(n, len(vectors)):
        distance = np.minimum(distance, ((vectors - vectors[chosen[-1]]) ** 2).sum(axis=1))
        distance[chosen] = -1
        chosen.append(int(distance.argmax()))
    return chosen


def ordinal_log_likelihood(f: np.ndarray, y: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Log probability of each rating 0 .. len(cuts) under a probit with the cut points."""
    edges = np.concatenate(([-np.inf], cuts, [np.inf]))
    p = _mass(np.clip(edges[y + 1] - f, -37, 37)) - _mass(np.clip(edges[y] - f, -37, 37))
    return np.log(np.maximum(p, 1e-300))


def top_share(df: DataFrame, user: str, score: str, value: str, position: str, k: int = 5, least: float = 4.0) -> DataFrame:
    """user, share of the k highest-scored rows with a value of least or more."""
    place = F.row_number().over(Window.partitionBy(user).orderBy(F.desc(score), position))
    return df.withColumn("_p", place).where(F.col("_p") <= k).groupBy(user).agg(F.avg((F.col(value) >= least).cast("double")).alias("share"))
