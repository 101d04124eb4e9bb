"""Recommenders over the folds of an evaluation: five models score each user's test rows from the rows that they may know."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakefold.operators import processes, report
from lakefold.operators.processes import Block, Person, SumKernel

METHODS = ("popularity", "user_mean", "content", "linear", "process")
#: How many ratings the overall mean weighs, the rating that is liked, and the ranks that count.
SHRINKAGE, LIKED, RANKS = 5.0, 4.0, 5


def checked_ratings(ratings: DataFrame, user: str, item: str, rating: str, time: str | None) -> DataFrame:
    """ratings, or an error: a missing user, item or rating, a rating that is not finite, a missing time (unless time is None), a
    user's item rated twice."""
    twice = F.count("*").over(Window.partitionBy(user, item)) > 1
    value = F.col(rating).cast("double")
    problems = [("missing user, item or rating", F.col(user).isNull() | F.col(item).isNull() | value.isNull()), ("a rating is not finite", F.isnan(value) | (F.abs(value) == float("inf")))]
    problems += [("missing time", F.col(time).isNull())] if time else []
    problems += [("an item that a user has rated twice", twice)]
    wrong = F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for text, bad in problems))
    fine = F.when(wrong.isNull(), True).otherwise(F.raise_error(wrong).cast("boolean"))
    return ratings.withColumn("_fine", fine).where("_fine").drop("_fine")


def some_users(folded: DataFrame, user: str, n_users: int, seed: str) -> DataFrame:
    """folded without the test rows of all but n_users users, the first in the order of a hash; their population rows stay."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(user).cast("string")), 256)
    chosen = folded.where("role = 'test'").select(user).distinct().orderBy(order, user).limit(n_users).withColumn("_chosen", F.lit(True))
    marked = folded.join(chosen, user, "left")
    return marked.where(F.coalesce("_chosen", F.lit(False)) | F.col("population")).withColumn("role", F.when(F.col("_chosen"), F.col("role")).otherwise("train")).withColumn("asked", F.coalesce("_chosen", F.lit(False))).drop("_chosen")


def scores(folded: DataFrame, user: str, item: str, rating: str, blocks: tuple[Block, ...], items: DataFrame | None = None) -> DataFrame:
    """user, item, rating and a score by each of METHODS, for every test row. folded: ratings with role and population, as
    workflow.folds() gives them, and the feature blocks, or items (item and the blocks) has these.

    The overall mean and deviation and the items' popularity come from population rows alone, the rest from the user's own
    train rows: a shrunken mean; the mean and the neighbours' deviations weighed by the kernel at its starts; Bayesian linear
    weights on the joined features; the process. A user's rows are read by one task.
    """
    known = folded.where("population")
    overall = known.agg(F.avg(rating).alias("_mean"), F.greatest(F.stddev_pop(rating), F.lit(1.0)).alias("_scale"))  # one row
    popular = known.groupBy(item).agg(F.sum(rating).alias("_s"), F.count("*").alias("_n"))
    kernel, features = SumKernel(blocks), [b.column for b in blocks] if items is None else []

    def joined(x: list[np.ndarray]) -> np.ndarray:
        return np.hstack([p / 2 if b.kind == "matern" else p for b, p in zip(blocks, x, strict=True)]) / math.sqrt(len(blocks))

    def predict(people: list[Person], rows: pa.Table) -> Iterator[tuple[np.ndarray, dict]]:
        some = [p for p in people if len(p.learnt) and len(p.asked)]
        if not some:
            return
        # one row of numbers for all users
        mean, scale = (float(rows.column(f"_{c}")[int(some[0].learnt[0])].as_py()) for c in ("mean", "scale"))
        asked = rows.column(f"_{rating}").to_numpy()
        fits = processes.fitted_many(kernel, [p.x for p in some], [p.y for p in some], mean=mean, scale=scale)
        for u, fit in zip(some, fits, strict=True):
            y = u.y
            prior = (y.sum() + SHRINKAGE * mean) / (len(y) + SHRINKAGE)
            near = np.maximum(kernel.gram(kernel.start, u.t, u.x), 0)
            p, q = joined(u.x), joined(u.t)
            yield u.asked, {
                rating: asked[u.asked], "prior": np.full(len(u.asked), mean), "user_mean": np.full(len(u.asked), prior), "content": y.mean() + near @ (y - y.mean()) / (near.sum(axis=1) + 1e-9),
                "linear": prior + q @ (p.T @ np.linalg.solve(p @ p.T + np.eye(len(y)), y - prior)), "process": fit.means(u.t),
            }

    kind = lambda c: f"`{c}` {folded.schema[c].dataType.simpleString()}"
    train = folded.where("role = 'train'").crossJoin(F.broadcast(overall)).select(user, item, rating, *features, F.col("_mean").alias("mean"), F.col("_scale").alias("scale"))
    test = folded.where("role = 'test'").select(user, item, rating, *features)
    own = processes.by_user(train, test, user, item, rating, blocks, items, predict, f"{kind(user)}, {kind(item)}, {rating} double, prior double, user_mean double, content double, linear double, process double", processes.MOST_RATINGS, ("mean", "scale"))
    shrunken = (F.coalesce("_s", F.lit(0.0)) + SHRINKAGE * F.col("prior")) / (F.coalesce("_n", F.lit(0)) + SHRINKAGE)
    return own.join(popular, item, "left").withColumn("popularity", shrunken).select(user, item, F.col(rating).cast(folded.schema[rating].dataType), *METHODS)


def user_metrics(scored: DataFrame, user: str, item: str, rating: str) -> DataFrame:
    """method, user, spearman (0 where a side is constant), ndcg (of RANKS, gains above one star; null where there are none) and
    liked (the share of ratings of LIKED or more among the RANKS first). Equal scores stand in the order of items."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in METHODS)))
    long = scored.select(user, item, F.col(rating).cast("double").alias("y"), each.alias("m")).select(user, item, "y", "m.*").withColumn("key", F.struct("method", user))
    rho = report.spearman(long, "key", "score", "y")
    gains = report.ndcg(long.withColumn("gain", F.greatest(F.col("y") - 1, F.lit(0.0))), "key", "score", "gain", item, RANKS)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), item))
    liked = long.withColumn("place", place).where(F.col("place") <= RANKS).groupBy("key").agg(F.avg((F.col("y") >= LIKED).cast("double")).alias("liked"))
    return rho.join(gains, "key").join(liked, "key").select("key.method", F.col(f"key.{user}").alias(user), F.col("rho").alias("spearman"), "ndcg", "liked")


def summary(metrics: DataFrame) -> DataFrame:
    """method, n_users, and the means over users."""
    return metrics.groupBy("method").agg(F.count("*").alias("n_users"), *(F.round(F.avg(c), 3).alias(c) for c in ("spearman", "ndcg", "liked")))
