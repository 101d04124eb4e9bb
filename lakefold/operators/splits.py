"""Deterministic splits, samples and temporal histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed_share(value: Column) -> Column:
    """0 to 99: the first two bytes of the SHA-256, modulo 100."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 4), 16, 10).cast("int") % 100


def hashed_split(value: Column, train: int = 80, validation: int = 10) -> Column:
    share = hashed_share(value)
    return F.when(share < train, "train").when(share < train + validation, "validation").otherwise("test")


def diverse_sample(df: DataFrame, row_id: str, group: str, limit: int, seed: str) -> DataFrame:
    """One row of each group first, then the rest, both in the order of sha256(seed:id); limit rows."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(row_id).cast("string")), 256)
    ranked = df.withColumn("_order", order).withColumn("_later", (F.row_number().over(Window.partitionBy(group).orderBy("_order", row_id)) > 1).cast("int"))
    return ranked.orderBy("_later", "_order", row_id).limit(limit).drop("_order", "_later")


def last_events(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The latest row of each key; of equal times the one with the greater tie column."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(time, tie)).alias("r")).select(*keys, "r.*")


def temporal_split(df: DataFrame, user: str, time: str, tie: str, n_train: int, min_test: int) -> DataFrame:
    """df with role: each user's first n_train events are train, all later ones test; users with fewer than min_test of
    these are left out."""
    w = Window.partitionBy(user)
    ranked = df.withColumn("_n", F.count("*").over(w)).withColumn("_place", F.row_number().over(w.orderBy(time, tie)))
    role = F.when(F.col("_place") <= n_train, "train").otherwise("test")
    return ranked.where(F.col("_n") >= n_train + min_test).withColumn("role", role).drop("_n", "_place")


def after_cutoff(df: DataFrame, user: str, time: str, support: Column) -> DataFrame:
    """Events that come strictly after the user's last support event."""
    cutoff = df.where(support).groupBy(user).agg(F.max(time).alias("cutoff"))
    return df.where(~support).join(cutoff, user).where(F.col(time) > F.col("cutoff")).drop("cutoff")


def recent(df: DataFrame, key: str, time: str, n: int) -> DataFrame:
    """The newest row of each key, newest first; n rows."""
    others = [c for c in df.columns if c != key]
    newest = df.groupBy(key).agg(F.max_by(F.struct(*others), F.col(time)).alias("r")).select(key, "r.*")
    return newest.orderBy(F.desc(time), key).limit(n)
