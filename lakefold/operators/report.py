"""Evaluation reports with explicit numerators and denominators, error rates, intervals, and paired comparisons."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakefold.functions import arrays as A
from lakefold.functions import text as T


def _metric(name: str, numerator: Column, denominator: Column) -> Column:
    return F.struct(F.lit(name).alias("metric"), numerator.cast("bigint").alias("numerator"), denominator.cast("bigint").alias("denominator"))


def ratios(df: DataFrame, metrics: list[tuple[str, Column, Column]]) -> DataFrame:
    """metric, numerator, denominator, value; each is a count of rows for which the condition holds."""
    each = df.agg(F.array(*(_metric(n, F.count_if(a), F.count_if(b)) for n, a, b in metrics)).alias("m")).select(F.inline("m"))
    return each.withColumn("value", A.ratio(F.col("numerator"), F.col("denominator")))


def recognition_report(p: DataFrame, ks: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """p: query_id, gt_status, gt_slug, status, slug, candidates (array of slugs by rank)."""
    known, unknown, accepted = (F.coalesce(c, F.lit(False)) for c in (F.col("gt_status") == "known", F.col("gt_status") == "unknown", F.col("status") == "accepted"))
    right = F.coalesce(F.col("slug") == F.col("gt_slug"), F.lit(False))
    found = lambda k: F.coalesce(F.array_contains(F.slice("candidates", 1, k), F.col("gt_slug")), F.lit(False))
    labelled = known | unknown
    return ratios(p, [
        ("exact_accuracy", known & accepted & right, known),
        ("accepted_precision", known & accepted & right, labelled & accepted),
        ("coverage", accepted, F.lit(True)),
        ("unknown_false_accept", unknown & accepted, unknown),
        *((f"recall_at_{k}", known & found(k), known) for k in ks),
    ])


def status_histogram(p: DataFrame, column: str = "status") -> DataFrame:
    return p.groupBy(column).agg(F.count("*").alias("n"))


def at_ranks(df: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """by, and for each name the group's value at rank(n), counted from 0 in ascending order. Equal values are counted
    before they meet, so a group is a running sum over its distinct values and is never collected."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*by)
    placed = counts.withColumn("_to", F.sum("_c").over(group.orderBy("_v"))).withColumn("_n", F.sum("_c").over(group))
    here = lambda rank: (F.col("_to") - F.col("_c") <= rank) & (rank < F.col("_to"))
    return placed.groupBy(*by).agg(*(F.max(F.when(here(f(F.col("_n"))), F.col("_v"))).alias(name) for name, f in ranks.items()))


def percentiles(df: DataFrame, value: str, shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """One row: for each name the exact percentile of value at its share, between two values in proportion (nulls do not count).

    A sketch gives bounds around each percentile (n / accuracy ranks either way at most, taken twice as wide; of so few values all); a second scan
    counts the values under the bounds and those between them, and only these few meet in one task."""
    known = df.where(F.col(value).isNotNull()).select(F.col(value).alias("_v"))
    edge = 2.0 / accuracy
    around = [(name, q, max(0.0, q - edge), min(1.0, q + edge)) for name, q in shares.items()]
    sketch = F.percentile_approx("_v", F.array(*(F.lit(x) for _, _, a, b in around for x in (a, b))), F.lit(accuracy))
    whole = known.agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), sketch.alias("_b"))
    bound = lambda i, end, sure: F.col(end) if sure else F.when(F.col("_n") <= accuracy, F.col(end)).otherwise(F.get("_b", F.lit(i)))
    bounds = whole.select("_n", F.inline(F.array(*(F.struct(F.lit(name).alias("name"), ((F.col("_n") - 1) * q).alias("rank"), bound(2 * i, "_least", a == 0).alias("low"), bound(2 * i + 1, "_most", b == 1).alias("high")) for i, (name, q, a, b) in enumerate(around)))))
    met = known.crossJoin(F.broadcast(bounds))
    below = met.groupBy("name").agg(F.count_if(F.col("_v") < F.col("low")).alias("before"), F.first("rank").alias("rank"))
    inside = met.where(F.col("_v").between(F.col("low"), F.col("high"))).groupBy("name", "_v").agg(F.count("*").alias("c"))
    to = F.sum("c").over(Window.partitionBy("name").orderBy("_v"))
    placed = inside.withColumn("to", to).join(F.broadcast(below), "name").withColumn("to", F.col("to") + F.col("before"))
    at = lambda r: F.max(F.when((F.col("to") - F.col("c") <= r) & (r < F.col("to")), F.col("_v")))
    each = placed.groupBy("name").agg(at(F.floor("rank")).alias("a"), at(F.ceil("rank")).alias("b"), F.first("rank").alias("rank"))
    one = each.select("name", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank"))).alias("v"))
    return one.agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares))


def latency(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, min, p50, p95, p99, max, mean by group; percentiles are sorted[int((n - 1) p)]."""
    v = F.col(value)
    ranks = at_ranks(df, by, value, {f"p{q}": lambda n, q=q: F.floor((n - 1) * (q / 100)) for q in (50, 95, 99)})
    whole = df.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("lowest"), F.max(v).alias("highest"), F.avg(v).alias("mean"))
    return whole.join(ranks, by, "left").select(*by, "n", "lowest", "p50", "p95", "p99", "highest", "mean")


def percentile_definitions(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The definitions side by side: floor and ceil ranks, lower and upper medians, linear interpolation."""
    ranks = {
        "p95_floor": lambda n: F.floor((n - 1) * 0.95), "p95_ceil": lambda n: F.greatest(F.lit(0), F.ceil(n * 0.95) - 1),
        "p50_lower": lambda n: F.floor((n - 1) / 2), "p50_upper": lambda n: F.floor(n / 2),
    }
    linear = df.groupBy(*by).agg(F.percentile(value, F.lit(0.95)).alias("p95_linear"))
    return linear.join(at_ranks(df, by, value, ranks), by, "left").select(*by, *ranks, "p95_linear")


def error_rates(df: DataFrame, reference: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """Character and word error rates: summed edits over summed reference lengths. A missing prediction is an empty one;
    a rate over nothing is null."""
    said = lambda c: T.spoken_words(F.coalesce(F.col(c), F.lit("")))
    rows = df.withColumns({"_r": said(reference), "_p": said(prediction)})
    joined = rows.withColumns({"_rt": F.array_join("_r", " "), "_pt": F.array_join("_p", " ")})
    sums = joined.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(prediction).isNull()).alias("n_missing"),
        F.sum(F.levenshtein("_rt", "_pt")).cast("bigint").alias("char_edits"),
        F.sum(F.length("_rt")).cast("bigint").alias("chars"),
        F.sum(T.word_edit_distance(F.col("_r"), F.col("_p"))).cast("bigint").alias("word_edits"),
        F.sum(F.size("_r")).cast("bigint").alias("words"),
    )
    return sums.withColumn("cer", A.ratio(F.col("char_edits"), F.nullif("chars", F.lit(0)))).withColumn("wer", A.ratio(F.col("word_edits"), F.nullif("words", F.lit(0))))


def pair(left: DataFrame, right: DataFrame, key: str, same: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of both runs side by side (column_a, column_b), and errors (key, error): ids of one run only, repeated
    ids, and fields that must agree and do not."""
    a = left.select(key, *(F.col(c).alias(f"{c}_a") for c in [*same, *columns]), F.lit(1).alias("in_a"))
    b = right.select(key, *(F.col(c).alias(f"{c}_b") for c in [*same, *columns]), F.lit(1).alias("in_b"))
    full = a.join(b, key, "full")
    errors = [full.where("in_a IS NULL OR in_b IS NULL").select(key, F.lit("in_one_run").alias("error"))]
    errors += [d.groupBy(key).count().where("count > 1").select(key, F.lit("repeated").alias("error")) for d in (left, right)]
    errors += [full.where(F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))).select(key, F.lit(f"{c}_differs").alias("error")) for c in same]
    return full.where("in_a = 1 AND in_b = 1").drop("in_a", "in_b"), reduce(DataFrame.unionByName, errors).distinct()


def paired_outcomes(paired: DataFrame, right_a: Column, right_b: Column, top_a: Column, top_b: Column) -> DataFrame:
    """both, helped (only b right), harmed (only a right), neither, changed_top, n"""
    a, b = (F.coalesce(c, F.lit(False)) for c in (right_a, right_b))
    return paired.agg(
        F.count_if(a & b).alias("both"), F.count_if(~a & b).alias("helped"), F.count_if(a & ~b).alias("harmed"), F.count_if(~a & ~b).alias("neither"),
        F.count_if(~top_a.eqNullSafe(top_b)).alias("changed_top"), F.count("*").alias("n"),
    )


def cluster_interval(df: DataFrame, by: list[str], cluster: str, numerator: str, denominator: str, draws: int = 2000, seed: int = 0, least: int = 2) -> DataFrame:
    """A ratio of sums with its 2.5 and 97.5 per cent bootstrap limits over clusters. Clusters are summed first, so what
    one task holds is a row per cluster; null limits for fewer clusters than least."""
    sums = df.groupBy(*by, cluster).agg(F.sum(numerator).cast("double").alias("num"), F.sum(denominator).cast("double").alias("den"))
    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)

    def draw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(cluster)
        num, den = rows["num"].to_numpy(), rows["den"].to_numpy()
        value = num.sum() / den.sum() if den.sum() else None
        low = high = None
        if len(rows) >= least:
            chosen = np.random.default_rng(seed).integers(0, len(rows), size=(draws, len(rows)))
            d = den[chosen].sum(axis=1)
            found = num[chosen].sum(axis=1)[d > 0] / d[d > 0]
            if len(found):
                low, high = (float(x) for x in np.percentile(found, (2.5, 97.5)))
        return pd.DataFrame([(*key, value, low, high, len(rows))], columns=[*by, "value", "low", "high", "n_clusters"])

    return sums.groupBy(*by).applyInPandas(draw, f"{fields}, value double, low double, high double, n_clusters bigint")


def retention_report(df: DataFrame, by: list[str], value: str, floor: float = 0.9) -> DataFrame:
    """Per-row values are rounded half to even at four places first: n, lowest, mean, below floor."""
    v = F.bround(F.col(value), 4)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("lowest"), F.avg(v).alias("mean"), F.count_if(v < floor).alias("n_below"))


def hits_at(ranked: DataFrame, truth: DataFrame, query_id: str, item_id: str, rank: str, ks: tuple[int, ...]) -> DataFrame:
    """metric, numerator, denominator, value over the truth's queries; a query without its item among the ranks is a miss."""
    hit = truth.join(ranked, [query_id, item_id], "left").groupBy(query_id).agg(F.min(rank).alias("first"))
    return ratios(hit, [(f"hit_at_{k}", F.col("first") <= k, F.lit(True)) for k in ks])


def ndcg(df: DataFrame, user: str, score: str, gain: str, position: str, k: int) -> DataFrame:
    """user, ndcg with linear gain; null where no gain is above zero. Equal scores stay in the order of position."""
    by = lambda c: F.row_number().over(Window.partitionBy(user).orderBy(F.desc(c), F.asc(position)))
    ranked = df.withColumn("by_score", by(score)).withColumn("by_gain", by(gain))
    part = lambda place: F.sum(F.when(F.col(place) <= k, F.col(gain) / F.log2(F.col(place) + 1)).otherwise(0.0))
    return ranked.groupBy(user).agg(part("by_score").alias("dcg"), part("by_gain").alias("ideal")).select(user, F.try_divide("dcg", F.nullif("ideal", F.lit(0.0))).alias("ndcg"))


def spearman(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """by, rho: the correlation of average ranks; 0 where a side is constant."""
    average = lambda c: F.rank().over(Window.partitionBy(by).orderBy(c)) + (F.count("*").over(Window.partitionBy(by, c)) - 1) / 2.0
    ranked = df.select(by, average(x).alias("rx"), average(y).alias("ry"))
    rho = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))  # corr() fails on a constant side
    return ranked.groupBy(by).agg(F.when((F.min("rx") < F.max("rx")) & (F.min("ry") < F.max("ry")), rho).otherwise(0.0).alias("rho"))


def exact_ratio_test(wins: int, losses: int) -> float:
    """Two-sided sign test of paired outcomes."""
    from math import comb

    n = wins + losses
    tail = sum(comb(n, i) for i in range(min(wins, losses) + 1)) / 2**n if n else 1.0
    return min(1.0, 2 * tail)
