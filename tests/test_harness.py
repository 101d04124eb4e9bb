"""The harness over folds against plain loops over users."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakefold.operators import harness, workflow
from lakefold.operators.processes import Block, SumKernel, fitted
from tests.test_processes import frame, rows

BLOCKS = (Block("c", "category"), Block("p", "plain"), Block("m", "matern", 2))


def table(spark):
    import pandas as pd

    d = pd.concat([rows(n, seed).assign(item=lambda r: (r.item * 7) % 40) for n, seed in ((18, 1), (25, 2), (9, 3), (16, 4))]).reset_index(drop=True)
    df = frame(spark, d, ["user", "item", "c", "p", "m", "v"])
    return d, df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("item") * 60)).withColumn("maker", F.col("item") % 6)


def test_scores_and_metrics(spark):
    d, df = table(spark)
    folds = workflow.folds(df, "temporal", "user", "item", "ts", "item", "maker", 8, 5, "s")
    got = harness.scores(folds, "user", "item", "v", BLOCKS)
    by = {(r.user, r.item): r for r in got.collect()}
    d = d.sort_values(["user", "item"])
    train = {u: g.iloc[:8] for u, g in d.groupby("user") if len(g) >= 13}
    assert {u for u, _ in by} == set(train) == {1, 2, 4}
    known = np.concatenate([g.v.to_numpy() for g in train.values()])
    mean, scale = known.mean(), max(known.std(), 1.0)
    kernel = SumKernel(BLOCKS)
    metrics = {(r.method, r.user): r for r in harness.user_metrics(got, "user", "item", "v").collect()}
    for u, a in train.items():
        b = d[d.user == u].iloc[8:]
        x, t, y = kernel.features(a), kernel.features(b), a.v.to_numpy()
        prior = (y.sum() + 5 * mean) / 13
        near = np.maximum(kernel.gram(kernel.start, t, x), 0)
        wide = lambda f: np.hstack([f[0], f[1], f[2] / 2]) / math.sqrt(3)
        want = {
            "popularity": [(sum(g.v[g.item == i].sum() for g in train.values()) + 5 * mean) / (sum((g.item == i).sum() for g in train.values()) + 5) for i in b.item],
            "user_mean": [prior] * len(b), "content": y.mean() + near @ (y - y.mean()) / (near.sum(axis=1) + 1e-9),
            "linear": prior + wide(t) @ wide(x).T @ np.linalg.inv(wide(x) @ wide(x).T + np.eye(8)) @ (y - prior), "process": fitted(kernel, a, "v", mean=mean, scale=scale).posterior(t)[0],
        }
        truth = b.v.to_numpy()
        for method, s in want.items():
            s = np.asarray(s)
            assert np.allclose([by[u, i][method] for i in b.item], s, atol=1e-8), (u, method)
            order = sorted(range(len(b)), key=lambda i: (-s[i], b.item.iloc[i]))[:5]
            ideal = sum(g / math.log2(i + 2) for i, g in enumerate(sorted(np.maximum(truth - 1, 0), reverse=True)[:5]))
            m = metrics[method, u]
            if len(set(np.round(s, 12))) == len(s) or method == "user_mean":
                assert math.isclose(m.ndcg, sum(max(truth[i] - 1, 0) / math.log2(k + 2) for k, i in enumerate(order)) / ideal, abs_tol=1e-9)
                assert math.isclose(m.liked, np.mean(truth[order] >= 4), abs_tol=1e-9)
    assert all(metrics["user_mean", u].spearman == 0 for u in train)
    total = {r.method: r for r in harness.summary(harness.user_metrics(got, "user", "item", "v")).collect()}
    assert set(total) == set(harness.METHODS) and all(r.n_users == 3 for r in total.values())


def test_test_ratings_are_not_read(spark):
    """Other ratings of the test rows change no score; a new user's own rows are not in the overall mean."""
    _, df = table(spark)
    folds = workflow.folds(df, "temporal", "user", "item", "ts", "item", "maker", 8, 5, "s")
    other = folds.withColumn("v", F.when(F.col("role") == "test", F.lit(1.0)).otherwise(F.col("v")))
    rounded = lambda f: sorted((r.user, r.item, *(round(r[m], 9) for m in harness.METHODS)) for r in harness.scores(f, "user", "item", "v", BLOCKS).collect())
    assert rounded(folds) == rounded(other)
    new = folds.withColumn("population", F.col("population") & (F.col("user") != 1)).where("user = 1 OR population")
    score = harness.scores(new, "user", "item", "v", BLOCKS).collect()
    assert {r.user for r in score} <= {1, 2, 4} and any(r.user == 1 for r in score)


def test_chosen_users_and_errors(spark):
    _, df = table(spark)
    folds = workflow.folds(df, "temporal", "user", "item", "ts", "item", "maker", 8, 5, "s")
    some = harness.some_users(folds, "user", 2, "x")
    assert some.where("role = 'test'").select("user").distinct().count() == 2 and some.where("population").select("user").distinct().count() == 3
    check = lambda f, time="ts": harness.checked_ratings(f, "user", "item", "v", time).count()
    assert check(df) == df.count()
    for wrong, text in ((df.withColumn("v", F.lit(None).cast("double")), "missing user, item or rating"), (df.withColumn("v", F.lit(float("nan"))), "not finite"), (df.withColumn("ts", F.lit(None).cast("timestamp")), "missing time"), (df.unionByName(df), "rated twice")):
        with pytest.raises(Exception, match=text):
            harness.checked_ratings(wrong, "user", "item", "v", "ts").collect()
    assert harness.checked_ratings(df.withColumn("ts", F.lit(None).cast("timestamp")), "user", "item", "v", None).count() == df.count()


def test_items_apart_are_the_same(spark):
    """Features of a table of items give the scores of features in each row, in any number of batches; the folds have none."""
    from tests.test_processes import rows as drawn

    items = frame(spark, drawn(40, 9), ["item", "c", "p", "m"])
    _, df = table(spark)
    folds = workflow.folds(df.drop("c", "p", "m"), "temporal", "user", "item", "ts", "item", "maker", 8, 5, "s")
    rounded = lambda f, *more: sorted((r.user, r.item, r.rating, *(round(r[m], 9) for m in harness.METHODS)) for r in harness.scores(f, "user", "item", "rating", BLOCKS, *more).collect())
    folds = folds.withColumnRenamed("v", "rating")
    want = rounded(folds.join(items, "item"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert want and rounded(folds, items) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
