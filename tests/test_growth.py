"""Operators whose work once grew faster than their rows, or met in one place: results and the shape of their plans."""

import numpy as np
from pyspark.sql import functions as F

from lakefold.functions import arrays as A
from lakefold.operators import contrastive, encoders, entity, policy, report, search, similarity
from lakefold.plans import models
from lakefold.plans.book import Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_alias_texts_are_never_broadcast(spark):
    texts = spark.createDataFrame([(1, "large red ring"), (2, "boring")], "id int, text string")
    aliases = spark.createDataFrame([("red", "colour"), ("ring", "jewel")], "variant string, canonical string")
    for whole in (True, False):
        out = policy.alias_in_text(texts, aliases, "id", "text", whole)
        assert "SortMergeJoin [id" in plan(out)
    assert {r.id: r.canonical for r in out.collect()} == {1: "jewel", 2: "jewel"}


def test_gram_row_sums_make_no_entries(spark):
    x = np.random.default_rng(3).normal(size=(40, 5))
    out = contrastive.gram_row_sums(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id int, v array<double>"), "id", "v", 0.05)
    got = {r.id: (r.n, r.total) for r in out.collect()}
    assert len(got) == 40 and all(got[i][0] == 40 and np.isclose(got[i][1], (0.05 + x[i] @ x.T).sum()) for i in range(40))


def test_best_views_send_a_row_for_each_query_and_item(spark):
    x = np.random.default_rng(4).normal(size=(30, 4))
    x[7] = x[3]
    g = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item int, v array<double>")
    q = spark.createDataFrame([(i // 2, "ab"[i % 2], x[j].tolist()) for i, j in enumerate((3, 7, 5))], "query int, view string, v array<double>")
    out = similarity.best_views(q, g, "query", "view", "item", "v", cells=7)
    assert "Exchange" not in plan(out)
    got = {(r["query"], r["item"]): (r.best, r.best_view) for r in out.collect()}
    assert len(got) == 60
    for i in range(30):
        assert np.isclose(got[0, i][0], x[3] @ x[i], atol=2e-9) and got[0, i][1] == "a" and np.isclose(got[1, i][0], x[5] @ x[i], atol=2e-9)


def test_percentiles_are_exact_and_only_values_near_them_meet(spark):
    rng = np.random.default_rng(5)
    for values in (rng.normal(size=3001).tolist(), rng.integers(0, 4, 500).astype(float).tolist(), [2.0], [1.0, 2.0]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        got = report.percentiles(df, "v", {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}, 50).first()
        assert np.allclose([got.a, got.b, got.c, got.d], np.quantile(values, [0.5, 0.95, 0, 1]), rtol=1e-12)
    assert report.percentiles(df.limit(0), "v", {"a": 0.5}).first().a is None


def test_encoded_rows_are_not_grouped_again(spark):
    df = spark.createDataFrame([(1, "{'a': 3, 'x': 1}"), (2, "['b', 'a']"), (3, None)], "id int, text string").select("id", encoders.blend(F.col("text")).alias("m"))
    vocabulary = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "member string, marginal double")
    shares, there = encoders.share_vectors(df, "id", "m", vocabulary), encoders.presence_vectors(df, "id", "m", vocabulary)
    assert "hashpartitioning(_row" not in plan(shares) and "hashpartitioning(_row" not in plan(there)
    assert {r.id: r.vector for r in shares.collect()} == {1: [0.9375, 0.0625], 2: [0.5, 0.5], 3: [0.75, 0.25]}


def test_a_unit_vector_computes_its_length_once(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(A.unit(F.col("v")).alias("u"))
    assert [r.u for r in df.collect()] == [[0.6, 0.8], None]
    assert plan(df).lower().count("aggregate(zip_with") <= 2


def test_copies_of_items_do_not_multiply_evidence_or_records(spark):
    """Sets of tokens, and producers with names, meet: the pairs that a join makes do not grow with copies."""
    items = spark.range(400).select(F.col("id").alias("slug"), F.array(F.lit("t"), F.concat(F.lit("w"), F.col("id") % 3)).alias("tokens"))
    asked = items.where("slug % 100 = 0").select(F.col("slug").alias("query_id"), "tokens")
    out = search.top_evidence(asked, "query_id", F.col("tokens"), items, "slug", F.col("tokens"), 5)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.slug)
    assert got == {q: [i for i in range(400) if i % 3 == q % 3][:5] for q in (0, 100, 200, 300)}
    rows = [(i, "Maker", ("old ring", "red bolt")[i % 2], (None, 2000, 2001)[i % 3]) for i in range(60)]
    records = spark.createDataFrame(rows[10:14] + [(99, None, "old ring", 2000)], "record_id int, producer string, name string, year int")
    best = {r.record_id: (r.item_id, r.score) for r in entity.resolve(records, spark.createDataFrame(rows, "item_id int, producer string, name string, year int")).collect()}
    want = {i: min(j for j in range(60) if j % 2 == i % 2 and (i % 3 == 0 or j % 3 in (0, i % 3))) for i in range(10, 14)}
    assert best == {i: (j, 1.0) for i, j in want.items()} | {99: (None, 0.0)}


def test_folds_are_made_once(spark):
    folded = models.folded(Tables(spark, "/root/testdata/sf0.001"), "temporal")
    assert "Window" not in plan(folded) and "events.parquet" not in plan(folded)
