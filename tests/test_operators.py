"""Small hand-made tables against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lakefold.functions import text as T
from lakefold.operators import audit, catalog, client, entity, fusion, jobs, media, recommend, report, search, similarity, splits


def got(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_deduplicate(spark):
    df = spark.createDataFrame([("s", 2, "a\nb"), ("s", 3, "a\nb"), ("t", 4, "x"), ("t", 5, "y")], "slug string, row int, note string")
    kept, rep = catalog.deduplicate(df, "slug", "row")
    assert got(kept.select("slug", "source_rows")) == [("s", [2, 3])]
    assert rep.first() == (4, 2, 1, 1)


def test_aliases(spark):
    lines = spark.createDataFrame([(1, "# c"), (2, "Alpha, Alfa , ALPHÀ"), (3, "only"), (4, "Beta, Alfa")], "line_no int, value string")
    assert dict(got(catalog.aliases(lines))) == {"alpha": "alpha", "alphà": "alpha", "alfa": "beta", "beta": "beta"}


def test_search_order_and_empty(spark):
    items = spark.createDataFrame([("a-1", "Алиготе", "Дом", "Алиготе Дом a-1"), ("b-1", "Рислинг", "Дом", "Рислинг Дом b-1")], "slug string, name string, producer string, field_text string")
    items = items.withColumn("producer_terms", F.array(T.canonical(F.col("producer"))))
    q = spark.createDataFrame([("q1", "рислинг дом"), ("q2", ""), ("q3", "рислнг")], "query_id string, text string")
    out = search.search(q, items)
    best = {r.query_id: r.slug for r in out.where("rank = 1").collect()}
    assert best == {"q1": "b-1", "q3": "b-1"}
    assert out.where("query_id = 'q1' AND rank = 1").first().score == 100.0


def test_fusion_missing_photo_is_neutral(spark):
    items = spark.createDataFrame([("kaberne", "f1"), ("saperavi", "f2")], "slug string, family string")
    ev = spark.createDataFrame([("q", "photo", "kaberne", 0.8, 1), ("q", "text", "saperavi", 96.0, 1)], "query_id string, source string, slug string, score double, rank int")
    bonus = spark.createDataFrame([("q", "saperavi", 1.5)], "query_id string, slug string, bonus double")
    out = got(fusion.fuse(ev, items, fusion.FusionConfig(top_k=1), bonus).select("rank", "slug", "display_score"))
    assert out[0] == (1, "saperavi", 100.0)
    with pytest.raises(ValueError):
        fusion.FusionConfig(mode="zscore")


def test_family_budget_skips_what_does_not_fit(spark):
    items = spark.createDataFrame([(s, f) for f, n in (("a", 4), ("b", 2)) for s in (f"{f}{i}" for i in range(n))], "slug string, family string")
    ev = spark.createDataFrame([("q", "text", "a0", 9.0, 1), ("q", "text", "b0", 8.0, 2)], "query_id string, source string, slug string, score double, rank int")
    out = {r.slug for r in fusion.fuse(ev, items, fusion.FusionConfig(max_candidates=3)).collect()}
    assert out == {"a0", "b0", "b1"}


def test_hamming_pairs(spark):
    rows = spark.createDataFrame([(0, 0b0000, "a"), (1, 0b0001, "b"), (2, 0b11110000, "c"), (3, 0b11110001, "c"), (4, None, "d"), (5, -1, "e"), (6, -2, "f")], "id int, h long, owner string")
    pairs = got(similarity.hamming_pairs(rows, "id", "h", "owner", 6))
    brute = [(0, 1, 1), (0, 2, 4), (0, 3, 5), (1, 2, 5), (1, 3, 4), (5, 6, 1)]
    assert pairs == brute
    assert got(similarity.hamming_band(rows, "id", "h", "owner", 4, 4)) == [(0, 2, 4), (1, 3, 4)]
    assert [r.id for r in similarity.without_duplicates(rows, "id", similarity.hamming_pairs(rows, "id", "h", "owner", 2)).orderBy("id").collect()] == [2, 3, 4]


def test_cosine_ties_and_nulls(spark):
    g = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "item_id int, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "query_id int, embedding array<double>")
    assert got(similarity.cosine_top_k(q, g, 2).select("query_id", "item_id", "rank")) == [(9, 1, 1), (9, 2, 2)]


def test_reports(spark):
    p = spark.createDataFrame([("q1", "known", "a", "accepted", "a", ["a"]), ("q2", "unknown", None, "accepted", "b", ["b"]), ("q3", "known", "c", "ambiguous", None, ["x", "c"])],
                              "query_id string, gt_status string, gt_slug string, status string, slug string, candidates array<string>")
    m = {r.metric: (r.numerator, r.denominator) for r in report.recognition_report(p).collect()}
    assert m["exact_accuracy"] == (1, 2) and m["accepted_precision"] == (1, 2) and m["recall_at_5"] == (2, 2) and m["unknown_false_accept"] == (1, 1)
    o = spark.createDataFrame([("АлИГОтё", None), ("abc", "abc")], "r string, p string")
    e = report.error_rates(o, "r", "p").first()
    assert (e.char_edits, e.word_edits, e.n_missing) == (7, 1, 1)


def test_leakage_counts_nulls(spark):
    a, b = spark.createDataFrame([("g", None)], "grp string, h string"), spark.createDataFrame([("x", None)], "grp string, h string")
    assert got(audit.leakage(a, b, ["grp", "h"])) == [("shared_h", "<null>")]


def test_jobs(spark):
    log = spark.createDataFrame([("j", t, e) for t, e in enumerate(["reserve", "reserved", "uploaded", "result", "stored", "error"])] + [("k", 0, "error"), ("k", 1, "reserve")], "job string, ts int, event string")
    assert got(jobs.replay(log, "job", "ts", "ts", "event")) == [("j", "done", 6), ("k", "failed", 2)]
    queue = spark.createDataFrame([("a", "queued")], "key string, state string")
    new = spark.createDataFrame([("a", "queued"), ("b", "queued"), ("b", "queued")], "key string, state string")
    assert got(jobs.enqueue(queue, new, "key", 2)) == [("a", "queued"), ("b", "queued")]
    with pytest.raises(Exception, match="full"):
        jobs.enqueue(queue, new, "key", 1).collect()


def test_entities(spark):
    df = spark.createDataFrame([(1, "Grand Cuvee", 2019), (2, "Grand Cuvée", 2019), (3, "Grand Cuvee", 2020), (4, "Other", 2019)], "id int, name string, year int")
    assert dict(got(entity.cluster_records(df, "id", "name", "year"))) == {1: 1, 2: 1, 3: 3, 4: 4}
    look = spark.createDataFrame([(1, 0, "abv", "14.0", 0.6, "x"), (1, 1, "abv", "13.5", 0.9, "y"), (1, 2, "abv", "12", 0.9, "z"), (1, 3, "abv", None, 1.0, "w")], "record_id int, lookup int, field string, value string, confidence double, source string")
    assert got(entity.merge_fields(look)) == [(1, "abv", "13.5", 0.9, "y")]


def test_media_names(spark):
    f = spark.createDataFrame([("thumbnail_a_0123456789.jpg",), ("a_0123456789.jpg",)], "name string")
    assert got(media.with_family(f, "name").select("stem", "family", "rendition")) == [("a", "a_0123456789.jpg", "original"), ("a", "a_0123456789.jpg", "thumbnail")]


def test_client(spark):
    df = spark.createDataFrame([("a", "Красное сухое", "сухое", ["x", "y", "z", "w"])], "slug string, category string, sweet string, grapes array<string>")
    row = df.select(client.category_line(F.col("category"), F.col("sweet")), client.grape_line(F.col("grapes")), client.screen(F.lit("uncertain"), F.col("slug"), F.lit(2)), client.reasons(F.lit(True), F.lit(None).cast("boolean"), F.lit(True))).first()
    assert tuple(row) == ("Красное сухое", "x, y +2", "offer", ["same_manufacturer", "same_category"])
    with pytest.raises(ValueError):
        client.page(df, [F.asc("slug")], 0, 0)


def test_splits(spark):
    df = spark.createDataFrame([("фанагория",)], "p string")
    assert df.select(splits.hashed_share(F.col("p")), splits.hashed_split(F.col("p"))).first() == (0, "train")


def test_recommenders():
    import numpy as np

    x = np.array([[0.0], [1.0], [2.0]])
    mean, var = recommend.gp_posterior(x, np.array([1.0, 2.0, 3.0]), x, 1.0, 1e-6)
    assert np.allclose(mean, [1, 2, 3], atol=1e-3) and (var < 1e-3).all()
    assert recommend.farthest_points(np.array([[0.0], [1.0], [5.0]]), 2) == [0, 2]
    assert np.allclose(recommend.diffusion(recommend.path_laplacian(3), 0.0), np.eye(3))
    assert recommend.expected_improvement(np.array([1.0]), np.array([0.0]), 0.5) == pytest.approx(0.5)
    p = np.exp(recommend.ordinal_log_likelihood(np.zeros(3), np.array([0, 1, 2]), np.array([-1.0, 1.0])))
    assert p.sum() == pytest.approx(1)


def test_resolve_finds_every_pair_that_reaches_the_bar(spark):
    import difflib
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé xy") for _ in range(rng.randint(0, 9))).strip()
    items = [(i, word(), word(), rng.choice([None, 1990, 2000])) for i in range(120)] + [(800, "chateau", "margaux", None), (801, None, "x", None)]
    records = [(i, f"{p}a" if p and i % 2 else p, (n or "")[1:], y) for i, p, n, y in items] + [(900, "Chateaux", "Margeaux", None), (901, None, None, None)]
    same = lambda a, b: difflib.SequenceMatcher(None, a.casefold(), b.casefold()).ratio() if a and b else 0.0
    want = {}
    for k, p, n, y in records:
        best = max(((0.6 * same(p, q) + 0.4 * same(n, m)) * (0.5 if y and z and y != z else 1), -i) for i, q, m, z in items)
        want[k] = (-best[1], round(best[0], 9)) if best[0] >= 0.8 else (None, 0.0)
    d = lambda rows, i: spark.createDataFrame(rows, f"{i} int, producer string, name string, year int")
    out = {r.record_id: (r.item_id, round(r.score, 9)) for r in entity.resolve(d(records, "record_id"), d(items, "item_id")).collect()}
    assert out == want and out[900][0] == 800 and sum(v[0] is not None for v in out.values()) > 40


def test_short_and_listed_aliases(spark):
    from lakefold.operators import policy

    lines = spark.createDataFrame([(1, "Zeta, xy, abc"), (2, "Alpha, abd, q")], "line_no int, value string")
    table = catalog.aliases(lines, positions=True)
    texts = spark.createDataFrame([(1, "the xy wine"), (2, "abd abc"), (3, "iq"), (4, "none"), (5, "")], "id int, t string")
    assert sorted(tuple(r) for r in policy.alias_in_text(texts, table, "id", "t", False).collect()) == [(1, "zeta"), (2, "zeta"), (3, "alpha")]


def test_temporal_split_keeps_the_whole_suffix(spark):
    df = spark.createDataFrame([(u, k, k) for u, n in ((1, 9), (2, 4), (3, 5)) for k in range(n)], "user int, ts int, id int")
    out = splits.temporal_split(df, "user", "ts", "id", 3, 2).groupBy("user", "role").count()
    assert got(out) == [(1, "test", 6), (1, "train", 3), (3, "test", 2), (3, "train", 3)]
