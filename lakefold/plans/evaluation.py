"""Audits, reports and paired comparisons. Documents and their labels stand for manifests and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakefold.functions import geometry as G
from lakefold.operators import audit, report, splits
from lakefold.plans.book import Book, Tables

BOOK = Book()


def manifest(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels, "doc_id", "left")
    status = F.when(F.col("quality") == 1, "known").when(F.col("quality") == 0, "unknown").otherwise("ambiguous")
    return d.select(
        F.when(F.col("doc_id") % 97 != 0, F.concat(F.lit("d"), (F.col("doc_id") % 900).cast("string"))).alias("query_id"), F.col("source").alias("source_group"),
        F.when(F.col("doc_id") % 5 == 0, "test").when(F.col("doc_id") % 211 == 0, "dev").otherwise("train").alias("split"), F.sha2("text", 256).alias("image_sha256"), status.alias("gt_status"),
        F.when(F.col("quality") == 1, (F.col("doc_id") % 3000).cast("string")).alias("gt_slug"), F.when(F.col("doc_id") % 31 != 0, "label").alias("gt_source"), "doc_id",
    )


SQL_MANIFEST = """m AS (SELECT CASE WHEN doc_id % 97 <> 0 THEN 'd' || (doc_id % 900) END AS query_id, source AS source_group, CASE WHEN doc_id % 5 = 0 THEN 'test' WHEN doc_id % 211 = 0 THEN 'dev' ELSE 'train' END AS split,
sha256(text) AS image_sha256, CASE quality WHEN 1 THEN 'known' WHEN 0 THEN 'unknown' ELSE 'ambiguous' END AS gt_status, CASE WHEN quality = 1 THEN CAST(doc_id % 3000 AS VARCHAR) END AS gt_slug, CASE WHEN doc_id % 31 <> 0 THEN 'label' END AS gt_source, doc_id
FROM documents LEFT JOIN labels USING (doc_id)), g AS (SELECT sha256(text) AS image_sha256 FROM documents WHERE source = 'src3')"""


@BOOK.add(f"""WITH {SQL_MANIFEST} SELECT DISTINCT * FROM (
SELECT 'query_id_missing' AS error, '' AS key FROM m WHERE query_id IS NULL
UNION ALL SELECT 'query_id_repeated', query_id FROM m WHERE query_id IS NOT NULL GROUP BY query_id HAVING count(*) > 1
UNION ALL SELECT 'source_group_across_splits', source_group FROM m GROUP BY source_group HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'split_invalid', query_id FROM m WHERE split = 'dev'
UNION ALL SELECT 'hash_across_splits', image_sha256 FROM m GROUP BY image_sha256 HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'gallery_leak_by_hash', query_id FROM m WHERE image_sha256 IN (SELECT image_sha256 FROM g)
UNION ALL SELECT 'known_without_slug_or_source', query_id FROM m WHERE gt_status = 'known' AND gt_source IS NULL
UNION ALL SELECT 'known_slug_not_in_catalog', query_id FROM m WHERE gt_status = 'known' AND gt_slug NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part))""")
def manifest_errors(t: Tables) -> DataFrame:
    gallery = t.documents.where("source = 'src3'").select(F.sha2("text", 256).alias("image_sha256"), F.lit(None).cast("string").alias("source_group"))
    return audit.query_manifest_errors(manifest(t), t.part.select(F.col("p_partkey").cast("string").alias("slug")), gallery)


@BOOK.add(f"""WITH {SQL_MANIFEST}, a AS (SELECT * FROM m WHERE split = 'test'), b AS (SELECT * FROM m WHERE split <> 'test')
SELECT 'shared_source_group' AS error, source_group AS key FROM (SELECT source_group FROM a INTERSECT SELECT source_group FROM b)
UNION ALL SELECT 'shared_image_sha256', image_sha256 FROM (SELECT image_sha256 FROM a INTERSECT SELECT image_sha256 FROM b)
UNION ALL SELECT 'shared_gt_slug', coalesce(gt_slug, '<null>') FROM (SELECT gt_slug FROM a INTERSECT SELECT gt_slug FROM b)""")
def split_leakage(t: Tables) -> DataFrame:
    m = manifest(t)
    return audit.leakage(m.where("split = 'test'"), m.where("split <> 'test'"), ["source_group", "image_sha256", "gt_slug"])


@BOOK.add("""WITH q AS (SELECT conv_id AS query_id, min(text) AS text, list(turn * 13 ORDER BY turn) AS ids FROM conversations GROUP BY conv_id)
SELECT DISTINCT * FROM (SELECT 'relevant_unknown' AS error, CAST(query_id AS VARCHAR) AS key FROM (SELECT query_id, unnest(ids) AS i FROM q) WHERE i NOT IN (SELECT page_id FROM pages WHERE url LIKE 'https:%')
UNION ALL SELECT 'hard_negative_missing', CAST(query_id AS VARCHAR) FROM q WHERE query_id % 10 = 0)""")
def retrieval_manifest_errors(t: Tables) -> DataFrame:
    q = t.conversations.groupBy(F.col("conv_id").alias("query_id")).agg(F.min("text").alias("text"), F.collect_list(F.col("turn") * 13).alias("relevant_ids"))
    q = q.withColumn("hard_negative", F.when(F.col("query_id") % 10 != 0, False))
    return audit.retrieval_manifest_errors(q, t.pages.where("url LIKE 'https:%'").select(F.col("page_id").alias("image_id")))


@BOOK.add("SELECT count(DISTINCT l_partkey) AS covered, (SELECT count(DISTINCT p_partkey) FROM part) AS total, count(DISTINCT l_partkey)::DOUBLE / (SELECT count(DISTINCT p_partkey) FROM part) AS ratio FROM lineitem WHERE l_quantity > 45 AND l_partkey IN (SELECT p_partkey FROM part)")
def catalog_coverage(t: Tables) -> DataFrame:
    return audit.coverage(t.lineitem.where("l_quantity > 45"), t.part, "l_partkey", "p_partkey")


@BOOK.add("SELECT doc_id, CASE WHEN n_chars < 100 THEN 'too_short' WHEN n_chars > 5000 THEN 'too_long' WHEN lang <> 'en' THEN 'language' END AS reason FROM documents")
def first_reasons(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", audit.first_reason([("too_short", F.col("n_chars") < 100), ("too_long", F.col("n_chars") > 5000), ("language", F.col("lang") != "en")]).alias("reason"))


@BOOK.add("""WITH a AS (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE lang <> 'de'), b AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE text END) AS h FROM documents WHERE lang <> 'fr')
SELECT path, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'unexpected' ELSE 'changed' END AS status FROM a FULL JOIN b USING (path) WHERE a.h IS DISTINCT FROM b.h""")
def inventory_changes(t: Tables) -> DataFrame:
    digest = F.sha2(F.col("text"), 256).alias("sha256")
    b = F.sha2(F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("text")), 256).alias("sha256")
    return audit.inventory_difference(t.documents.where("lang <> 'de'").select(F.col("doc_id").alias("path"), digest), t.documents.where("lang <> 'fr'").select(F.col("doc_id").alias("path"), b), "path", "sha256")


def predictions(t: Tables) -> DataFrame:
    m = manifest(t).where("query_id IS NOT NULL")
    guess = F.when(F.col("doc_id") % 4 == 0, F.lit("0")).otherwise((F.col("doc_id") % 3000).cast("string"))
    candidates = F.array(F.when(F.col("doc_id") % 3 == 0, "9").otherwise(guess), guess, F.lit("1"))
    status = F.when(F.col("doc_id") % 5 < 3, "accepted").when(F.col("doc_id") % 5 == 3, "ambiguous").otherwise("unknown")
    return m.select("doc_id", "gt_status", "gt_slug", status.alias("status"), F.when(status == "accepted", guess).alias("slug"), candidates.alias("candidates"))


SQL_PREDICTIONS = f"""{SQL_MANIFEST}, p0 AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN '0' ELSE CAST(doc_id % 3000 AS VARCHAR) END AS guess FROM m WHERE query_id IS NOT NULL),
p AS (SELECT doc_id, gt_status, gt_slug, CASE WHEN doc_id % 5 < 3 THEN 'accepted' WHEN doc_id % 5 = 3 THEN 'ambiguous' ELSE 'unknown' END AS status, CASE WHEN doc_id % 5 < 3 THEN guess END AS slug, [CASE WHEN doc_id % 3 = 0 THEN '9' ELSE guess END, guess, '1'] AS c FROM p0)"""


@BOOK.add(f"""WITH {SQL_PREDICTIONS}, r AS (SELECT 'exact_accuracy' AS metric, count(*) FILTER (gt_status = 'known' AND status = 'accepted' AND slug = gt_slug) AS numerator, count(*) FILTER (gt_status = 'known') AS denominator FROM p
UNION ALL SELECT 'accepted_precision', count(*) FILTER (gt_status = 'known' AND status = 'accepted' AND slug = gt_slug), count(*) FILTER (gt_status <> 'ambiguous' AND status = 'accepted') FROM p
UNION ALL SELECT 'coverage', count(*) FILTER (status = 'accepted'), count(*) FROM p UNION ALL SELECT 'unknown_false_accept', count(*) FILTER (gt_status = 'unknown' AND status = 'accepted'), count(*) FILTER (gt_status = 'unknown') FROM p
UNION ALL SELECT 'recall_at_' || k, count(*) FILTER (gt_status = 'known' AND list_contains(c[1:k], gt_slug)), count(*) FILTER (gt_status = 'known') FROM p, (VALUES (1), (5), (20)) v(k) GROUP BY k)
SELECT *, numerator::DOUBLE / nullif(denominator, 0) AS value FROM r""")
def recognition_report(t: Tables) -> DataFrame:
    return report.recognition_report(predictions(t))


@BOOK.add(f"WITH {SQL_PREDICTIONS} SELECT status, count(*) AS n FROM p GROUP BY status")
def status_histogram(t: Tables) -> DataFrame:
    return report.status_histogram(predictions(t))


@BOOK.add("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, min(value) AS lowest, max(value) FILTER (i = floor((n - 1) * 0.5)) AS p50, max(value) FILTER (i = floor((n - 1) * 0.95)) AS p95, max(value) FILTER (i = floor((n - 1) * 0.99)) AS p99, max(value) AS highest, round(avg(value), 6) AS mean FROM s GROUP BY event_type""")
def latency_report(t: Tables) -> DataFrame:
    return report.latency(t.events, ["event_type"], "value").withColumn("mean", F.round("mean", 6))


@BOOK.add("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (i = floor((n - 1) * 0.95)) AS p95_floor, quantile_disc(value, 0.95) AS p95_ceil, max(value) FILTER (i = (n - 1) // 2) AS p50_lower, max(value) FILTER (i = n // 2) AS p50_upper, round(quantile_cont(value, 0.95), 6) AS p95_linear FROM s GROUP BY event_type""")
def percentile_definitions(t: Tables) -> DataFrame:
    return report.percentile_definitions(t.events, ["event_type"], "value").withColumn("p95_linear", F.round("p95_linear", 6))


@BOOK.add("""SELECT p_brand, count(*) AS n, sum(levenshtein(p_name, lower(p_type)))::BIGINT AS char_edits, sum(length(p_name))::BIGINT AS chars, round(sum(levenshtein(p_name, lower(p_type)))::DOUBLE / sum(length(p_name)), 9) AS cer FROM part GROUP BY p_brand""")
def character_error_rate(t: Tables) -> DataFrame:
    return report.error_rates(t.part, "p_name", "p_type", ["p_brand"]).select("p_brand", "n", "char_edits", "chars", F.round("cer", 9).alias("cer"))


@BOOK.add(f"""WITH {SQL_PREDICTIONS}, a AS (SELECT * FROM p), b AS (SELECT doc_id, gt_slug, CASE WHEN doc_id % 6 = 0 THEN gt_slug ELSE slug END AS slug FROM p)
SELECT count(*) FILTER (x AND y) AS both, count(*) FILTER (NOT x AND y) AS helped, count(*) FILTER (x AND NOT y) AS harmed, count(*) FILTER (NOT x AND NOT y) AS neither, count(*) FILTER (sa IS DISTINCT FROM sb) AS changed_top, count(*) AS n
FROM (SELECT coalesce(a.slug = a.gt_slug, false) AS x, coalesce(b.slug = b.gt_slug, false) AS y, a.slug AS sa, b.slug AS sb FROM a JOIN b USING (doc_id))""")
def paired_outcomes(t: Tables) -> DataFrame:
    a = predictions(t).select("doc_id", "gt_slug", "slug")
    b = a.withColumn("slug", F.when(F.col("doc_id") % 6 == 0, F.col("gt_slug")).otherwise(F.col("slug")))
    paired, _ = report.pair(a, b, "doc_id", ["gt_slug"], ["slug"])
    return report.paired_outcomes(paired, F.col("slug_a") == F.col("gt_slug_a"), F.col("slug_b") == F.col("gt_slug_b"), F.col("slug_a"), F.col("slug_b"))


@BOOK.add("""SELECT doc_id, 'in_one_run' AS error FROM documents WHERE source = 'src3' UNION ALL SELECT doc_id, 'lang_differs' FROM documents WHERE source <> 'src3' AND doc_id % 7 = 0 AND lang <> 'en'""")
def pairing_errors(t: Tables) -> DataFrame:
    b = t.documents.where("source <> 'src3'").withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "en").otherwise(F.col("lang")))
    return report.pair(t.documents, b, "doc_id", ["lang"], ["n_chars"])[1]


@BOOK.add()
def bootstrap_intervals(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels, "doc_id").select("lang", "source", F.col("quality").alias("num"), F.lit(1).alias("den"))
    return report.cluster_interval(d, ["lang"], "source", "num", "den")


def boxes(t: Tables) -> DataFrame:
    q, s = F.col("l_quantity").cast("int"), F.col("l_suppkey").cast("int")
    return t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber", F.lit(0).alias("ax0"), F.lit(0).alias("ay0"), (q + 5).alias("ax1"), (s % 40 + 5).alias("ay1"), (q % 7).alias("bx0"), (s % 5).alias("by0"), (q + 2).alias("bx1"), (s % 40 + 9).alias("by1"))


@BOOK.add("""WITH b AS (SELECT l_returnflag, l_quantity::INT AS q, l_suppkey::INT AS s FROM lineitem),
r AS (SELECT l_returnflag, round_even((greatest(0, least(q + 5, q + 2) - q % 7) * greatest(0, least(s % 40 + 5, s % 40 + 9) - s % 5))::DOUBLE / ((q + 5) * (s % 40 + 5)), 4) AS v FROM b)
SELECT l_returnflag, count(v) AS n, min(v) AS lowest, round(avg(v), 6) AS mean, count(*) FILTER (v < 0.9) AS n_below FROM r GROUP BY l_returnflag""")
def retention_report(t: Tables) -> DataFrame:
    kept = boxes(t).withColumn("v", G.retention(G.Box.named("a"), G.Box.named("b")))
    return report.retention_report(kept, ["l_returnflag"], "v").withColumn("mean", F.round("mean", 6))


@BOOK.add("""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS q, l_suppkey::INT AS s FROM lineitem),
r AS (SELECT *, greatest(0, q + 2 - q % 7) * greatest(0, s % 40 + 5 - s % 5) AS i, (q + 5) * (s % 40 + 5) AS a, greatest(0, q + 2 - q % 7) * (s % 40 + 9 - s % 5) AS bb FROM b)
SELECT l_orderkey, l_linenumber, round(i::DOUBLE / (a + bb - i), 9) AS iou FROM r""")
def box_overlap(t: Tables) -> DataFrame:
    return boxes(t).select("l_orderkey", "l_linenumber", F.round(G.iou(G.Box.named("a"), G.Box.named("b")), 9).alias("iou"))


def ratings(t: Tables) -> DataFrame:
    return t.events.select("user_id", F.get_json_object("props", "$.k").cast("int").alias("item"), "ts", "event_id", "event_type", F.col("value"), (F.col("value") % 5).alias("rating"))


@BOOK.add("SELECT user_id, (props->>'$.k')::INT AS item, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY ALL")
def last_events(t: Tables) -> DataFrame:
    return splits.last_events(ratings(t), ["user_id", "item"], "ts", "event_id").select("user_id", "item", "event_id", "ts")


@BOOK.add("""WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, user_id, CASE WHEN i <= 5 THEN 'train' ELSE 'test' END AS role FROM r WHERE n >= 8""")
def temporal_split(t: Tables) -> DataFrame:
    return splits.temporal_split(t.events, "user_id", "ts", "event_id", 5, 3).select("event_id", "user_id", "role")


@BOOK.add("SELECT e.event_id, e.user_id FROM events e JOIN (SELECT user_id, max(ts) AS c FROM events WHERE event_type = 'signup' GROUP BY user_id) s USING (user_id) WHERE e.event_type <> 'signup' AND e.ts > c")
def events_after_support(t: Tables) -> DataFrame:
    return splits.after_cutoff(t.events, "user_id", "ts", F.col("event_type") == "signup").select("event_id", "user_id")


@BOOK.add("SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id ORDER BY ts DESC, user_id LIMIT 12")
def recent_users(t: Tables) -> DataFrame:
    return splits.recent(t.events.select("user_id", "ts"), "user_id", "ts", 12)


@BOOK.add("""WITH r AS (SELECT user_id, event_id, value AS s, greatest(value % 5 - 1, 0) AS g FROM events), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY g DESC, event_id) AS b FROM r)
SELECT user_id, round(sum(CASE WHEN a <= 10 THEN g / log2(a + 1) ELSE 0 END) / nullif(sum(CASE WHEN b <= 10 THEN g / log2(b + 1) ELSE 0 END), 0), 6) AS ndcg FROM p GROUP BY user_id""")
def ndcg_at_10(t: Tables) -> DataFrame:
    r = ratings(t).withColumn("gain", F.greatest(F.col("rating") - 1, F.lit(0.0)))
    return report.ndcg(r, "user_id", "value", "gain", "event_id", 10).withColumn("ndcg", F.round("ndcg", 6))


@BOOK.add("""WITH r AS (SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0 AS x, rank() OVER (PARTITION BY user_id ORDER BY value % 5) + (count(*) OVER (PARTITION BY user_id, value % 5) - 1) / 2.0 AS y FROM events)
SELECT user_id, round(CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) ELSE 0 END, 6) AS rho FROM r GROUP BY user_id""")
def spearman_by_user(t: Tables) -> DataFrame:
    return report.spearman(ratings(t), "user_id", "value", "rating").withColumn("rho", F.round("rho", 6))


@BOOK.add("""WITH s AS (SELECT q.vec_id AS q, q.label AS truth, g.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.embedding::DOUBLE[], g.embedding::DOUBLE[]) DESC, g.vec_id) AS rank FROM embeddings q JOIN embeddings g ON q.vec_id % 100 = 0),
h AS (SELECT q, min(rank) FILTER (label = truth) AS first FROM s GROUP BY q) SELECT 'hit_at_' || k AS metric, count(*) FILTER (first <= k) AS numerator, count(*) AS denominator, count(*) FILTER (first <= k)::DOUBLE / count(*) AS value FROM h, (VALUES (1), (5)) v(k) GROUP BY k""")
def retrieval_hits(t: Tables) -> DataFrame:
    from lakefold.operators import similarity
    from lakefold.plans.retrieval import vectors

    q, g = vectors(t)
    ranked = similarity.cosine_top_k(q, g, 5).join(g.select("item_id", "label"), "item_id")
    return report.hits_at(ranked, q.select("query_id", F.col("truth").alias("label")), "query_id", "label", "rank", (1, 5))
