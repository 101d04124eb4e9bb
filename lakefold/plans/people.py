"""Recommendation, entity, encoder, media, client and job queries. Events stand for ratings and job logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakefold.operators import client, entity, jobs, media, recommend
from lakefold.plans.book import Book, Tables
from lakefold.plans.evaluation import ratings

BOOK = Book()


@BOOK.add("SELECT user_id, count(*) AS n, round((sum(value) + 5 * (SELECT avg(value) FROM events)) / (count(*) + 5), 6) AS score FROM events GROUP BY user_id")
def shrunken_user_means(t: Tables) -> DataFrame:
    return recommend.shrunken_mean(t.events, "user_id", "value").select("user_id", "n", F.round("score", 6).alias("score"))


SQL_RATED = "i AS (SELECT vec_id AS item, embedding::DOUBLE[] AS v FROM embeddings), e AS (SELECT user_id, (props->>'$.k')::INT AS item, value % 5 AS rating, event_type FROM events), tr AS (SELECT * FROM e WHERE event_type <> 'signup'), te AS (SELECT DISTINCT user_id, item FROM e WHERE event_type = 'signup')"


def rated(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = ratings(t)
    return r.where("event_type <> 'signup'"), r.where("event_type = 'signup'").select("user_id", "item").distinct(), t.embeddings.select(F.col("vec_id").cast("int").alias("item"), "embedding")


@BOOK.add(f"""WITH {SQL_RATED}, m AS (SELECT user_id, avg(rating) AS mean FROM tr GROUP BY user_id),
s AS (SELECT te.user_id, te.item, m.mean, greatest(0, list_inner_product(a.v, b.v)) AS s, tr.rating - m.mean AS gap FROM te JOIN i b ON b.item = te.item JOIN tr ON tr.user_id = te.user_id JOIN m ON m.user_id = te.user_id JOIN i a ON a.item = tr.item)
SELECT user_id, item, round(max(mean) + coalesce(sum(s * gap) / nullif(sum(s), 0), 0), 5) AS score FROM s GROUP BY ALL""")
def content_neighbours(t: Tables) -> DataFrame:
    train, test, items = rated(t)
    return recommend.content_neighbours(train, items, test, "user_id", "item", "rating", "embedding").withColumn("score", F.round("score", 5))


@BOOK.add()
def ridge_predictions(t: Tables) -> DataFrame:
    train, test, items = rated(t)
    mean = recommend.shrunken_mean(train, "item", "rating").select("item", F.col("score").alias("prior"))
    with_prior = lambda d: d.join(items, "item").join(mean, "item").select("user_id", "item", "embedding", "prior", *(["rating"] if "rating" in d.columns else []))
    return recommend.ridge_scores(with_prior(train), with_prior(test), "user_id", "item", "rating", "embedding", "prior")


@BOOK.add()
def gaussian_process_predictions(t: Tables) -> DataFrame:
    train, test, items = rated(t)
    return recommend.gp_scores(train.join(items, "item").select("user_id", "item", "rating", "embedding"), test.join(items, "item"), "user_id", "item", "rating", "embedding")


@BOOK.add("""WITH r AS (SELECT user_id, value % 5 AS v, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS p FROM events) SELECT user_id, round(avg(CASE WHEN v >= 4 THEN 1.0 ELSE 0 END), 9)::DOUBLE AS share FROM r WHERE p <= 5 GROUP BY user_id""")
def top_5_share(t: Tables) -> DataFrame:
    return recommend.top_share(ratings(t), "user_id", "value", "rating", "event_id").withColumn("share", F.round("share", 9))


@BOOK.add()
def record_clusters(t: Tables) -> DataFrame:
    return entity.cluster_records(t.part, "p_partkey", "p_name", "p_size", 0.8)


@BOOK.add()
def resolved_records(t: Tables) -> DataFrame:
    side = lambda d, i: d.select(F.col("p_partkey").alias(i), F.col("p_brand").alias("producer"), F.col("p_name").alias("name"), F.col("p_size").alias("year"))
    return entity.resolve(side(t.part.where("p_partkey % 100 = 0"), "record_id"), side(t.part, "item_id"))


def looked_up(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("record_id"), (F.col("l_linenumber") * 100_000 + F.col("l_partkey")).alias("lookup"), F.col("l_returnflag").alias("field"), F.when(F.col("l_quantity") > 5, F.col("l_partkey").cast("string")).alias("value"),
        (F.col("l_quantity").cast("int") % 10 / 10.0).alias("confidence"), F.col("l_linestatus").alias("source"),
    )


SQL_LOOKUPS = "l AS (SELECT l_orderkey AS record_id, l_linenumber * 100000 + l_partkey AS lookup, l_returnflag AS field, CASE WHEN l_quantity > 5 THEN CAST(l_partkey AS VARCHAR) END AS value, (l_quantity::INT % 10 / 10.0)::DOUBLE AS confidence, l_linestatus AS source, l_partkey, l_suppkey FROM lineitem)"


@BOOK.add(f"WITH {SQL_LOOKUPS} SELECT record_id, field, value, confidence FROM (SELECT *, row_number() OVER (PARTITION BY record_id, field ORDER BY confidence DESC, lookup) AS r FROM l WHERE value IS NOT NULL) WHERE r = 1")
def merged_fields(t: Tables) -> DataFrame:
    return entity.merge_fields(looked_up(t)).select("record_id", "field", "value", "confidence")


@BOOK.add(f"WITH {SQL_LOOKUPS} SELECT field, round(1 - count(value)::DOUBLE / (SELECT count(*) FROM lineitem), 9) AS missing_rate, round(avg(confidence), 9) AS mean_confidence FROM l GROUP BY field")
def field_quality(t: Tables) -> DataFrame:
    return entity.quality_report(looked_up(t), t.lineitem).select("field", F.round("missing_rate", 9).alias("missing_rate"), F.round("mean_confidence", 9).alias("mean_confidence"))


@BOOK.add(f"""WITH {SQL_LOOKUPS} SELECT field, source, count(*) AS n, round(avg(CASE WHEN l_partkey = l_suppkey THEN 1.0 ELSE 0 END), 9)::DOUBLE AS exact, round(avg(abs(l_partkey - l_suppkey)), 6) AS mae, round(avg(CASE WHEN confidence >= 0.7 THEN 1.0 ELSE 0 END), 9)::DOUBLE AS retained FROM l GROUP BY field, source""")
def field_audit(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_returnflag").alias("field"), F.col("l_linestatus").alias("source"), F.col("l_partkey").cast("string").alias("predicted"), F.col("l_suppkey").cast("string").alias("truth"), (F.col("l_quantity").cast("int") % 10 / 10.0).alias("confidence"))
    return entity.field_audit(rows).select("field", "source", "n", F.round("exact", 9).alias("exact"), F.round("mae", 6).alias("mae"), F.round("retained", 9).alias("retained"))


@BOOK.add("SELECT p_brand AS value, count(*) AS n, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM part GROUP BY p_brand")
def factorized_brands(t: Tables) -> DataFrame:
    return entity.factorize(t.part, "p_brand")


@BOOK.add("""WITH x AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice END AS v FROM part), f AS (SELECT * FROM x WHERE p_size <= 40), m AS (SELECT quantile_cont(v, 0.5) AS med FROM f),
s AS (SELECT avg(coalesce(v, med)) AS mean, stddev_samp(coalesce(v, med)) AS sd FROM f, m) SELECT p_partkey, round((coalesce(v, med) - mean) / sd, 6) AS z, CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS missing FROM x, m, s""")
def standardized_prices(t: Tables) -> DataFrame:
    x = t.part.select("p_partkey", "p_size", F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice")).alias("v"))
    out = entity.standardize(x, x.where("p_size <= 40"), ["v"])
    return out.select("p_partkey", F.round("v_z", 6).alias("z"), F.col("v_missing").alias("missing"))


@BOOK.add("SELECT p_partkey, list_transform(range(0, 5), lambda i: CASE WHEN p_size % 7 > 4 THEN 0.2 WHEN i = p_size % 7 THEN 1.0 ELSE 0.0 END::DOUBLE) AS onehot FROM part")
def one_hot_sizes(t: Tables) -> DataFrame:
    coded = t.part.select("p_partkey", F.when(F.col("p_size") % 7 <= 4, F.col("p_size") % 7).otherwise(-1).alias("code"))
    return entity.one_hot(coded, "code", [0, 1, 2, 3, 4], [0.2] * 5).select("p_partkey", "onehot")


@BOOK.add("SELECT s_suppkey, [n_name, CASE WHEN s_acctbal > 0 THEN n_name || '/' || s_name END] AS levels FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def geography_levels(t: Tables) -> DataFrame:
    joined = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).withColumn("town", F.when(F.col("s_acctbal") > 0, F.col("s_name")))
    return joined.select("s_suppkey", entity.path_levels(["n_name", "town"]).alias("levels"))


def pictures(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_partkey").alias("item"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("path"), F.when(F.col("l_returnflag") == "A", "studio_front").otherwise("street").alias("view"), (F.col("l_quantity") > 40).alias("usable"))


@BOOK.add("""WITH x AS (SELECT l_partkey AS item, l_orderkey || '/' || l_linenumber AS path, l_returnflag FROM lineitem WHERE l_quantity > 40), o AS (SELECT item FROM x GROUP BY item HAVING count(DISTINCT path) >= 2 AND bool_or(l_returnflag <> 'A')) SELECT item, path FROM x WHERE item IN (SELECT item FROM o)""")
def contrastive_rows(t: Tables) -> DataFrame:
    return media.contrastive_rows(pictures(t), "item", "path", "view", "usable").select("item", "path")


@BOOK.add("""SELECT p_partkey, CASE WHEN p_size * 500 < 15360 AND p_size < 20 THEN 'too_small_file' WHEN p_size * 500000 > 12582912 AND p_size >= 20 THEN 'too_large_file' WHEN p_partkey % 11 = 0 THEN 'undecodable' WHEN p_size * 20 < 256 THEN 'short_side' END AS reason FROM part""")
def picture_usability(t: Tables) -> DataFrame:
    size = F.when(F.col("p_size") < 20, F.col("p_size") * 500).otherwise(F.col("p_size") * 500000)
    return t.part.select("p_partkey", media.usability(size, F.col("p_size") * 20, F.lit(1000), F.col("p_partkey") % 11 != 0).alias("reason"))


@BOOK.add()
def media_links(t: Tables) -> DataFrame:
    items = t.part.select(F.col("p_partkey").cast("string").alias("slug"), F.when(F.col("p_partkey") % 6 != 0, (F.col("p_partkey") % 1500).cast("string")).alias("photo_stem"))
    families = t.part.where("p_type <> 'ECONOMY'").select(F.col("p_partkey").cast("string").alias("stem"), F.concat("p_partkey", F.lit(".jpg")).alias("family"), (F.col("p_partkey") % 13 != 0).cast("int").alias("n_originals"), F.when(F.col("p_partkey") % 17 == 0, "image/gif").otherwise("image/jpeg").alias("mime"), F.lit(1000).alias("size"))
    return media.link(items, families)


@BOOK.add("SELECT sha256(text) AS digest, count(DISTINCT source) AS n_owners FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def shared_content(t: Tables) -> DataFrame:
    return media.shared_owners(t.documents.withColumn("digest", F.sha2("text", 256)), "digest", "source").select("digest", "n_owners")


def ranked(t: Tables) -> DataFrame:
    from lakefold.plans.retrieval import evidence

    e = evidence(t).where("source = 'text' AND rank <= 30").drop("source")
    return e.join(t.part.select(F.col("p_partkey").cast("string").alias("slug"), F.concat(F.lit("b"), F.col("p_size") % 4).alias("producer")), "slug")


SQL_RANKED = """r0 AS (SELECT p_partkey % 10 AS query_id, CAST(p_partkey AS VARCHAR) AS slug, (p_partkey * 7919 % 1000) / 10.0::DOUBLE AS score, 'b' || (p_size % 4) AS producer FROM part WHERE p_type <> 'ECONOMY'),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug) AS rank FROM r0 QUALIFY rank <= 30)"""


@BOOK.add(f"WITH {SQL_RANKED} SELECT query_id, slug, floor(score * 100 + 0.5) / 10000 AS confidence, floor((score - coalesce(n, 0)) * 100 + 0.5) / 10000 AS margin FROM (SELECT *, lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS n FROM r) WHERE rank = 1")
def scan_confidence(t: Tables) -> DataFrame:
    return client.top_with_margin(ranked(t), "query_id")


@BOOK.add(f"""WITH {SQL_RANKED}, t AS (SELECT query_id, slug AS ts, producer AS tp FROM r WHERE rank = 1), x AS (SELECT r.*, producer = tp AS same, bool_or(producer = tp) OVER (PARTITION BY query_id) AS any_same FROM r JOIN t USING (query_id) WHERE slug <> ts),
s AS (SELECT *, CASE WHEN any_same THEN same ELSE true END AS el FROM x), p AS (SELECT *, row_number() OVER (PARTITION BY query_id, el ORDER BY rank) AS place FROM s), sim AS (SELECT query_id, slug, 'similar' AS part, place FROM p WHERE el AND place <= 5),
alt AS (SELECT query_id, slug, 'alternative' AS part, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM p WHERE NOT same AND NOT (el AND place <= 5)) SELECT * FROM sim UNION ALL SELECT * FROM alt WHERE place <= 6""")
def similar_and_alternatives(t: Tables) -> DataFrame:
    return client.similar_and_alternatives(ranked(t), "query_id")


@BOOK.add("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40")
def catalog_page(t: Tables) -> DataFrame:
    return client.page(t.part.select("p_partkey", "p_name"), [F.asc("p_name"), F.asc("p_partkey")], 20, 40)


@BOOK.add("""WITH i AS (SELECT p_partkey AS slug, 'c' || (p_size % 3) AS c, 's' || (p_size % 2) AS s, string_split(p_name, ' ') AS g, 10 + p_size % 6 AS a FROM part)
SELECT slug, least(2, len(list_intersect(list_distinct(g), ['red', 'ring', 'small']))) AS points FROM i WHERE c IN ('c0', 'c1') AND s = 's1' AND a <= 14 ORDER BY points DESC, slug LIMIT 3""")
def dish_pairing(t: Tables) -> DataFrame:
    i = t.part.select(F.col("p_partkey").alias("slug"), F.concat(F.lit("c"), F.col("p_size") % 3).alias("colour"), F.concat(F.lit("s"), F.col("p_size") % 2).alias("sweetness"), F.split("p_name", " ").alias("grapes"), (10 + F.col("p_size") % 6).cast("double").alias("strength"))
    return client.pairing(i, ["c0", "c1"], ["s1"], ["red", "ring", "small"], 14.0).select("slug", "points")


def job_log(t: Tables) -> DataFrame:
    names = F.array(*(F.lit(e) for e in ("reserve", "reserved", "uploaded", "result", "stored", "error", "stale")))
    return t.events.select(F.col("user_id").alias("job"), "ts", "event_id", F.element_at(names, (F.col("event_id") % 7 + 1).cast("int")).alias("event"))


@BOOK.add()
def replayed_jobs(t: Tables) -> DataFrame:
    return jobs.replay(job_log(t), "job", "ts", "event_id", "event")


SQL_QUEUE = "q AS (SELECT o_orderkey AS key, (['ready', 'uploading', 'queued', 'submitted', 'done', 'failed'])[o_orderkey % 6 + 1] AS state, o_orderdate AS updated, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 600 SECOND END AS leased_until FROM orders)"


def queue(t: Tables) -> DataFrame:
    names = F.array(*(F.lit(s) for s in ("ready", "uploading", "queued", "submitted", "done", "failed")))
    return t.orders.select(F.col("o_orderkey").alias("key"), F.element_at(names, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("state"), F.col("o_orderdate").alias("updated"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate") + F.expr("INTERVAL 600 SECOND")).alias("leased_until"))


@BOOK.add(f"WITH {SQL_QUEUE} SELECT key, state FROM q WHERE state NOT IN ('done', 'failed') AND (leased_until IS NULL OR leased_until <= TIMESTAMP '1997-01-01') ORDER BY list_position(['ready', 'uploading', 'queued', 'submitted'], state), updated, key LIMIT 1")
def claimed_job(t: Tables) -> DataFrame:
    return jobs.claim(queue(t), "key", "updated", "leased_until", F.expr("TIMESTAMP '1997-01-01'")).select("key", "state")


@BOOK.add(f"WITH {SQL_QUEUE} SELECT key, state FROM q WHERE state <> 'ready' UNION ALL SELECT key, 'queued' FROM q WHERE state = 'ready' AND leased_until IS NULL")
def enqueued_jobs(t: Tables) -> DataFrame:
    q = queue(t)
    new = q.where("leased_until IS NULL").select("key", F.lit("queued").alias("state"))
    return jobs.enqueue(q.where("state <> 'ready'").select("key", "state"), new.unionByName(new), "key", 1 << 40)
