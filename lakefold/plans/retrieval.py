"""Catalog, search, fusion and similarity queries. Parts stand for catalog items and embeddings for their pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakefold.functions import arrays as A
from lakefold.functions import text as T
from lakefold.operators import catalog, fusion, search, similarity, splits
from lakefold.plans.book import Book, Tables

BOOK = Book()


def items(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("slug"), F.col("p_name").alias("name"), F.col("p_brand").alias("producer"), F.col("p_type").alias("category"), "p_size", "p_retailprice")


def tokens(*columns: str) -> Column:
    return T.evidence_tokens(T.canonical(catalog.field_text(*columns), T.native_fold))


SQL_TOKENS = "list_filter(regexp_extract_all(lower(concat_ws(' ', p_name, p_brand, p_type)), '[\\p{L}\\p{N}]+'), lambda x: length(x) > 2 AND NOT regexp_full_match(x, '[0-9]{3,4}') OR regexp_full_match(x, '(19|20)[0-9]{2}'))"
SQL_POSTINGS = f"post AS (SELECT DISTINCT p_partkey AS slug, unnest({SQL_TOKENS}) AS token FROM part), weights AS (SELECT token, count(*) AS df, ln(((SELECT count(*) FROM part) + 1) / (count(*) + 1)) + 1 AS idf FROM post GROUP BY token)"


@BOOK.add(f"""WITH {SQL_POSTINGS}, q AS (SELECT DISTINCT slug AS query_id, token FROM post WHERE slug % 100 = 0),
hit AS (SELECT query_id, slug, sum(idf) AS e FROM q JOIN weights USING (token) JOIN post USING (token) GROUP BY ALL),
r AS (SELECT *, 100 * e / max(e) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY round(e, 6) DESC, slug) AS rank FROM hit)
SELECT query_id, slug, round(e, 6) AS evidence, round(n, 6) AS evidence_norm, rank FROM r WHERE rank <= 5""")
def search_evidence(t: Tables) -> DataFrame:
    """Every hundredth item's text asks the whole catalog; the five with the most evidence."""
    w = items(t)
    found = tokens("name", "producer", "category")
    hits = search.top_evidence(w.where("slug % 100 = 0").withColumnRenamed("slug", "query_id"), "query_id", found, w, "slug", found, 5)
    return hits.withColumn("evidence_norm", F.round("evidence_norm", 6))


@BOOK.add(f"WITH {SQL_POSTINGS} SELECT token, df, round(idf, 6) AS idf FROM weights")
def token_idf(t: Tables) -> DataFrame:
    w = items(t)
    return search.idf(search.postings(w, "slug", tokens("name", "producer", "category")), "slug", w).select("token", "df", F.round("idf", 6).alias("idf"))


@BOOK.add()
def search_full(t: Tables) -> DataFrame:
    """The whole search: evidence, prefix extension, edit distance, fuzzy score, producer, total order."""
    w = items(t).select(F.col("slug").cast("string").alias("slug"), "name", "producer", catalog.field_text("name", "producer", "category").alias("field_text"), F.array(T.canonical(F.col("producer"), T.native_fold)).alias("producer_terms"))
    q = t.part.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.concat_ws("\n", "p_name", "p_brand").alias("text"))
    return search.search(q, w, search.SearchConfig(), T.native_fold)


@BOOK.add("""WITH g AS (SELECT p_name, count(*) AS n, count(DISTINCT (p_brand, p_type)) AS v FROM part GROUP BY p_name)
SELECT sum(n)::BIGINT AS rows, count(*) AS unique_keys, coalesce(sum(CASE WHEN v = 1 THEN n - 1 END), 0)::BIGINT AS exact_duplicates, count(*) FILTER (v > 1) AS conflicting_keys FROM g""")
def catalog_report(t: Tables) -> DataFrame:
    return catalog.deduplicate(t.part.select("p_name", "p_partkey", "p_brand", "p_type"), "p_name", "p_partkey")[1]


@BOOK.add("SELECT p_brand, p_type, p_size, count(DISTINCT p_partkey) AS n_members, list_sort(list(DISTINCT p_partkey)) AS members FROM part GROUP BY ALL HAVING count(DISTINCT p_partkey) > 1")
def equivalence_groups(t: Tables) -> DataFrame:
    return catalog.equivalence_groups(t.part, ["p_brand", "p_type", "p_size"], "p_partkey")


@BOOK.add("""WITH g AS (SELECT count(*) AS n FROM part GROUP BY p_brand, p_type, p_size HAVING count(*) > 1)
SELECT count(*) AS n_groups, coalesce(sum(n), 0)::BIGINT AS affected, coalesce(sum(n), 0)::DOUBLE / (SELECT count(*) FROM part) AS fraction, coalesce(max(n), 0) AS largest FROM g""")
def equivalence_statistics(t: Tables) -> DataFrame:
    return catalog.group_statistics(equivalence_groups(t), t.part)


@BOOK.add("SELECT p_partkey AS slug, p_brand || chr(31) || array_to_string(list_filter(string_split(p_name, ' '), lambda x: length(x) > 2), ' ') AS family, count(*) OVER (PARTITION BY p_brand, p_name) AS family_size FROM part")
def item_families(t: Tables) -> DataFrame:
    return catalog.families(items(t), F.col("producer"), T.name_tokens(T.canonical(F.col("name"), T.native_fold))).select("slug", "family", "family_size")


@BOOK.add("SELECT p_name, count(DISTINCT p_brand) AS n_owners FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def shared_names(t: Tables) -> DataFrame:
    return catalog.shared_keys(t.part, "p_name", "p_brand")


@BOOK.add("SELECT p_partkey AS slug, CASE WHEN p_name IS NOT NULL THEN 'item «' || p_name || '», maker ' || p_brand || CASE WHEN p_size > 25 THEN ', large' ELSE '' END END AS label FROM part")
def canonical_labels(t: Tables) -> DataFrame:
    return items(t).select("slug", catalog.template(F.col("name"), F.col("producer"), [F.when(F.col("p_size") > 25, "large")], "item", "maker").alias("label"))


@BOOK.add("SELECT p_partkey AS key, url FROM part LEFT JOIN pages ON page_id = p_partkey")
def cards_with_media(t: Tables) -> DataFrame:
    links = t.pages.select(F.col("page_id").alias("key"), F.col("page_id").alias("line_no"), F.when(F.col("page_id") % 2 == 0, F.col("url")).alias("cdn_url"), F.col("url").alias("upload_url"))
    return catalog.media_cards(t.part.select(F.col("p_partkey").alias("key")), links, "key").select("key", "url")


def evidence(t: Tables) -> DataFrame:
    """Three sources for ten queries over the catalog: scores from the keys, ranks by score."""
    base = t.part.select(F.col("p_partkey").alias("slug"), "p_type", "p_size").withColumn("query_id", F.col("slug") % 10)
    score = {"text": (F.col("slug") * 7919 % 1000) / 10.0, "photo": (F.col("slug") * 104729 % 1000) / 1000.0, "class": (F.col("slug") * 1299709 % 1000) / 1000.0}
    part = {"text": F.col("p_type") != "ECONOMY", "photo": F.col("p_size") > 12, "class": F.lit(True)}
    out = None
    for source, value in score.items():
        rows = base.where(part[source]).select("query_id", F.lit(source).alias("source"), F.col("slug").cast("string").alias("slug"), value.alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return search.top_k(out.withColumn("key", F.concat_ws("/", F.col("query_id").cast("string"), "source")), "key", [F.desc("score"), F.asc("slug")], 1 << 30).drop("key")


SQL_EVIDENCE = """base AS (SELECT p_partkey AS k, p_type, p_size, p_partkey % 10 AS query_id, CAST(p_partkey AS VARCHAR) AS slug FROM part),
ev0 AS (SELECT query_id, 'text' AS source, slug, (k * 7919 % 1000) / 10.0::DOUBLE AS score FROM base WHERE p_type <> 'ECONOMY'
  UNION ALL SELECT query_id, 'photo', slug, (k * 104729 % 1000) / 1000.0::DOUBLE FROM base WHERE p_size > 12
  UNION ALL SELECT query_id, 'class', slug, (k * 1299709 % 1000) / 1000.0::DOUBLE FROM base),
ev AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, slug) AS rank FROM ev0)"""
def _sql_fuse(limit: int) -> str:
    """Candidates: the first five of each source, whole families in order of their key while they fit into limit, then a cut at limit."""
    return f"""WITH RECURSIVE {SQL_EVIDENCE},
src AS (SELECT query_id, source, max(score) AS best, max(score) FILTER (rank = 5) AS floor_score FROM ev GROUP BY ALL),
fam AS (SELECT CAST(p_partkey AS VARCHAR) AS slug, p_brand || '/' || p_size AS family, count(*) OVER (PARTITION BY p_brand, p_size) AS family_size FROM part),
sel AS (SELECT DISTINCT query_id, slug, family, family_size FROM ev JOIN fam USING (slug) WHERE rank <= 5),
own AS (SELECT query_id, family, any_value(family_size) - count(*) AS extra, row_number() OVER (PARTITION BY query_id ORDER BY family) AS i FROM sel GROUP BY query_id, family),
fold AS (SELECT query_id, 0::BIGINT AS i, count(*)::BIGINT AS total, NULL::VARCHAR AS taken FROM sel GROUP BY query_id
  UNION ALL SELECT f.query_id, o.i, CASE WHEN total + extra <= {limit} THEN total + extra ELSE total END, CASE WHEN total + extra <= {limit} THEN family END FROM fold f JOIN own o ON o.query_id = f.query_id AND o.i = f.i + 1),
pool AS (SELECT query_id, slug FROM sel UNION SELECT query_id, slug FROM fold JOIN fam ON family = taken),
firsts AS (SELECT query_id, slug, min(rank) AS first FROM ev GROUP BY ALL),
cand AS (SELECT query_id, slug, family, family_size FROM pool JOIN fam USING (slug) LEFT JOIN firsts USING (query_id, slug)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coalesce(first, 1000000000), slug) <= {limit}),
scored AS (SELECT c.*, s.source, e.score, e.rank AS given,
  CASE WHEN e.score IS NOT NULL THEN (e.score - best) / tau WHEN s.source = 'text' THEN (floor_score - best) / tau - 1 ELSE 0 END AS gap, weight
  FROM cand c JOIN src s USING (query_id) JOIN (VALUES ('photo', 0.05::DOUBLE, 1.0::DOUBLE), ('class', 0.05, 0.3), ('text', 10.0, 0.7)) w(source, tau, weight) USING (source)
  LEFT JOIN ev e ON e.query_id = c.query_id AND e.source = s.source AND e.slug = c.slug)"""


@BOOK.add(f"""{_sql_fuse(18)}, b AS (SELECT query_id, slug, family, family_size, sum(weight * gap) AS base, sum(CASE source WHEN 'photo' THEN 0.2 * gap WHEN 'text' THEN 0.1 * gap ELSE 0 END) AS member,
  bool_or(source = 'photo' AND score IS NOT NULL) AS photo FROM scored GROUP BY ALL),
f AS (SELECT *, max(base) OVER (PARTITION BY query_id, family) + member AS blend FROM b)
SELECT query_id, slug, row_number() OVER (PARTITION BY query_id ORDER BY round(blend, 6) DESC, NOT photo, slug) AS rank, round(blend, 4) AS blend_score, family_size FROM f""")
def fusion_gap(t: Tables) -> DataFrame:
    """Some families fit into the 18 candidates, others do not."""
    out = fusion.fuse(evidence(t), families(t), fusion.FusionConfig(top_k=5, max_candidates=18))
    return out.select("query_id", "slug", "rank", F.round("blend_score", 4).alias("blend_score"), "family_size")


@BOOK.add(f"""{_sql_fuse(12)}, b AS (SELECT query_id, slug, family, family_size, sum(CASE WHEN given <= 5 THEN weight * 60 / (60 + given) ELSE 0 END) AS base,
  bool_or(source = 'photo' AND score IS NOT NULL) AS photo FROM scored GROUP BY ALL),
f AS (SELECT *, max(base) OVER (PARTITION BY query_id, family) AS blend FROM b)
SELECT query_id, slug, row_number() OVER (PARTITION BY query_id ORDER BY round(blend, 9) DESC, NOT photo, slug) AS rank, round(blend, 6) AS blend_score, family_size FROM f""")
def fusion_rrf(t: Tables) -> DataFrame:
    """The three sources' first five are more than the 12 candidates, so the pool is cut."""
    out = fusion.fuse(evidence(t), families(t), fusion.FusionConfig(mode="rrf", top_k=5, max_candidates=12))
    return out.select("query_id", "slug", "rank", F.round("blend_score", 6).alias("blend_score"), "family_size")


def families(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").cast("string").alias("slug"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("family"))


@BOOK.add(f"""WITH {SQL_EVIDENCE}, bad AS (SELECT query_id, source, CASE WHEN k % 50 = 0 THEN 'x' || slug ELSE slug END AS slug, CASE WHEN k % 70 = 0 THEN 200 ELSE score END AS score, rank FROM ev JOIN base USING (query_id, slug))
SELECT query_id, 'score_out_of_bounds' AS error, source || '/' || slug AS key FROM bad WHERE source = 'text' AND score > 100.001 OR source <> 'text' AND abs(score) > 1.001
UNION ALL SELECT query_id, 'unknown_item', source || '/' || slug FROM bad WHERE slug NOT IN (SELECT slug FROM base)
UNION ALL SELECT query_id, 'rank_against_score', source || '/' || slug FROM (SELECT *, lag(score) OVER (PARTITION BY query_id, source ORDER BY rank) AS prev FROM bad) WHERE prev + 1e-6 < score""")
def evidence_errors(t: Tables) -> DataFrame:
    e = evidence(t)
    k = F.col("slug").cast("bigint")
    bad = e.withColumn("score", F.when(k % 70 == 0, 200.0).otherwise(F.col("score"))).withColumn("slug", F.when(k % 50 == 0, F.concat(F.lit("x"), "slug")).otherwise(F.col("slug")))
    return fusion.evidence_errors(bad, families(t))


SQL_TEXT = f"WITH {SQL_EVIDENCE}, t AS (SELECT query_id, slug, score, rank, score - lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS margin FROM ev WHERE source = 'text')"


@BOOK.add(f"{SQL_TEXT} SELECT query_id, slug, CASE WHEN score < 99.5 THEN 'unknown' WHEN margin < 0.2 THEN 'ambiguous' ELSE 'accepted' END AS decision, round(margin, 6) AS margin FROM t WHERE rank = 1")
def text_decisions(t: Tables) -> DataFrame:
    top = fusion.with_margin(evidence(t).where("source = 'text'"), "query_id", "score", [F.asc("rank")])
    policy = {"min_score": 99.5, "max_distance": 0.5, "min_margin": 0.2}
    return top.select("query_id", "slug", fusion.text_decision(F.col("score"), F.lit(0.0), F.col("margin"), policy).alias("decision"), F.round("margin", 6).alias("margin"))


@BOOK.add(f"{SQL_TEXT}, p AS (SELECT *, exp((score - max(score) OVER w) / 10) AS e FROM t WINDOW w AS (PARTITION BY query_id)) SELECT query_id, slug, round(e / sum(e) OVER (PARTITION BY query_id), 9) AS probability FROM p")
def calibrated_probabilities(t: Tables) -> DataFrame:
    return fusion.softmax(evidence(t).where("source = 'text'"), "query_id", "score", 10.0).select("query_id", "slug", F.round("probability", 9).alias("probability"))


@BOOK.add(f"WITH {SQL_EVIDENCE}, q AS (SELECT r.query_id FROM range(14) r(query_id)) SELECT q.query_id, coalesce(e.slug, (SELECT min(slug) FROM base)) AS slug FROM q LEFT JOIN ev e ON e.query_id = q.query_id AND source = 'photo' AND rank = 1")
def forced_choices(t: Tables) -> DataFrame:
    return fusion.forced_choice(t.spark.range(14).toDF("query_id"), evidence(t).where("source = 'photo'"), families(t))


def vectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.embeddings
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("truth")), e.select(F.col("vec_id").alias("item_id"), "embedding", "label")


SQL_COSINE = "s AS (SELECT q.vec_id AS query_id, q.label AS truth, g.vec_id AS item_id, g.label, list_inner_product(q.embedding::DOUBLE[], g.embedding::DOUBLE[]) AS cosine FROM embeddings q JOIN embeddings g ON q.vec_id % 100 = 0)"


@BOOK.add(f"WITH {SQL_COSINE} SELECT query_id, item_id, round(cosine, 6) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id) AS rank FROM s) WHERE rank <= 5")
def cosine_top_5(t: Tables) -> DataFrame:
    q, g = vectors(t)
    return similarity.cosine_top_k(q, g, 5).withColumn("cosine", F.round("cosine", 6))


@BOOK.add(f"""WITH {SQL_COSINE} SELECT query_id, label, round(max(cosine), 6) AS best, arg_min(item_id, (-cosine, item_id)) AS asset, count(*) AS n_references FROM s GROUP BY query_id, label""")
def best_reference_per_label(t: Tables) -> DataFrame:
    """Of each query and label the best of all pictures."""
    q, g = vectors(t)
    return similarity.best_per_owner(q, g, "query_id", "item_id", "label", "embedding").withColumn("best", F.round("best", 6))


@BOOK.add("""WITH d AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY ALL),
u AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM d) SELECT label, list(round(x, 6) ORDER BY i) AS centroid FROM u GROUP BY label""")
def class_centroids(t: Tables) -> DataFrame:
    c = similarity.ensemble(t.embeddings, "label", "embedding")
    return c.select("label", F.transform("embedding", lambda x: F.round(x, 6)).alias("centroid"))


#: The signs of 64 dimensions; pictures alike in but a few of them are made from the given ones, since the given ones are far apart.
SQL_HASH = """e AS (SELECT vec_id, label, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, label + 1, list_transform(embedding, lambda x, i: CASE WHEN i <= vec_id % 9 THEN -x ELSE x END) FROM embeddings WHERE vec_id % 3 = 0),
h AS (SELECT vec_id, label, list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN 1::HUGEINT << (64 - i)::INT ELSE 0 END))::HUGEINT AS h FROM e),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id AND a.label <> b.label AND bit_count(xor(a.h, b.h)) < 6)"""


def hashed_pictures(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding")
    flipped = F.transform("embedding", lambda x, i: F.when(i < F.col("vec_id") % 9, -x).otherwise(x))
    more = e.where("vec_id % 3 = 0").select(F.col("vec_id") + 1000000, F.col("label") + 1, flipped).toDF(*e.columns)
    return e.unionByName(more).select("vec_id", "label", A.sign_bits(F.col("embedding"), 64).alias("h"))


@BOOK.add(f"WITH {SQL_HASH} SELECT * FROM p")
def hamming_near(t: Tables) -> DataFrame:
    return similarity.hamming_pairs(hashed_pictures(t), "vec_id", "h", "label", 6)


@BOOK.add(f"WITH {SQL_HASH} SELECT vec_id FROM e WHERE vec_id NOT IN (SELECT a FROM p UNION SELECT b FROM p)")
def without_near_duplicates(t: Tables) -> DataFrame:
    return similarity.without_duplicates(hashed_pictures(t).select("vec_id"), "vec_id", hamming_near(t))


@BOOK.add("SELECT source, ('0x' || substr(sha256(source), 1, 4))::INT % 100 AS share, CASE WHEN ('0x' || substr(sha256(source), 1, 4))::INT % 100 < 80 THEN 'train' WHEN ('0x' || substr(sha256(source), 1, 4))::INT % 100 < 90 THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM documents GROUP BY ALL")
def producer_split(t: Tables) -> DataFrame:
    s = F.col("source")
    return t.documents.select(s, splits.hashed_share(s).alias("share"), splits.hashed_split(s).alias("split")).groupBy("source", "share", "split").agg(F.count("*").alias("n"))


@BOOK.add("""WITH o AS (SELECT *, sha256('7:' || c_custkey) AS h FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY h, c_custkey) > 1 AS later FROM o)
SELECT c_custkey, c_nationkey FROM r ORDER BY later, h, c_custkey LIMIT 60""")
def diverse_customers(t: Tables) -> DataFrame:
    return splits.diverse_sample(t.customer.select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey", 60, "7")
