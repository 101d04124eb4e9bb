"""Prompt, alias, re-ranking, calibration and policy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakefold.operators import policy
from lakefold.plans.book import Book, Tables
from lakefold.plans.retrieval import SQL_EVIDENCE, evidence

BOOK = Book()


@BOOK.add("SELECT p_partkey, 0 AS prompt_no, 'a photo of a bottle of ' || p_name AS prompt FROM part UNION ALL SELECT p_partkey, 1, 'a label that says ' || p_name || ' by ' || p_brand FROM part")
def visual_prompts(t: Tables):
    return policy.prompts(t.part, "p_partkey", "visual", "p_name", "p_brand", "p_type")


@BOOK.add("SELECT p_name || ', ' || p_brand AS prompt, count(DISTINCT p_partkey) AS n_members, list_sort(list(DISTINCT p_partkey)) AS members FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def prompt_collisions(t: Tables):
    return policy.colliding(policy.prompts(t.part, "p_partkey", "name-producer", "p_name", "p_brand", "p_type"), "p_partkey", "prompt")


SQL_ALIASES = "al(variant, canonical) AS (VALUES ('red', 'colour'), ('red ring', 'jewel'), ('ring', 'jewel'), ('small', 'size'), ('blue', 'colour'), ('widget', 'thing'))"


def alias_table(t: Tables):
    return t.spark.createDataFrame([("red", "colour"), ("red ring", "jewel"), ("ring", "jewel"), ("small", "size"), ("blue", "colour"), ("widget", "thing")], "variant string, canonical string")


@BOOK.add(f"""WITH {SQL_ALIASES}, m AS (SELECT p_partkey, variant, canonical, length(variant) AS n FROM part JOIN al ON contains(' ' || p_name || ' ', ' ' || variant || ' ')), b AS (SELECT * FROM m QUALIFY n = max(n) OVER (PARTITION BY p_partkey))
SELECT p_partkey, CASE WHEN count(DISTINCT canonical) = 1 THEN min(canonical) END AS canonical FROM b GROUP BY p_partkey""")
def alias_words(t: Tables):
    return policy.alias_in_text(t.part, alias_table(t), "p_partkey", "p_name", True)


@BOOK.add(f"""WITH {SQL_ALIASES}, m AS (SELECT p_partkey, variant, canonical, length(variant) AS n FROM part JOIN al ON contains(p_name, variant)), b AS (SELECT * FROM m QUALIFY n = max(n) OVER (PARTITION BY p_partkey))
SELECT p_partkey, arg_min(canonical, variant) AS canonical FROM b GROUP BY p_partkey""")
def alias_substrings(t: Tables):
    return policy.alias_in_text(t.part, alias_table(t), "p_partkey", "p_name", False)


SQL_BOTH = f"WITH {SQL_EVIDENCE}, b AS (SELECT t.query_id, t.slug, t.rank, t.score, p.score AS cosine FROM ev t LEFT JOIN ev p ON p.query_id = t.query_id AND p.slug = t.slug AND p.source = 'photo' WHERE t.source = 'text' AND t.rank <= 4)"


def with_photo(t: Tables):
    e = evidence(t)
    photo = e.where("source = 'photo'").select("query_id", "slug", F.col("score").alias("cosine"))
    return e.where("source = 'text' AND rank <= 4").join(photo, ["query_id", "slug"], "left")


@BOOK.add(f"""{SQL_BOTH}, w AS (SELECT *, bool_and(cosine IS NOT NULL) OVER (PARTITION BY query_id) AS whole FROM b)
SELECT query_id, slug, CASE WHEN whole THEN row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, rank) ELSE 0 END AS new_rank FROM w""")
def reranked_by_cosine(t: Tables):
    return policy.rerank(with_photo(t), "query_id", "rank", "score", "cosine").select("query_id", "slug", F.coalesce("new_rank", F.lit(0)).alias("new_rank"))


@BOOK.add(f"""{SQL_BOTH}, w AS (SELECT *, bool_and(cosine IS NOT NULL) OVER q AS whole, 0.5 * (score - max(score) OVER q) / 10 + 0.5 * (cosine - max(cosine) OVER q) / 0.05 AS v FROM b WINDOW q AS (PARTITION BY query_id))
SELECT query_id, slug, CASE WHEN whole THEN round(v, 6) END AS new_score, CASE WHEN whole THEN row_number() OVER (PARTITION BY query_id ORDER BY v DESC, rank) ELSE 0 END AS new_rank FROM w""")
def reranked_by_fusion(t: Tables):
    return policy.rerank(with_photo(t), "query_id", "rank", "score", "cosine", 0.5).select("query_id", "slug", F.round("new_score", 6).alias("new_score"), F.coalesce("new_rank", F.lit(0)).alias("new_rank"))


@BOOK.add(f"""WITH {SQL_EVIDENCE}, r AS (SELECT query_id, score - max(score) OVER (PARTITION BY query_id) AS gap, rank = 2 AS truth FROM ev WHERE source = 'text'),
l AS (SELECT t, query_id, ln(sum(exp(gap / t))) - max(gap) FILTER (truth) / t AS loss FROM r, (VALUES (0.1::DOUBLE), (0.2), (0.5), (1), (2), (5), (10)) g(t) GROUP BY t, query_id)
SELECT t AS temperature, count(*) AS n, round(avg(loss), 6) AS log_loss FROM l WHERE loss IS NOT NULL GROUP BY t""")
def temperature_grid(t: Tables):
    rows = evidence(t).where("source = 'text'").withColumn("truth", F.col("rank") == 2)
    return policy.temperature_losses(rows, "query_id", "score", "truth").withColumn("log_loss", F.round("log_loss", 6))


@BOOK.add("""WITH r AS (SELECT label <> 0 AS known, vec_id % 3 = 0 AS accepted, vec_id % 2 = 0 AS top_right, vec_id % 2 = 0 OR vec_id % 5 = 0 AS in_top5, vec_id % 7 <> 0 AS family_right, vec_id % 3 AS family_size, vec_id % 11 <> 0 AS in_union FROM embeddings),
m AS (SELECT 'accuracy_at_1' AS metric, count(*) FILTER (known AND top_right) AS numerator, count(*) FILTER (known) AS denominator FROM r UNION ALL SELECT 'accuracy_at_5', count(*) FILTER (known AND in_top5), count(*) FILTER (known) FROM r
UNION ALL SELECT 'union_recall', count(*) FILTER (known AND in_union), count(*) FILTER (known) FROM r UNION ALL SELECT 'family_accuracy', count(*) FILTER (known AND family_right), count(*) FILTER (known) FROM r
UNION ALL SELECT 'member_accuracy', count(*) FILTER (known AND family_size > 1 AND family_right AND top_right), count(*) FILTER (known AND family_size > 1 AND family_right) FROM r
UNION ALL SELECT 'precision', count(*) FILTER (known AND accepted AND top_right), count(*) FILTER (accepted) FROM r UNION ALL SELECT 'coverage', count(*) FILTER (accepted), count(*) FROM r UNION ALL SELECT 'false_accept', count(*) FILTER (NOT known AND accepted), count(*) FILTER (NOT known) FROM r)
SELECT *, numerator::DOUBLE / nullif(denominator, 0) AS value FROM m""")
def fusion_metrics(t: Tables):
    v = F.col("vec_id")
    rows = t.embeddings.select((F.col("label") != 0).alias("known"), (v % 3 == 0).alias("accepted"), (v % 2 == 0).alias("top_right"), ((v % 2 == 0) | (v % 5 == 0)).alias("in_top5"), (v % 7 != 0).alias("family_right"), (v % 3).alias("family_size"), (v % 11 != 0).alias("in_union"))
    return policy.fusion_metrics(rows)


@BOOK.add()
def paired_user_interval(t: Tables):
    return policy.paired_interval(t.events.withColumn("b", F.col("value") * 1.01), "user_id", "value", "b")


@BOOK.add("SELECT doc_id, CASE WHEN lang = 'de' THEN 'missing' ELSE 'changed' END AS problem FROM documents WHERE lang = 'de' OR doc_id % 9 = 0")
def evidence_changes(t: Tables):
    fresh = t.documents.where("lang <> 'de'").withColumn("source", F.when(F.col("doc_id") % 9 == 0, "x").otherwise(F.col("source")))
    return policy.evidence_differences(t.documents, fresh, ["doc_id"], ["lang", "source", "n_chars"])


@BOOK.add("SELECT p_partkey, CASE WHEN p_size BETWEEN (SELECT min(p_size) FROM part WHERE p_size < 30) AND (SELECT max(p_size) FROM part WHERE p_size < 30) THEN p_size - (SELECT min(p_size) FROM part WHERE p_size < 30) ELSE -1 END AS code FROM part")
def ordinal_sizes(t: Tables):
    return policy.ordinal_code(t.part.select("p_partkey", "p_size"), t.part.where("p_size < 30"), "p_size").select("p_partkey", "code")


@BOOK.add("SELECT vec_id, 'length' AS error FROM embeddings WHERE vec_id % 20 = 0")
def embedding_errors(t: Tables):
    bad = t.embeddings.withColumn("embedding", F.when(F.col("vec_id") % 20 == 0, F.transform("embedding", lambda x: x * F.lit(2).cast("float"))).otherwise(F.col("embedding")))
    return policy.unit_errors(bad, "vec_id", "embedding", 64)


@BOOK.add(f"""WITH {SQL_EVIDENCE}, p AS (SELECT query_id, slug, score, lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS second, rank FROM ev WHERE source = 'photo')
SELECT query_id, slug, score >= 0.35 AND score - coalesce(second, -1) >= 0.004 AND CAST(slug AS BIGINT) % 2 = 1 AS skips, CASE WHEN score < 0.9 THEN 'unknown' WHEN score - coalesce(second, -1) < 0.004 THEN 'ambiguous' ELSE 'accepted' END AS decision FROM p WHERE rank = 1""")
def picture_decisions(t: Tables):
    from pyspark.sql import Window

    photo = evidence(t).where("source = 'photo'").withColumn("second", F.lead("score").over(Window.partitionBy("query_id").orderBy("rank"))).where("rank = 1")
    family = F.when(F.col("slug").cast("bigint") % 2 == 1, 1).otherwise(2)
    return photo.select("query_id", "slug", policy.skip_reading(F.col("score"), F.col("second"), family, 0.35, 0.004).alias("skips"), policy.visual_decision(F.col("score"), F.col("second"), {"min_cosine": 0.9, "min_margin": 0.004}).alias("decision"))
