"""Request outcomes, tuning, summaries, folds, frozen shares and job checks over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakefold.operators import fusion, workflow
from lakefold.plans.book import Book, Tables
from lakefold.plans.labels import _pick, _sql_pick
from lakefold.plans.retrieval import SQL_EVIDENCE, evidence, families

BOOK = Book()
REPORTED = ("", "ocr_not_configured", "ocr_capacity_exceeded", "vision_worker_failed", "ocr_error", "vision_unavailable")
MODES = ("refuse", "full_frame", "center_crop")


@BOOK.add(f"""WITH r AS (SELECT l_orderkey, l_linenumber, {_sql_pick(REPORTED, "l_partkey")} AS reported, l_quantity < 5 AS late, CASE WHEN l_suppkey % 5 > 0 THEN 'c' || (l_partkey % 97) END AS first_slug, CASE WHEN l_suppkey % 5 > 2 THEN 'accepted' ELSE 'ambiguous' END AS decision,
  l_suppkey % 5 > 2 AS decided, l_linenumber % 2 AS n_evidence, CASE WHEN l_linenumber % 4 > 0 THEN {_sql_pick(MODES, "l_linenumber")} END AS mode, l_suppkey % 7 = 0 AS mismatch, l_partkey % 3 = 0 AS force, l_partkey % 11 > 0 AS valid FROM lineitem),
s AS (SELECT *, reported = 'ocr_capacity_exceeded' AS busy, decided AND reported IN ('ocr_capacity_exceeded', 'vision_worker_failed', 'ocr_error', 'vision_unavailable') AS partial FROM r),
u AS (SELECT *, decided AND NOT partial AND mismatch AND NOT force AS refused, CASE WHEN late OR busy THEN 'error' WHEN first_slug IS NULL THEN CASE WHEN reported = 'vision_worker_failed' THEN 'error' WHEN n_evidence = 0 THEN 'unreadable' ELSE 'unknown' END
  WHEN partial OR (decided AND mismatch AND NOT force) THEN 'ambiguous' ELSE decision END AS status,
  CASE WHEN late THEN 'deadline' WHEN busy THEN 'capacity_exceeded' WHEN first_slug IS NULL THEN 'no_candidates' ELSE
    array_to_string(list_filter([CASE WHEN mode <> 'refuse' THEN mode END, 'policy', CASE WHEN partial THEN 'partial_evidence' WHEN decided AND mismatch AND NOT force THEN 'uncalibrated_request_profile' END], lambda x: x IS NOT NULL), ',') END AS extra FROM s),
v AS (SELECT *, CASE WHEN NOT (late OR busy OR first_slug IS NULL OR partial OR refused) AND decided THEN first_slug END AS answer FROM u),
w AS (SELECT *, force AND answer IS NULL AND valid AND NOT (late OR busy) AND reported NOT IN ('vision_worker_failed', 'vision_unavailable') AS forced FROM v)
SELECT l_orderkey, l_linenumber, status, coalesce(CASE WHEN forced THEN coalesce(first_slug, 'a') ELSE answer END, '') AS slug, CASE WHEN reported = '' THEN '' ELSE reported || ',' END || extra || CASE WHEN forced THEN CASE WHEN first_slug IS NULL THEN ',eval_catalog_fallback_no_evidence' ELSE ',eval_forced_top1' END ELSE '' END AS reason_codes FROM w""")
def request_outcomes(t: Tables) -> DataFrame:
    """Status, answer and reasons of each request, made from order lines."""
    reported = _pick(REPORTED, F.col("l_partkey"))
    decided = F.col("l_suppkey") % 5 > 2
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.filter(F.array(reported), lambda r: r != "").alias("reasons"), (F.col("l_quantity") < 5).alias("late"), F.when(F.col("l_suppkey") % 5 > 0, F.concat(F.lit("c"), F.col("l_partkey") % 97)).alias("first_slug"),
        F.when(decided, "accepted").otherwise("ambiguous").alias("decision"), F.when(decided, F.concat(F.lit("c"), F.col("l_partkey") % 97)).alias("decided_slug"), F.array(F.lit("policy")).alias("policy_reasons"),
        (F.col("l_linenumber") % 2).alias("n_evidence"), F.when(F.col("l_linenumber") % 4 > 0, _pick(MODES, F.col("l_linenumber"))).alias("mode"), (F.col("l_suppkey") % 7 == 0).alias("mismatch"), (F.col("l_partkey") % 3 == 0).alias("force"), (F.col("l_partkey") % 11 > 0).alias("valid"),
    )
    out = workflow.request_outcome(rows, F.lit("a"))
    return out.select("l_orderkey", "l_linenumber", "status", F.coalesce("slug", F.lit("")).alias("slug"), F.array_join("reason_codes", ",").alias("reason_codes"))


@BOOK.add(f"""WITH {SQL_EVIDENCE},
src AS (SELECT query_id, source, max(score) AS best, max(score) FILTER (rank = 5) AS floor_score FROM ev GROUP BY ALL),
fam AS (SELECT CAST(p_partkey AS VARCHAR) AS slug, p_brand || '/' || p_size AS family FROM part), sel AS (SELECT DISTINCT query_id, family FROM ev JOIN fam USING (slug) WHERE rank <= 5), cand AS (SELECT query_id, slug, family FROM sel JOIN fam USING (family)),
scored AS (SELECT c.*, s.source, e.rank AS given, e.score IS NOT NULL AS hit, CASE WHEN e.score IS NOT NULL THEN (e.score - best) / tau WHEN s.source = 'text' THEN (floor_score - best) / tau - 1 ELSE 0 END AS gap
  FROM cand c JOIN src s USING (query_id) JOIN (VALUES ('photo', 0.05::DOUBLE), ('class', 0.05), ('text', 10.0)) w(source, tau) USING (source) LEFT JOIN ev e ON e.query_id = c.query_id AND e.source = s.source AND e.slug = c.slug),
trial AS (SELECT * FROM (VALUES ('gap'), ('rrf')) m(mode), (VALUES (0.5::DOUBLE), (1.0), (2.0)) p(photo), (VALUES (0.3::DOUBLE), (0.7), (1.0)) x(text)),
b AS (SELECT query_id, slug, family, mode, photo, text, sum(CASE source WHEN 'photo' THEN photo WHEN 'text' THEN text ELSE 0.3 END * CASE WHEN mode = 'gap' THEN gap WHEN given <= 5 THEN 60.0 / (60 + given) ELSE 0 END) AS base,
  sum(CASE WHEN mode = 'rrf' THEN 0 WHEN source = 'photo' THEN 0.2 * gap WHEN source = 'text' THEN 0.1 * gap ELSE 0 END) AS member, bool_or(source = 'photo' AND hit) AS seen FROM scored, trial GROUP BY ALL),
r AS (SELECT *, max(base) OVER (PARTITION BY query_id, mode, photo, text, family) + member AS blend FROM b),
top AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, mode, photo, text ORDER BY round(blend, 9) DESC, NOT seen, slug) = 1),
truth AS (SELECT query_id, min(slug) AS slug FROM ev WHERE source = 'photo' AND rank <= 3 GROUP BY query_id),
m AS (SELECT mode, photo, text, count(*) AS n, avg(CASE WHEN top.slug = truth.slug THEN 1.0 ELSE 0 END) AS accuracy, avg(CASE WHEN top.family = fam.family THEN 1.0 ELSE 0 END) AS family_accuracy FROM truth JOIN fam ON fam.slug = truth.slug JOIN top ON top.query_id = truth.query_id GROUP BY ALL)
SELECT row_number() OVER (ORDER BY accuracy DESC, family_accuracy DESC, mode, photo, text) AS place, mode, photo, text, n, round(accuracy, 6)::DOUBLE AS accuracy, round(family_accuracy, 6)::DOUBLE AS family_accuracy FROM m""")
def tuned_weights(t: Tables) -> DataFrame:
    e = evidence(t)
    truth = e.where("source = 'photo' AND rank <= 3").groupBy("query_id").agg(F.min("slug").alias("slug"))
    out = fusion.tune(e, families(t), truth, fusion.FusionConfig(top_k=5, max_candidates=1 << 20))
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "family_accuracy")})


@BOOK.add("""WITH x AS (SELECT *, l_quantity > 8 AS found, l_partkey % 9 > 0 AS present, (l_suppkey % 100) / 100.0 AS iou, (l_partkey % 100) / 100.0 AS coverage, l_extendedprice AS ms FROM lineitem)
SELECT count(*) AS total, count(*) FILTER (found) AS located, round(count(*) FILTER (found) / count(*)::DOUBLE, 9) AS located_fraction, count(*) FILTER (NOT present) AS negative_total, count(*) FILTER (found AND NOT present) AS false_localizations,
count(*) FILTER (found AND iou >= 0.5) AS iou_ge_0_5, count(*) FILTER (found AND coverage >= 0.9) AS gt_coverage_ge_0_9, round(quantile_cont(ms, 0.5), 6) AS latency_ms_p50, round(quantile_cont(ms, 0.95), 6) AS latency_ms_p95 FROM x""")
def localization_report(t: Tables) -> DataFrame:
    x = t.lineitem.select((F.col("l_quantity") > 8).alias("found"), (F.col("l_partkey") % 9 > 0).alias("present"), ((F.col("l_suppkey") % 100) / 100.0).alias("iou"), ((F.col("l_partkey") % 100) / 100.0).alias("coverage"), F.col("l_extendedprice").alias("latency_ms"))
    return workflow.localization_summary(x).withColumns({c: F.round(c, 9 if c == "located_fraction" else 6) for c in ("located_fraction", "latency_ms_p50", "latency_ms_p95")})


@BOOK.add("SELECT l_linenumber AS n_train, l_returnflag AS method, round(avg(l_tax), 3) AS tax, round(avg(l_discount), 3) AS discount FROM lineitem GROUP BY ALL")
def means_by_method(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_linenumber").alias("n_train"), F.col("l_returnflag").alias("method"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"))
    return workflow.metric_means(rows, ["n_train", "method"], ["tax", "discount"])


@BOOK.add("SELECT value, count(*) AS n FROM (SELECT CASE WHEN p_size % 4 = 0 THEN 'shared_name' WHEN p_size % 4 = 1 THEN 'unmatched' ELSE p_type END AS value FROM part) GROUP BY value")
def issue_histogram(t: Tables) -> DataFrame:
    rows = t.part.select(F.when(F.col("p_size") % 4 == 0, "shared_name").when(F.col("p_size") % 4 == 1, "unmatched").alias("issue"), F.col("p_type").alias("method"))
    return workflow.histogram(rows, "issue", "method")


@BOOK.add("""WITH q AS (SELECT o_orderkey, o_custkey % 3 > 0 AS known, o_custkey % 13 = 0 AS failed, o_custkey % 5 > 0 AS raw, o_custkey % 5 > 1 AS budget, o_orderkey % 3 > 0 AS has_text, o_orderkey % 4 > 0 AS has_photo, o_custkey % 2 = 0 AS correct,
  CASE WHEN o_custkey % 7 > 0 THEN (o_custkey % 100)::DOUBLE END AS margin, (o_custkey % 1000)::DOUBLE AS ms FROM orders), p AS (SELECT ms, row_number() OVER (ORDER BY ms) AS i, count(*) OVER () AS n FROM q)
SELECT 'raw_recall' AS metric, count(*) FILTER (known AND raw)::DOUBLE AS numerator, count(*) FILTER (known) AS denominator FROM q UNION ALL SELECT 'after_budget_recall', count(*) FILTER (known AND budget), count(*) FILTER (known) FROM q
UNION ALL SELECT 'source_failures', count(*) FILTER (failed), count(*) FROM q UNION ALL SELECT 'margin_right', sum(margin) FILTER (known AND correct), count(margin) FILTER (known AND correct) FROM q
UNION ALL SELECT 'margin_wrong', sum(margin) FILTER (known AND NOT correct), count(margin) FILTER (known AND NOT correct) FROM q UNION ALL SELECT 'latency_p95', max(ms), max(n) FROM p WHERE i = ceil(0.95 * n)
UNION ALL SELECT 'missing_text', count(*) FILTER (NOT has_text), count(*) FROM q UNION ALL SELECT 'missing_photo', count(*) FILTER (NOT has_photo), count(*) FROM q UNION ALL SELECT 'missing_class', count(*), count(*) FROM q""")
def fusion_summary(t: Tables) -> DataFrame:
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    rows = t.orders.select((c % 3 > 0).alias("known"), (c % 13 == 0).alias("failed"), (c % 5 > 0).alias("in_raw"), (c % 5 > 1).alias("in_budget"), F.array_compact(F.array(F.when(k % 3 > 0, "text"), F.when(k % 4 > 0, "photo"))).alias("sources"), (c % 2 == 0).alias("right"), F.when(c % 7 > 0, (c % 100).cast("double")).alias("margin"), (c % 1000).cast("double").alias("latency_ms"))
    return workflow.fusion_summary(rows)


SQL_SHARE = "('0x' || substr(sha256('s:' || {0}), 1, 4))::INT % 5"


def _folds(t: Tables, protocol: str) -> DataFrame:
    rows = t.events.select("event_id", "user_id", F.col("event_id").alias("item"), "ts", (F.col("event_id") % 20).alias("maker"))
    return workflow.folds(rows, protocol, "user_id", "item", "ts", "event_id", "maker", 4, 2, "s").select("event_id", "user_id", "role", "population")


@BOOK.add("""WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY sha256('s:' || event_id), event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, user_id, CASE WHEN i <= 4 THEN 'train' ELSE 'test' END AS role, i <= 4 AS population FROM r WHERE n >= 6""")
def random_folds(t: Tables) -> DataFrame:
    return _folds(t, "random")


@BOOK.add(f"""WITH r AS (SELECT event_id, user_id, {SQL_SHARE.format("user_id")} = 0 AS asked, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, user_id, CASE WHEN i <= 4 THEN 'train' ELSE 'test' END AS role, i <= 4 AND NOT asked AS population FROM r WHERE n >= 6 AND (asked OR i <= 4)""")
def new_user_folds(t: Tables) -> DataFrame:
    return _folds(t, "new_user")


@BOOK.add(f"""WITH r AS (SELECT *, {SQL_SHARE.format("(event_id % 20)")} = 0 AS held FROM events), p AS (SELECT *, count(*) FILTER (NOT held) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM r),
c AS (SELECT *, max(ts) FILTER (NOT held AND i <= 4) OVER (PARTITION BY user_id) AS cutoff FROM p), d AS (SELECT *, CASE WHEN NOT held AND i <= 4 THEN 'train' WHEN held AND ts > cutoff THEN 'test' END AS role FROM c),
e AS (SELECT *, count(*) FILTER (role = 'train') OVER (PARTITION BY user_id) AS a, count(*) FILTER (role = 'test') OVER (PARTITION BY user_id) AS b FROM d WHERE role IS NOT NULL) SELECT event_id, user_id, role, role = 'train' AS population FROM e WHERE a = 4 AND b >= 2""")
def new_item_folds(t: Tables) -> DataFrame:
    return _folds(t, "new_item")


@BOOK.add("""WITH f AS (SELECT p_type AS c, count(*) AS n FROM part WHERE p_size <= 20 AND p_type <> 'ECONOMY' GROUP BY p_type), m AS (SELECT c, n / (SELECT sum(n) FROM f)::DOUBLE AS w FROM f), x AS (SELECT p_partkey, CASE WHEN p_partkey % 6 > 0 THEN p_type END AS c FROM part)
SELECT p_partkey, coalesce(x.c, '?') AS given, f.c AS category, round(CASE WHEN EXISTS (SELECT 1 FROM f g WHERE g.c = x.c) THEN 1.0 ELSE m.w END, 9)::DOUBLE AS weight FROM x JOIN f ON NOT EXISTS (SELECT 1 FROM f g WHERE g.c = x.c) OR f.c = x.c JOIN m ON m.c = f.c""")
def frozen_category_shares(t: Tables) -> DataFrame:
    x = t.part.select("p_partkey", F.when(F.col("p_partkey") % 6 > 0, F.col("p_type")).alias("c"))
    out = workflow.category_shares(x, t.part.where("p_size <= 20 AND p_type <> 'ECONOMY'").select(F.col("p_type").alias("c")), "c")
    return out.select("p_partkey", F.coalesce("c", F.lit("?")).alias("given"), F.explode("shares").alias("category", "weight")).withColumn("weight", F.round("weight", 9))


@BOOK.add("""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_partkey % 5 = 0 OR l_suppkey % 9 = 0 THEN 'missing_or_unsafe' WHEN l_quantity > 40 THEN 'oversized' WHEN l_linenumber = 2 THEN 'undecodable' END, '') AS problem,
sha256('{"a":' || l_partkey || ',"b":' || CASE WHEN l_linenumber = 1 THEN 'null' ELSE '"' || l_returnflag || '"' END || '}') AS print FROM lineitem""")
def row_checks(t: Tables) -> DataFrame:
    """Why a row has no hash, and the fingerprint of its fields."""
    path = F.when(F.col("l_partkey") % 5 == 0, _pick(("../x", "/x", "a/../b", "", ".."), F.floor(F.col("l_partkey") / 5))).otherwise("a/b.jpg")
    problem = workflow.row_problem(path, F.col("l_suppkey") % 9 != 0, F.when(F.col("l_quantity") > 40, 1 << 30).otherwise(5), F.col("l_linenumber") != 2)
    rows = t.lineitem.withColumn("a", F.col("l_partkey")).withColumn("b", F.when(F.col("l_linenumber") != 1, F.col("l_returnflag")))
    return rows.select("l_orderkey", "l_linenumber", F.coalesce(problem, F.lit("")).alias("problem"), workflow.fingerprint(["b", "a"]).alias("print"))


@BOOK.add("""WITH r AS (SELECT l_orderkey AS batch, l_linenumber % 3 AS part, l_extendedprice AS result FROM lineitem), j AS (SELECT DISTINCT l_orderkey AS batch, l_linenumber % 4 AS part FROM lineitem)
SELECT j.batch, j.part, count(r.result) AS n_results, CASE WHEN count(r.result) = 1 THEN min(r.result) ELSE -1 END AS result FROM j LEFT JOIN r USING (batch, part) GROUP BY ALL""")
def job_results(t: Tables) -> DataFrame:
    r = t.lineitem.select(F.col("l_orderkey").alias("batch"), (F.col("l_linenumber") % 3).alias("part"), F.col("l_extendedprice").alias("result"))
    j = t.lineitem.select(F.col("l_orderkey").alias("batch"), (F.col("l_linenumber") % 4).alias("part")).distinct()
    return workflow.only_result(j, r, ["batch", "part"]).withColumn("result", F.coalesce("result", F.lit(-1.0)))


@BOOK.add("""WITH q AS (SELECT o_orderkey, (['reserving', 'ready', 'queued'])[o_orderkey % 3 + 1] AS state, o_orderdate AS updated, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 600 SECOND END AS leased FROM orders)
SELECT o_orderkey, CASE WHEN state = 'reserving' AND epoch(TIMESTAMP '1997-01-01') - epoch(updated) > 180 THEN 'needs_review' WHEN leased <= TIMESTAMP '1997-01-01' THEN state || '/free' ELSE state END AS state FROM q""")
def due_jobs(t: Tables) -> DataFrame:
    """States that follow from the time: stale reservations and ended leases."""
    state = _pick(("reserving", "ready", "queued"), F.col("o_orderkey"))
    leased = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate") + F.expr("INTERVAL 600 SECOND"))
    return t.orders.select("o_orderkey", workflow.due_state(state, F.col("o_orderdate").cast("timestamp"), leased.cast("timestamp"), F.expr("TIMESTAMP '1997-01-01'")).alias("state"))


@BOOK.add("SELECT doc_id, sha256(text) AS digest FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(*) = 1)")
def unlabelled_queries(t: Tables) -> DataFrame:
    return workflow.unlabelled_queries(t.documents.select("doc_id", F.sha2("text", 256).alias("digest")), "doc_id", "digest")
