"""Outcomes of requests, evaluation summaries, frozen encoders, and checks of jobs and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakefold.functions import arrays as A
from lakefold.operators.audit import unsafe_path
from lakefold.operators.report import at_ranks, percentiles

#: Reasons after which no answer is forced, reasons that a busy system gives, and those of a failed worker.
NOT_FORCED = (
    "deadline", "capacity_exceeded", "busy", "vision_worker_failed", "vision_worker_unavailable", "vision_unavailable", "vision_input_too_large",
    "worker_unavailable", "worker_failed", "inference_failed",
)
BUSY = ("ocr_capacity_exceeded", "vision_capacity_exceeded", "busy")
FAILED = ("vision_worker_failed", "vision_worker_unavailable", "vision_input_too_large", "worker_unavailable", "worker_failed", "inference_failed")


def _any(reasons: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(reasons, F.array(*map(F.lit, names)))


def request_outcome(df: DataFrame, least_slug: Column) -> DataFrame:
    """df with status, slug and reason_codes, in this order of what decides.

    df: reasons (array: what the branches reported), n_evidence, first_slug (the best candidate, or null), decision and
    decided_slug (of the policy), policy_reasons (array), late (the deadline passed), mode (null with a given region),
    mismatch (the request differs from the calibrated profile), force, valid (the picture was decoded).
    1. past the deadline: error; 2. a busy branch: error; 3. no candidates: error after a failed worker, unreadable
    without evidence, else unknown; 4. an answer on partial evidence, or for a profile that was not calibrated, is
    ambiguous; 5. the policy's decision. A forced request then gets the first candidate, or least_slug, unless the reason
    is one of NOT_FORCED.
    """
    own = F.col("reasons")
    busy, none = _any(own, BUSY), F.col("first_slug").isNull()
    partial = F.col("decided_slug").isNotNull() & F.exists(own, lambda r: (r.startswith("vision_") | r.startswith("ocr_")) & (r != "ocr_not_configured"))
    refused = F.col("decided_slug").isNotNull() & ~partial & F.col("mismatch") & ~F.col("force")
    extra = (
        F.when(F.col("late"), F.array(F.lit("deadline"))).when(busy, F.array(F.lit("capacity_exceeded"))).when(none, F.array(F.lit("no_candidates")))
        .otherwise(F.concat(
            F.when(F.col("mode").isNotNull() & (F.col("mode") != "refuse"), F.array("mode")).otherwise(F.array().cast("array<string>")), F.col("policy_reasons"),
            F.when(partial, F.array(F.lit("partial_evidence"))).when(refused, F.array(F.lit("uncalibrated_request_profile"))).otherwise(F.array().cast("array<string>")),
        ))
    )
    status = (
        F.when(F.col("late") | busy, "error").when(none, F.when(_any(own, FAILED), "error").when(F.col("n_evidence") == 0, "unreadable").otherwise("unknown"))
        .when(partial | refused, "ambiguous").otherwise(F.col("decision"))
    )
    out = df.withColumn("status", status).withColumn("codes", F.concat(own, extra))
    answered = F.when(~(F.col("late") | busy | none | partial | refused), F.col("decided_slug"))
    out = out.withColumn("answered", answered)
    forced = F.col("force") & F.col("answered").isNull() & F.col("valid") & ~_any(F.col("codes"), NOT_FORCED)
    note = F.when(none, "eval_catalog_fallback_no_evidence").otherwise("eval_forced_top1")
    out = out.withColumn("slug", F.when(forced, F.coalesce("first_slug", least_slug)).otherwise(F.col("answered")))
    return out.withColumn("reason_codes", F.when(forced, F.concat("codes", F.array(note))).otherwise(F.col("codes"))).drop("codes", "answered")


def text_outcome(df: DataFrame, least_slug: Column, default_mode: str = "refuse") -> DataFrame:
    """df with status, slug and reason_codes of requests that are answered by their label's text alone.

    df: boxed (a region was given), mode (asked for), scene (null, ambiguous or invalid: what finding the region said) with
    scene_code, reading (null without a reader, busy, ok, no_text, or another status) with reading_code, first_slug, decision,
    decided_slug and policy_reasons of the search and its policy, policy_changed (since it was calibrated), manual (the text
    was given), late, force. The first of these decides: no region to be had; an ambiguous scene or an invalid picture; no
    reader, or none free; nothing read, or not read; the policy. A late request is an error that keeps its reasons. An
    answer for a profile that was not calibrated is ambiguous. A forced request takes the centre where no region may be
    looked for, and then gets the first candidate, or least_slug, unless a reason is one of NOT_FORCED or no region was
    found; a region too large to read gives least_slug.
    """
    of = lambda *codes: F.array(*(c if isinstance(c, Column) else F.lit(c) for c in codes))
    none = F.array().cast("array<string>")
    mode = F.when(F.col("force") & ~F.col("boxed") & F.col("mode").isin("refuse", "auto_bbox_experimental"), "center_80_crop").otherwise(F.col("mode"))
    df = df.withColumn("_mode", mode)
    refused = ~F.col("boxed") & (F.col("_mode") == "refuse")
    too_large = (F.col("scene") == "invalid") & F.col("force") & (F.col("scene_code") == "crop_too_large")
    changed = (F.col("decision") == "accepted") & F.col("policy_changed")
    read = ~refused & F.col("scene").isNull() & F.coalesce(F.col("reading") == "ok", F.lit(False))
    step = lambda when, status, codes: (when, status, codes)
    steps = [
        step(refused, F.lit("unreadable"), of("automatic_roi_unavailable")), step(F.col("scene") == "ambiguous", F.lit("ambiguous_scene"), of(F.col("scene_code"))),
        step(too_large, F.lit("ambiguous"), of("eval_catalog_fallback_crop_too_large")), step(F.col("scene") == "invalid", F.lit("unreadable"), of(F.col("scene_code"))),
        step(F.col("reading").isNull(), F.lit("error"), of("ocr_not_configured")), step(F.col("reading") == "busy", F.lit("error"), of("ocr_capacity_exceeded")),
        step(F.col("reading") == "no_text", F.lit("unreadable"), of("no_text")),
        step(F.col("reading") != "ok", F.lit("error"), of(F.concat(F.lit("ocr_"), "reading"), F.coalesce("reading_code", F.lit("provider_error")))),
    ]
    status, codes = F.when(changed, "ambiguous").otherwise(F.col("decision")), F.concat(F.when(changed, of("policy_configuration_changed")).otherwise(F.col("policy_reasons")), F.when(~F.col("boxed"), of(F.col("_mode"))).otherwise(none))
    for when, s, c in reversed(steps):
        status, codes = F.when(when, s).otherwise(status), F.when(when, c).otherwise(codes)
    slug = F.when(~refused & too_large, least_slug).when(read & ~changed, F.col("decided_slug"))
    late, other = F.col("late"), F.col("boxed") | F.col("manual") | (F.col("_mode") != default_mode)
    out = df.withColumns({"_status": status, "_codes": F.when(late, F.concat(codes, of("deadline"))).otherwise(codes), "_slug": F.when(~late, slug)})
    uncalibrated = F.col("_slug").isNotNull() & ~F.col("force") & other
    forced = F.col("force") & F.col("_slug").isNull() & ~refused & F.col("scene").isNull() & ~_any(F.col("_codes"), NOT_FORCED)
    first = F.when(read, F.col("first_slug"))
    extra = F.when(uncalibrated, of("uncalibrated_request_profile")).when(forced & first.isNotNull(), of("eval_forced_top1")).when(forced, of("eval_catalog_fallback_no_evidence")).otherwise(none)
    final = F.when(late, "error").when(uncalibrated, "ambiguous").otherwise(F.col("_status"))
    answer = F.when(forced, F.coalesce(first, least_slug)).when(~uncalibrated, F.col("_slug"))
    return out.withColumns({"status": final, "slug": answer, "reason_codes": F.concat("_codes", extra)}).drop("_mode", "_status", "_codes", "_slug")


def localization_summary(df: DataFrame) -> DataFrame:
    """One row. df: found, present (a label is in the picture), iou, coverage, latency_ms; refusals stay in the total."""
    rate = lambda c: F.count_if(F.coalesce(F.col("found") & c, F.lit(False)))
    counts = df.agg(
        F.count("*").alias("total"), rate(F.lit(True)).alias("located"), A.ratio(rate(F.lit(True)), F.count("*")).alias("located_fraction"),
        F.count_if(~F.col("present")).alias("negative_total"), rate(~F.col("present")).alias("false_localizations"),
        rate(F.col("iou") >= 0.5).alias("iou_ge_0_5"), rate(F.col("coverage") >= 0.9).alias("gt_coverage_ge_0_9"),
    )
    return counts.crossJoin(F.broadcast(percentiles(df, "latency_ms", {"latency_ms_p50": 0.5, "latency_ms_p95": 0.95})))


def metric_means(df: DataFrame, keys: list[str], metrics: list[str], places: int = 3) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.round(F.avg(m), places).alias(m) for m in metrics))


def histogram(df: DataFrame, *preferred: str) -> DataFrame:
    """value, n: of each row the first of the columns that is not null."""
    return df.groupBy(F.coalesce(*preferred).alias("value")).agg(F.count("*").alias("n"))


def fusion_summary(df: DataFrame, sources: tuple[str, ...] = ("text", "photo", "class")) -> DataFrame:
    """metric, numerator, denominator: what fusion_metrics() leaves out. df: a row per query with known, failed, in_raw,
    in_budget, sources (array of those present), right, margin, latency_ms. Means are sums over counts; the 95th
    percentile is the value at rank ceil(0.95 n)."""
    known, margin = F.col("known"), F.col("margin")
    right = F.col("right") & known & margin.isNotNull()
    wrong = ~F.col("right") & known & margin.isNotNull()
    sums = {
        "raw_recall": (F.count_if(known & F.col("in_raw")), F.count_if(known)), "after_budget_recall": (F.count_if(known & F.col("in_budget")), F.count_if(known)),
        "source_failures": (F.count_if("failed"), F.count("*")), "margin_right": (F.sum(F.when(right, margin)), F.count_if(right)), "margin_wrong": (F.sum(F.when(wrong, margin)), F.count_if(wrong)),
        "latency_p95": (F.max("p95"), F.count("latency_ms")),
    } | {f"missing_{s}": (F.count_if(~F.array_contains("sources", s)), F.count("*")) for s in sources}
    ranked = at_ranks(df.withColumn("all", F.lit(0)), ["all"], "latency_ms", {"p95": lambda n: F.ceil(n * 0.95) - 1})  # one row
    counted = df.withColumn("all", F.lit(0)).join(F.broadcast(ranked), "all", "left")
    one = counted.agg(*(F.struct(F.lit(k).alias("metric"), a.cast("double").alias("numerator"), b.alias("denominator")).alias(k) for k, (a, b) in sums.items()))
    return one.select(F.inline(F.array(*sums)))


def folds(ratings: DataFrame, protocol: str, user: str, item: str, time: str, tie: str, group: str, n_train: int, min_test: int, seed: str) -> DataFrame:
    """ratings with role (train, test) and population (the row may inform others), by protocol.

    temporal: the first n_train events of a user, then all later ones. random: the same in the order of a hash. new_item:
    groups of a fifth of the hash range are held out; train is a user's first n_train events of other groups, test those
    of held-out groups after the last of them. new_user: as temporal for a fifth of the users, while only other users'
    train rows are population. Users without n_train train rows and min_test test rows are left out.
    """
    if protocol not in ("temporal", "random", "new_user", "new_item"):
        raise ValueError("protocol is temporal, random, new_user or new_item")
    share = lambda c: F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col(c).cast("string")), 256), 1, 4), 16, 10).cast("int"), F.lit(5))
    order = [F.sha2(F.concat_ws(":", F.lit(seed), F.col(tie).cast("string")), 256), F.col(tie)] if protocol == "random" else [F.col(time), F.col(tie)]
    held = share(group) == 0 if protocol == "new_item" else F.lit(False)
    rows = ratings.withColumn("_held", held)
    place = F.sum((~F.col("_held")).cast("int")).over(Window.partitionBy(user).orderBy(*order))
    rows = rows.withColumn("_place", place)
    train = ~F.col("_held") & (F.col("_place") <= n_train)
    if protocol == "new_item":
        cutoff = F.max(F.when(train, F.col(time))).over(Window.partitionBy(user))
        test = F.col("_held") & (F.col(time) > cutoff)
    else:
        test = ~train
    rows = rows.withColumn("role", F.when(train, "train").when(test, "test")).where("role IS NOT NULL")
    many = lambda r: F.count_if(F.col("role") == r).over(Window.partitionBy(user))
    rows = rows.withColumn("_train", many("train")).withColumn("_test", many("test")).where((F.col("_train") == n_train) & (F.col("_test") >= min_test))
    population = F.col("role") == "train"
    if protocol == "new_user":
        rows = rows.withColumn("_asked", share(user) == 0)
        return rows.withColumn("population", population & ~F.col("_asked")).where(F.col("_asked") | F.col("population")).drop("_held", "_place", "_train", "_test", "_asked")
    return rows.withColumn("population", population).drop("_held", "_place", "_train", "_test")


def category_shares(df: DataFrame, fit: DataFrame, column: str) -> DataFrame:
    """df with shares (map of category to weight): a known category is 1; an unknown or missing one is the shares of the
    categories among the fit rows, which are frozen. The vocabulary is the fit rows' distinct values, a bounded set."""
    counts = fit.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("c")).agg(F.count("*").alias("n"))
    frozen = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", "n")))).alias("_counts"), F.sum("n").alias("_total"))
    marginal = F.transform_values("_counts", lambda _, n: n / F.col("_total"))
    own = F.create_map(F.col(column), F.lit(1.0))
    known = F.coalesce(F.map_contains_key("_counts", F.col(column)), F.lit(False))
    return df.crossJoin(F.broadcast(frozen)).withColumn("shares", F.when(known, own).otherwise(marginal)).drop("_counts", "_total")


def row_problem(path: Column, exists: Column, size: Column, decoded: Column, most: int = 12 * 1024 * 1024) -> Column:
    """missing_or_unsafe, oversized, undecodable or null: why a row has no hash."""
    return F.when(unsafe_path(path) | ~exists, "missing_or_unsafe").when(size > most, "oversized").when(~decoded, "undecodable")


def fingerprint(fields: list[str]) -> Column:
    """SHA-256 of the compact JSON of the fields in order of name; nulls count."""
    return F.sha2(F.to_json(F.struct(*(F.col(f) for f in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def only_result(jobs: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs with their one result; n_results tells jobs with none or several apart, whose result is null."""
    found = results.groupBy(*keys).agg(F.count("*").alias("n_results"), F.min("result").alias("result"))
    joined = jobs.join(found, keys, "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    return joined.withColumn("result", F.when(F.col("n_results") == 1, F.col("result")))


def due_state(state: Column, updated: Column, leased_until: Column, now: Column, stale_seconds: int = 180) -> Column:
    """A reservation that is older than stale_seconds needs review; a lease that has ended leaves its state open to others."""
    age = F.unix_timestamp(now) - F.unix_timestamp(updated)
    return F.when((state == "reserving") & (age > stale_seconds), "needs_review").when(leased_until.isNotNull() & (leased_until <= now), F.concat(state, F.lit("/free"))).otherwise(state)


def unlabelled_queries(files: DataFrame, query_id: str, digest: str) -> DataFrame:
    """The files as queries; files whose bytes another one has are left out, all of them, with their number in n_same."""
    return files.withColumn("n_same", F.count("*").over(Window.partitionBy(digest))).where("n_same = 1").select(query_id, digest)
