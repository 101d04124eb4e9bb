"""Fusion of ranked sources into one ranking, with families, label attributes and accept decisions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Score bounds of each source.
BOUNDS = {"text": (0.0, 100.0), "photo": (-1.0, 1.0), "class": (-1.0, 1.0)}


@dataclass(frozen=True)
class FusionConfig:
    """Scales, weights and limits of the published formula."""

    mode: str = "gap"
    tau: dict[str, float] = field(default_factory=lambda: {"photo": 0.05, "class": 0.05, "text": 10.0})
    weights: dict[str, float] = field(default_factory=lambda: {"photo": 1.0, "class": 0.3, "text": 0.7})
    top_k: int = 50
    max_candidates: int = 300
    rrf_k: float = 60.0
    member_photo: float = 0.2
    member_text: float = 0.1

    def __post_init__(self) -> None:
        if self.mode not in ("gap", "rrf") or self.top_k < 1 or self.max_candidates < 1 or any(t <= 0 for t in self.tau.values()):
            raise ValueError("mode is gap or rrf; limits and scales are positive")


def evidence_errors(evidence: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, error, key: rows that break a rule (source, bounds, rank, unknown item, repeats, order against scores)."""
    low, high = (F.create_map(*(F.lit(x) for s, b in BOUNDS.items() for x in (s, b[i]))) for i in (0, 1))
    known = F.col("source").isin(*BOUNDS)
    bounds = (F.col("score") < F.try_element_at(low, "source") - 1e-3) | (F.col("score") > F.try_element_at(high, "source") + 1e-3) | F.isnan("score")
    row = lambda condition, name: evidence.where(condition).select("query_id", F.lit(name).alias("error"), F.concat_ws("/", "source", "slug").alias("key"))
    repeated = lambda column, name: evidence.groupBy("query_id", "source", column).count().where("count > 1").select("query_id", F.lit(name).alias("error"), F.concat_ws("/", "source", F.col(column).cast("string")).alias("key"))
    steps = evidence.withColumn("before", F.lag("score").over(Window.partitionBy("query_id", "source").orderBy("rank")))
    return (
        row(~known, "unknown_source").unionByName(row(known & bounds, "score_out_of_bounds")).unionByName(row(F.col("rank") < 1, "rank_below_one"))
        .unionByName(evidence.join(items.select("slug"), "slug", "left_anti").select("query_id", F.lit("unknown_item").alias("error"), F.concat_ws("/", "source", "slug").alias("key")))
        .unionByName(repeated("slug", "repeated_item")).unionByName(repeated("rank", "repeated_rank"))
        .unionByName(steps.where("before + 1e-6 < score").select("query_id", F.lit("rank_against_score").alias("error"), F.concat_ws("/", "source", "slug").alias("key")))
    )


def _within_budget(total: Column, families: Column, limit: int) -> Column:
    """Whole families join the candidates in order of their key while the total stays within the limit: keys of those that
    do. families: array of (family, extra), extra being the members that are no candidates yet."""
    start = F.struct(total.cast("bigint").alias("n"), F.array().cast("array<string>").alias("taken"))

    def step(have: Column, f: Column) -> Column:
        more = F.struct((have["n"] + f["extra"]).alias("n"), F.concat(have["taken"], F.array(f["family"])).alias("taken"))
        return F.when(have["n"] + f["extra"] <= limit, more).otherwise(have)

    return F.aggregate(F.sort_array(families), start, step, lambda have: have["taken"])


def observed(evidence: DataFrame, items: DataFrame, config: FusionConfig) -> DataFrame:
    """The candidates of each query: query_id, slug, family, family_size, has_photo and, of each source, gap (to its best,
    in its scale) and given (rank)."""
    order = Window.partitionBy("query_id", "source").orderBy(F.desc("score"), F.asc("slug"))
    ranked = evidence.withColumn("position", F.row_number().over(order))
    whole = Window.partitionBy("query_id", "source")
    ranked = ranked.withColumn("best", F.max("score").over(whole)).withColumn("n", F.count("*").over(whole))
    tau = F.create_map(*(F.lit(x) for kv in config.tau.items() for x in kv))
    at_floor = F.max(F.when(F.col("position") == F.least(F.lit(config.top_k), F.col("n")), F.col("score")))
    sources = ranked.groupBy("query_id", "source").agg(F.max("best").alias("best"), at_floor.alias("floor_score"))
    sizes = items.groupBy("family").agg(F.count("*").alias("family_size"))
    selected = ranked.where(F.col("position") <= config.top_k).select("query_id", "slug").distinct().join(items.select("slug", "family"), "slug")
    own = selected.groupBy("query_id", "family").agg(F.count("*").alias("n")).join(sizes, "family")
    sets = own.groupBy("query_id").agg(F.sum("n").alias("n"), F.collect_list(F.struct(F.col("family").cast("string").alias("family"), (F.col("family_size") - F.col("n")).alias("extra"))).alias("families"))
    taken = sets.select("query_id", F.explode(_within_budget(F.col("n"), F.col("families"), config.max_candidates)).alias("family"))
    expanded = selected.select("query_id", "slug").unionByName(taken.join(items.select("slug", "family"), "family").select("query_id", "slug")).distinct()
    best_position = ranked.groupBy("query_id", "slug").agg(F.min("position").alias("first"))
    trimmed = expanded.join(best_position, ["query_id", "slug"], "left").withColumn("cut", F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("first", F.lit(10**9)), "slug")))
    candidates = trimmed.where(F.col("cut") <= config.max_candidates).select("query_id", "slug")
    scored = candidates.join(sources, "query_id").join(ranked.select("query_id", "source", "slug", "score", F.col("rank").alias("given")), ["query_id", "source", "slug"], "left")
    scale = F.element_at(tau, F.col("source"))
    gap = F.when(F.col("score").isNotNull(), (F.col("score") - F.col("best")) / scale).when(F.col("source") == "text", (F.col("floor_score") - F.col("best")) / scale - 1).otherwise(0.0)
    of = lambda source, c: F.max(F.when(F.col("source") == source, F.col(c)))
    facts = [of(s, c).alias(f"{s}_{c}") for s in BOUNDS for c in ("gap", "given")]
    has_photo = F.max((F.col("source") == "photo") & F.col("score").isNotNull()).alias("has_photo")
    seen = scored.withColumn("gap", gap).groupBy("query_id", "slug").agg(*facts, has_photo)
    return seen.join(items.select("slug", "family"), "slug").join(sizes, "family")


def _in_order(values: list[Column]) -> Column:
    """The sum in this order, whatever the order of rows; a source that is not there adds nothing."""
    return reduce(Column.__add__, (F.coalesce(v, F.lit(0.0)) for v in values))


def blended(seen: DataFrame, weight: dict[str, Column], mode: Column, config: FusionConfig, trial: list[str], bonus: DataFrame | None = None) -> DataFrame:
    """observed()'s rows (and columns trial, which tell weights and modes apart) with blend_score and rank."""
    base = _in_order([F.when(mode == "gap", weight[s] * F.col(f"{s}_gap")).otherwise(F.when(F.col(f"{s}_given") <= config.top_k, weight[s] * config.rrf_k / (config.rrf_k + F.col(f"{s}_given")))) for s in BOUNDS])
    member = F.when(mode == "gap", _in_order([config.member_photo * F.col("photo_gap"), config.member_text * F.col("text_gap")])).otherwise(0.0)
    rows = seen.withColumn("base", base).withColumn("member", member)
    rows = rows.withColumn("family_score", F.max("base").over(Window.partitionBy("query_id", *trial, "family")))
    rows = rows.join(bonus.select("query_id", "slug", "bonus"), ["query_id", "slug"], "left") if bonus is not None else rows.withColumn("bonus", F.lit(0.0))
    rows = rows.withColumn("attribute_score", F.coalesce("bonus", F.lit(0.0))).withColumn("blend_score", F.col("family_score") + F.col("member") + F.col("attribute_score"))
    final = Window.partitionBy("query_id", *trial).orderBy(F.desc(F.round("blend_score", 9)), F.col("slug").rlike("-[12]$"), ~F.col("has_photo"), "slug")
    return rows.withColumn("rank", F.row_number().over(final))


def fuse(evidence: DataFrame, items: DataFrame, config: FusionConfig = FusionConfig(), attribute_score: DataFrame | None = None) -> DataFrame:
    """evidence: query_id, source, slug, score, rank. items: slug, family. attribute_score: query_id, slug, bonus.

    Returns query_id, slug, rank, blend_score, display_score, attribute_score, family, family_size. A missing text hit is
    one below the floor; a missing photo or class reference is neutral. Scores that agree in nine places are ties.
    """
    weight = {s: F.lit(config.weights[s]) for s in BOUNDS}
    base = blended(observed(evidence, items, config), weight, F.lit(config.mode), config, [], attribute_score)
    out = base.withColumn("top", F.max("blend_score").over(Window.partitionBy("query_id")))
    display = F.greatest(F.lit(0.0), 100 + 10 * (F.col("blend_score") - F.col("top")))
    return out.select("query_id", "slug", "rank", "blend_score", F.round(display, 2).alias("display_score"), "attribute_score", "family", "family_size")


def tune(evidence: DataFrame, items: DataFrame, truth: DataFrame, config: FusionConfig = FusionConfig(), photo: tuple[float, ...] = (0.5, 1.0, 2.0), text: tuple[float, ...] = (0.3, 0.7, 1.0)) -> DataFrame:
    """place, mode, photo, text, n, accuracy, family_accuracy over the queries of truth (query_id, slug): every pair of
    weights in both modes. The best accuracy comes first, then family accuracy, then mode and weights.

    Candidates and gaps are found once; the trials multiply candidates, not the work before them.
    """
    trials = F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(p).alias("photo"), F.lit(t).alias("text")) for m in ("gap", "rrf") for p in photo for t in text))
    seen = observed(evidence, items, config).join(truth.select("query_id").distinct(), "query_id", "left_semi")
    each = seen.withColumn("trial", F.explode(trials))
    weight = {"photo": F.col("trial.photo"), "text": F.col("trial.text"), "class": F.lit(config.weights["class"])}
    tops = blended(each, weight, F.col("trial.mode"), config, ["trial"]).where("rank = 1").select("query_id", "trial", F.col("slug").alias("top"), F.col("family").alias("top_family"))
    asked = truth.join(items.select("slug", "family"), "slug", "left").withColumn("trial", F.explode(trials))
    right = lambda a, b: F.avg(F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("double"))
    found = asked.join(tops, ["query_id", "trial"], "left").groupBy("trial").agg(F.count("*").alias("n"), right("top", "slug").alias("accuracy"), right("top_family", "family").alias("family_accuracy"))
    order = Window.orderBy(F.desc("accuracy"), F.desc("family_accuracy"), "trial.mode", "trial.photo", "trial.text")  # a row per trial
    return found.withColumn("place", F.row_number().over(order)).select("place", "trial.*", "n", "accuracy", "family_accuracy")


#: Score of an attribute that agrees and of one that does not.
ATTRIBUTES = {"year": (1.5, -2.0), "sweetness": (1.0, -1.5), "grape": (0.7, -0.7), "colour": (0.5, -1.0), "strength": (0.5, -0.5), "producer": (0.5, -1.0)}


def attribute_bonus(name: str, query: Column, item: Column) -> Column:
    """0 where a side is missing. Arrays (grape) agree when they overlap; strengths within a quarter of a per cent."""
    plus, minus = ATTRIBUTES[name]
    if name == "grape":
        known, agree = (F.size(query) > 0) & (F.size(item) > 0), F.arrays_overlap(query, item)
    else:
        known = query.isNotNull() & item.isNotNull()
        agree = F.abs(query - item) <= 0.25 if name == "strength" else query == item
    return F.when(F.coalesce(known, F.lit(False)), F.when(agree, plus).otherwise(minus)).otherwise(0.0)


def softmax(df: DataFrame, query_id: str, score: str, temperature: float = 1.0) -> DataFrame:
    """df with probability over each query's rows."""
    w = Window.partitionBy(query_id)
    e = F.exp((F.col(score) - F.max(score).over(w)) / temperature)
    return df.withColumn("probability", e / F.sum(e).over(w))


def with_margin(df: DataFrame, query_id: str, score: str, order: list[Column]) -> DataFrame:
    """The first row of each query with margin to the second; null for a single row."""
    w = Window.partitionBy(query_id).orderBy(*order)
    return df.withColumn("margin", F.col(score) - F.lead(score).over(w)).withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def text_decision(score: Column, distance: Column, margin: Column, policy: dict | None) -> Column:
    """accepted, ambiguous or unknown: no candidate, no policy, below a limit, a small margin, in this order. A single
    candidate's margin counts as enough."""
    out = F.when(score.isNull(), "unknown")
    if policy is None:
        return out.otherwise("ambiguous")
    out = out.when((score < policy["min_score"]) | (distance > policy["max_distance"]), "unknown")
    return out.when(margin < policy["min_margin"], "ambiguous").otherwise("accepted")


def fusion_decision(signals_over: Column, margin: Column, min_margin: float) -> Column:
    """No signal over its limit: unknown; a single row or a small margin: ambiguous."""
    return F.when(~F.coalesce(signals_over, F.lit(False)), "unknown").when(margin.isNull() | (margin < min_margin), "ambiguous").otherwise("accepted")


def forced_choice(queries: DataFrame, top: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, slug: the first candidate, else the catalog's smallest slug."""
    least = items.agg(F.min("slug").alias("least"))
    return queries.select("query_id").join(top.where("rank = 1").select("query_id", "slug"), "query_id", "left").crossJoin(F.broadcast(least)).select("query_id", F.coalesce("slug", "least").alias("slug"))
