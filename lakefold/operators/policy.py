"""Prompts, alias recognition, re-ranking, decisions, calibration grids and fusion metrics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakefold.functions import arrays as A

#: Prompt templates by variant; {name}, {producer} and {label} are filled in.
PROMPTS = {"title": ("{label}",), "name": ("{name}",), "name-producer": ("{name}, {producer}",), "visual": ("a photo of a bottle of {name}", "a label that says {name} by {producer}")}

#: Letters that aliases and places in texts meet on, and the bytes up to which an alias list goes to all tasks.
BEGINNING, FEW_BYTES = 3, 8 << 20


def prompts(df: DataFrame, key: str, variant: str, name: str, producer: str, label: str) -> DataFrame:
    """key, prompt_no, prompt: a row per template of the variant."""
    fields = {"name": F.col(name), "producer": F.col(producer), "label": F.col(label)}

    def filled(t: str) -> Column:
        out = F.lit(t)
        for k, c in fields.items():
            out = F.replace(out, F.lit(f"{{{k}}}"), F.coalesce(c, F.lit("")))
        return out

    return df.select(key, F.posexplode(F.array(*map(filled, PROMPTS[variant]))).alias("prompt_no", "prompt"))


def colliding(df: DataFrame, key: str, prompt: str) -> DataFrame:
    """Prompts that more than one key has: prompt, n_members, members."""
    return df.groupBy(prompt).agg(F.count_distinct(key).alias("n_members"), F.array_sort(F.collect_set(key)).alias("members")).where("n_members > 1")


def alias_in_text(texts: DataFrame, aliases: DataFrame, text_id: str, text: str, whole_words: bool) -> DataFrame:
    """text_id, canonical: of the aliases (variant, canonical and, if it has one, position in the list) that a text
    contains the longest.

    As substrings the first in the list wins a tie (without a position, in order of variant); as whole words a tie between
    different canonicals is none. Texts meet aliases on their first word, or on their first three letters (all of a shorter
    one), so no text is compared with every alias. As words ids and beginnings meet first, and only texts with a hit are
    fetched; as substrings each place of a text brings as many letters as the longest alias has, so nothing is fetched.
    Texts are never broadcast: files of many like texts are small, the texts are not. Aliases are where they are few.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    listed = (aliases if "position" in aliases.columns else aliases.withColumn("position", F.lit(0))).where("variant <> ''")
    sizes = listed.agg(F.sum(F.octet_length("variant") + F.coalesce(F.octet_length("canonical"), F.lit(0)) + 64).alias("bytes"), F.max(F.length("variant")).alias("longest"), F.sort_array(F.collect_set(F.least(F.length("variant"), F.lit(BEGINNING)))).alias("beginnings")).first()
    dealt = "broadcast" if (sizes.bytes or 0) <= FEW_BYTES else "merge"
    if whole_words:
        first = listed.withColumn("w", F.get(words(F.col("variant")), F.lit(0))).hint(dealt)
        whole = texts.select(text_id, F.col(text).alias("_text")).hint("merge")
        said = texts.select(text_id, F.explode(F.array_distinct(words(F.col(text)))).alias("w"))
        padded = lambda c: F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" "))
        met = said.join(first, "w").join(whole, text_id).where(F.contains(padded(F.col("_text")), padded(F.col("variant"))))
        ranked = met.select(text_id, "variant", "canonical", "position").distinct().withColumn("n", F.length("variant")).withColumn("top", F.max("n").over(Window.partitionBy(text_id))).where("n = top")
        return ranked.groupBy(text_id).agg(F.when(F.count_distinct("canonical") == 1, F.first("canonical")).alias("canonical"))
    # a variant may begin inside a word: its first letters must be in the text
    first = listed.withColumn("w", F.left("variant", F.lit(BEGINNING))).hint(dealt)
    places = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(sizes.longest or 1)))
    said = texts.select(text_id, F.explode(places).alias("_rest")).select(text_id, "_rest", F.explode(F.array(*(F.left("_rest", F.lit(n)) for n in sizes.beginnings or [1]))).alias("w"))
    met = said.join(first, "w").where(F.startswith("_rest", "variant"))
    best = F.min(F.struct((-F.length("variant")).alias("n"), "position", "variant", "canonical"))
    return met.groupBy(text_id).agg(best.alias("_best")).select(text_id, F.col("_best.canonical").alias("canonical"))


def rerank(df: DataFrame, query_id: str, text_rank: str, text_score: str, cosine: str, share: float | None = None) -> DataFrame:
    """df with new_rank by cosine (share None) or by (1 - share) text and share cosine gaps; null for all rows of a query
    in which a candidate has no reference. Equal ones stay in text order."""
    w = Window.partitionBy(query_id)
    whole = F.bool_and(F.col(cosine).isNotNull()).over(w)
    if share is None:
        value = F.col(cosine)
    else:
        value = (1 - share) * (F.col(text_score) - F.max(text_score).over(w)) / 10 + share * (F.col(cosine) - F.max(cosine).over(w)) / 0.05
    valued = df.withColumn("new_score", F.when(whole, value))
    return valued.withColumn("new_rank", F.when(whole, F.row_number().over(w.orderBy(F.desc("new_score"), text_rank))))


def visual_decision(best: Column, competitor: Column, limits: dict) -> Column:
    """accepted, ambiguous or unknown by the best reference's cosine and its lead over the best other item."""
    return F.when(best.isNull(), "unknown").when(best < limits["min_cosine"], "unknown").when(best - F.coalesce(competitor, F.lit(-1.0)) < limits["min_margin"], "ambiguous").otherwise("accepted")


def pipeline_status(found: Column, deadline_hit: Column, calibrated: Column, n_candidates: Column, decision: Column) -> Column:
    """Status by the first that holds: no region, deadline, no candidates, uncalibrated, the decision."""
    return F.when(~found, "no_object").when(deadline_hit, "deadline").when(n_candidates == 0, "unknown").when(~calibrated, "ambiguous").otherwise(decision)


def skip_reading(photo: Column, second: Column, family_size: Column, least: float = 0.35, gap: float = 0.05) -> Column:
    """Whether the picture alone is enough: a good score, a clear lead, and a family of one."""
    return (photo >= least) & (photo - F.coalesce(second, F.lit(-1.0)) >= gap) & (family_size == 1)


def temperature_losses(df: DataFrame, query_id: str, score: str, is_truth: str, grid: tuple[float, ...] = (0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0)) -> DataFrame:
    """temperature, n, log_loss over the queries whose truth is among their candidates. One pass over the rows for each
    query; the grid multiplies queries, not rows."""
    best = F.max(score).over(Window.partitionBy(query_id))
    rows = df.withColumn("gap", F.col(score) - best)
    sums = [F.sum(F.exp(F.col("gap") / t)).alias(f"s{i}") for i, t in enumerate(grid)]
    each = rows.groupBy(query_id).agg(F.max(F.when(F.col(is_truth), F.col("gap"))).alias("g"), *sums).where("g IS NOT NULL")
    losses = each.select(F.inline(F.array(*(F.struct(F.lit(t).alias("temperature"), (F.log(f"s{i}") - F.col("g") / t).alias("loss")) for i, t in enumerate(grid)))))
    return losses.groupBy("temperature").agg(F.count("*").alias("n"), F.avg("loss").alias("log_loss"))


def best_of_grid(grid: DataFrame, loss: str, tie: list[str]) -> DataFrame:
    return grid.orderBy(F.asc(loss), *tie).limit(1)


def fusion_metrics(df: DataFrame) -> DataFrame:
    """metric, numerator, denominator, value. df: a row per query: known, accepted, top_right, in_top5, family_right,
    family_size, in_union (booleans, but family_size)."""
    from lakefold.operators.report import ratios

    b = lambda c: F.coalesce(F.col(c), F.lit(False))
    known, several = b("known"), F.col("family_size") > 1
    return ratios(df, [
        ("accuracy_at_1", known & b("top_right"), known), ("accuracy_at_5", known & b("in_top5"), known), ("union_recall", known & b("in_union"), known),
        ("family_accuracy", known & b("family_right"), known), ("member_accuracy", known & several & b("family_right") & b("top_right"), known & several & b("family_right")),
        ("precision", known & b("accepted") & b("top_right"), b("accepted")), ("coverage", b("accepted"), F.lit(True)), ("false_accept", ~known & b("accepted"), ~known),
    ])


#: Cumulative shares of a Poisson distribution with mean 1.
POISSON = np.cumsum([np.exp(-1) / math.factorial(k) for k in range(12)])


def paired_interval(df: DataFrame, user: str, a: str, b: str, draws: int = 2000, seed: int = 0, least_users: int = 300, least_gain: float = 0.02) -> DataFrame:
    """n, gain (mean of b - a per user), low, high, passed: the 2.5 and 97.5 per cent limits over users.

    A draw counts each user as often as a Poisson variable with mean 1 says, which follows from the user, the draw and the
    seed. So every task sums the draws over its own users, and one row for each draw is left to bring together.
    """
    per_user = df.groupBy(user).agg(F.avg(F.col(b) - F.col(a)).alias("gain")).where("gain IS NOT NULL")

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(draws, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        counts, sums = np.zeros(draws), np.zeros(draws)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                key, gain = (batch.column(i).slice(at, 512).to_numpy() for i in (0, 1))
                h = key.view(np.uint64)[:, None] ^ number[None, :]
                for step in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                    h = (h ^ (h >> np.uint64(33))) * np.uint64(step)
                times = np.searchsorted(POISSON, ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
                counts += times.sum(axis=0)
                sums += gain @ times
        yield pa.record_batch([pa.array(np.arange(draws)), pa.array(counts), pa.array(sums)], names=["draw", "n", "total"])

    each = per_user.select(F.xxhash64(user).alias("key"), F.col("gain").cast("double").alias("gain")).mapInArrow(drawn, "draw bigint, n double, total double")
    means = each.groupBy("draw").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("mean"))
    limits = means.agg(*(F.percentile("mean", F.lit(q)).alias(name) for name, q in (("low", 0.025), ("high", 0.975))))
    whole = per_user.agg(F.count("*").alias("n"), F.avg("gain").alias("gain")).where("n > 0").crossJoin(F.broadcast(limits))  # one row beside one row
    return whole.select("n", "gain", "low", "high", ((F.col("n") >= least_users) & (F.col("low") >= least_gain)).alias("passed"))


def evidence_differences(stored: DataFrame, fresh: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Keys whose rows are not the same in both tables, with what is wrong: missing, unexpected or changed."""
    pack = lambda d, n: d.select(*keys, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(n))
    both = pack(stored, "a").join(pack(fresh, "b"), keys, "full")
    return both.where("NOT (a <=> b)").select(*keys, F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").otherwise("changed").alias("problem"))


def parsed_list(text: Column) -> Column:
    """Of "['a', 'b']", "(a, b)" or "a, b": the trimmed parts without quotes; null for null."""
    inner = F.regexp_replace(F.trim(text), r"^[\[\(]|[\]\)]$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda p: F.regexp_replace(F.trim(p), "^['\"]|['\"]$", "")), lambda p: p != "")


def ordinal_code(df: DataFrame, fit: DataFrame, column: str) -> DataFrame:
    """df with code: 0 for the fit rows' smallest value and on; -1 outside their range; a value that is not whole is an
    error."""
    ends = fit.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    whole = F.when(F.col(column) != F.floor(column), F.raise_error(F.lit("not a whole number")).cast("boolean")).otherwise(F.lit(True))
    code = F.when(F.col(column).between(F.col("lo"), F.col("hi")), F.col(column) - F.col("lo")).otherwise(-1)
    return df.crossJoin(F.broadcast(ends)).where(whole).withColumn("code", F.coalesce(code, F.lit(-1)).cast("int")).drop("lo", "hi")


def block_features(blocks: list[Column]) -> Column:
    """Blocks one after another, each over the square root of their number."""
    root = float(len(blocks)) ** 0.5
    return F.concat(*(F.transform(b, lambda x: x / root) for b in blocks))


def image_file_error(mime: Column, name: Column, size: Column, most: int = 12 * 1024 * 1024) -> Column:
    """type, empty or size; a file without a type passes by its .heic or .heif name."""
    picture = F.coalesce(mime, F.lit("")).startswith("image/") | ((F.coalesce(mime, F.lit("")) == "") & F.lower(name).rlike(r"\.hei[cf]$"))
    return F.when(~picture, "type").when(size <= 0, "empty").when(size > most, "size")


def similarity_diagnostics(vectors: np.ndarray) -> dict[str, float]:
    """Of a small sample: quantiles of the off-diagonal cosines, the effective rank, and how many components hold 90 per
    cent of the variance."""
    gram = vectors @ vectors.T
    off = gram[~np.eye(len(gram), dtype=bool)]
    values = np.maximum(np.linalg.eigvalsh(gram), 0)[::-1]
    share = values / max(values.sum(), 1e-12)
    entropy = -(share[share > 0] * np.log(share[share > 0])).sum()
    return {"p05": float(np.quantile(off, 0.05)), "p50": float(np.quantile(off, 0.5)), "p95": float(np.quantile(off, 0.95)), "effective_rank": float(np.exp(entropy)), "coverage90": int(np.searchsorted(np.cumsum(share), 0.9) + 1)}


def unit_errors(vectors: DataFrame, row_id: str, vector: str, size: int, tolerance: float = 1e-3) -> DataFrame:
    """row_id, error: null vectors, those of another size, and those not of unit length."""
    length = A.norm(F.col(vector))
    error = F.when(F.col(vector).isNull(), "null").when(F.size(vector) != size, "size").when(~(F.abs(length - 1) <= tolerance), "length")
    return vectors.select(row_id, error.alias("error")).where("error IS NOT NULL")
