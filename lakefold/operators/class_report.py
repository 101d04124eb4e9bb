"""Ranking of classes for pictures, and the report over annotated ones: hits, prompt collisions, hard pairs of pictures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakefold.functions import arrays as A
from lakefold.functions import text as T
from lakefold.operators.similarity import hamming_band

MOST_CLASSES = 20_000
BAND = (8, 16)


def rank_classes(pictures: DataFrame, classes: DataFrame, picture: str, class_id: str, vector: str, k: int = 5) -> DataFrame:
    """picture, class_id, rank, cosine: the k classes closest to each picture, of equals the smaller id. Every task holds the
    classes, which a catalog bounds: more than MOST_CLASSES are refused. A null vector takes no part."""
    index = classes.where(F.col(vector).isNotNull()).select(class_id, vector).orderBy(class_id).limit(MOST_CLASSES + 1).toArrow()
    if index.num_rows > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    ids = index.column(0).combine_chunks()
    matrix = np.asarray(index.column(1).combine_chunks().flatten(), dtype=np.float64).reshape(index.num_rows, -1)
    kind = {c: d.schema[c].dataType.simpleString() for d, c in ((pictures, picture), (classes, class_id))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(ids):
                x = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
                for a in range(0, len(x), 256):
                    scores = np.clip(x[a : a + 256] @ matrix.T, -1, 1)
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # ids ascend
                    row = np.repeat(np.arange(len(best)) + a, best.shape[1])
                    ranks = np.tile(np.arange(1, best.shape[1] + 1, dtype=np.int32), len(best))
                    yield pa.record_batch([batch.column(0).take(pa.array(row)), ids.take(pa.array(best.ravel())), pa.array(ranks), pa.array(np.take_along_axis(scores, best, axis=1).ravel())], names=[picture, class_id, "rank", "cosine"])

    return pictures.where(F.col(vector).isNotNull()).select(picture, vector).mapInArrow(run, f"{picture} {kind[picture]}, {class_id} {kind[class_id]}, rank int, cosine double")


def prompt_groups(items: DataFrame, normalized: bool = False) -> DataFrame:
    """id, group (its smallest id), size: of the items (id, prompts) that share all prompts with another one; normalized: but
    for case, compatibility forms and white space."""
    folded = F.split(T.exact_fold(F.array_join("prompts", "\u0001")), "\u0001")  # a Python function cannot stand inside transform
    prompts = F.transform(folded, T.collapse) if normalized else F.col("prompts")
    rows = items.select("id", F.to_json(F.struct(prompts.alias("p"))).alias("key"))
    groups = rows.groupBy("key").agg(F.min("id").alias("group"), F.count("*").alias("size")).where("size > 1")
    return rows.join(groups, "key").select("id", "group", "size")


def class_rows(queries: DataFrame, rankings: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each query (query_id, source_group, gt_status, gt, hash): top, top1_correct, top5_correct, status
    (ambiguous_prompt where other classes share the top one's prompts, else ranked_only), predicted (null where ambiguous),
    gt_group and gt_normalized_group (null where the truth's prompts are its own), wrong_outside. rankings: query_id, id,
    rank. Only a known truth counts."""
    truth = queries.withColumn("gt", F.when(F.col("gt_status") == "known", F.col("gt")))
    ranked = truth.select("query_id", "gt").join(rankings, "query_id").groupBy("query_id").agg(F.min_by("id", "rank").alias("top"), F.coalesce(F.bool_or((F.col("rank") <= 5) & (F.col("id") == F.col("gt"))), F.lit(False)).alias("top5_correct"))
    exact = prompt_groups(items)
    of = lambda groups, key, name: groups.select(F.col("id").alias(key), F.col("group").alias(name))
    out = truth.join(ranked, "query_id").join(of(exact, "top", "top_group"), "top", "left").join(of(exact, "gt", "gt_group"), "gt", "left").join(of(prompt_groups(items, True), "gt", "gt_normalized_group"), "gt", "left")
    ambiguous = F.col("top_group").isNotNull()
    return out.select(
        "query_id", "source_group", "gt_status", "gt", "hash", "top", F.coalesce(F.col("top") == F.col("gt"), F.lit(False)).alias("top1_correct"), "top5_correct",
        F.when(ambiguous, "ambiguous_prompt").otherwise("ranked_only").alias("status"), F.when(~ambiguous, F.col("top")).alias("predicted"), "gt_group", "gt_normalized_group",
        (F.col("gt_group").isNotNull() & ~F.col("gt_group").eqNullSafe(F.col("top_group"))).alias("wrong_outside"),
    )


def class_metrics(rows: DataFrame, items: DataFrame, band: tuple[int, int] = BAND) -> DataFrame:
    """metric, value over class_rows(): counts and shares (null where nothing is counted). Hard rows are the known ones in any
    pair of known pictures whose hashes differ in a number of bits within the band."""
    known = rows.where("gt_status = 'known'")
    pairs = hamming_band(known, "query_id", "hash", "query_id", *band)
    hard = pairs.select(F.explode(F.array("a", "b")).alias("query_id")).distinct().withColumn("hard", F.lit(True))
    marked = rows.join(hard, "query_id", "left")
    is_known, collides = F.col("gt_status") == "known", F.col("gt_group").isNotNull()
    share = lambda of, among: A.ratio(F.count_if(of & among), F.count_if(among))
    values = {
        "total": F.count("*"), "known": F.count_if(is_known), "unknown": F.count_if(F.col("gt_status") == "unknown"), "ambiguous_gt": F.count_if(F.col("gt_status") == "ambiguous"),
        "known_source_groups": F.count_distinct(F.when(is_known, F.col("source_group"))), "top1_known": share(F.col("top1_correct"), is_known), "top5_known": share(F.col("top5_correct"), is_known),
        "top1_known_hard": share(F.col("top1_correct"), is_known & F.coalesce("hard", F.lit(False))), "unique_prompt_top1": share(F.col("top1_correct"), is_known & ~collides),
        "known_gt_in_collision": share(collides, is_known), "known_gt_in_normalized_collision": share(F.col("gt_normalized_group").isNotNull(), is_known),
        "wrong_top1_outside_group": share(F.col("wrong_outside"), is_known & collides), "top1_ambiguous_prompt": share(F.col("status") == "ambiguous_prompt", F.lit(True)), "status_ranked_only": F.count_if(F.col("status") == "ranked_only"),
    }

    def long(frame: DataFrame, values: dict) -> DataFrame:
        one = frame.agg(*(v.cast("double").alias(k) for k, v in values.items()))
        return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in values))).alias("m")).select("m.*")

    out = long(marked, values).unionByName(long(pairs, {"hard_pairs": F.count("*")}))
    n = items.agg(F.count("*").alias("n"))  # one row
    for name, normalized in (("exact", False), ("normalized", True)):
        groups = prompt_groups(items, normalized).crossJoin(F.broadcast(n))
        counts = {"groups": F.count_distinct("group"), "classes": F.count("*"), "largest_group": F.coalesce(F.max("size"), F.lit(0)), "class_fraction": F.coalesce(F.count("*") / F.max("n"), F.lit(0.0))}
        out = out.unionByName(long(groups, {f"{name}_{k}": v for k, v in counts.items()}))
    return out
