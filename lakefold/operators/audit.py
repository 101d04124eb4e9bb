"""Manifest audits: each rule gives rows (error, key); leakage looks at whole manifests before any split is chosen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a manifest's columns may hold.
SPLITS = ("train", "validation", "test")
TRUTH = ("known", "unknown", "ambiguous")
SHA256 = "^[0-9a-f]{64}$"


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def rule(df: DataFrame, name: str, condition: Column, key: Column) -> DataFrame:
    return df.where(condition).select(F.lit(name).alias("error"), key.cast("string").alias("key"))


def repeated(df: DataFrame, name: str, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(F.lit(name).alias("error"), F.col(key).cast("string").alias("key"))


def across(df: DataFrame, name: str, key: str, split: str) -> DataFrame:
    """Keys that more than one split has."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(split).alias("n")).where("n > 1").select(F.lit(name).alias("error"), F.col(key).cast("string").alias("key"))


def query_manifest_errors(q: DataFrame, items: DataFrame, gallery: DataFrame) -> DataFrame:
    """q: query_id, source_group, split, image_sha256, gt_status, gt_slug, gt_source. items: slug. gallery: image_sha256,
    source_group. Distinct (error, key)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    key = F.col("query_id").cast("string")
    known = F.coalesce(F.col("gt_status") == "known", F.lit(False))
    flag = lambda d, c, name: d.where(F.col(c).isNotNull()).select(c).distinct().withColumn(name, F.lit(True))
    met = (
        q.join(flag(gallery, "image_sha256", "_hash"), "image_sha256", "left").join(flag(gallery, "source_group", "_group"), "source_group", "left")
        .join(flag(items.select(F.col("slug").alias("gt_slug")), "gt_slug", "_item"), "gt_slug", "left")
    )
    rules = {
        "query_id_missing": empty("query_id"), "source_group_missing": empty("source_group"), "split_invalid": ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)),
        "hash_invalid": ~F.coalesce(F.col("image_sha256").rlike(SHA256), F.lit(False)), "gallery_leak_by_hash": F.col("_hash").isNotNull(), "gallery_leak_by_group": F.col("_group").isNotNull(),
        "gt_status_invalid": ~F.coalesce(F.col("gt_status").isin(*TRUTH), F.lit(False)), "known_without_slug_or_source": known & (empty("gt_slug") | empty("gt_source")),
        "known_slug_not_in_catalog": known & ~empty("gt_slug") & F.col("_item").isNull(), "slug_without_known": ~known & F.col("gt_slug").isNotNull(),
    }
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(n).alias("error"), (F.lit("") if n == "query_id_missing" else key).alias("key"))) for n, c in rules.items())))
    parts = [
        met.select(F.inline(found)), repeated(q, "query_id_repeated", "query_id"),
        across(q, "source_group_across_splits", "source_group", "split"), across(q, "hash_across_splits", "image_sha256", "split"),
    ]
    return union(parts).distinct()


def leakage(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(error, key) for each value of a key that both manifests have; an unknown value on both sides counts."""
    parts = []
    for k in keys:
        left, right = (d.select(F.col(k).alias("k")).distinct() for d in (a, b))
        parts.append(left.alias("x").join(right.alias("y"), F.expr("x.k <=> y.k"), "left_semi").select(F.lit(f"shared_{k}").alias("error"), F.coalesce(F.col("k").cast("string"), F.lit("<null>")).alias("key")))
    return union(parts)


def retrieval_manifest_errors(q: DataFrame, images: DataFrame) -> DataFrame:
    """q: query_id, text, relevant_ids array, hard_negative boolean. images: image_id."""
    key = F.col("query_id")
    parts = [
        repeated(q, "query_id_repeated", "query_id"),
        rule(q, "text_missing", F.coalesce(F.trim("text"), F.lit("")) == "", key),
        rule(q, "relevant_missing", F.coalesce(F.size("relevant_ids"), F.lit(0)) < 1, key),
        rule(q, "relevant_repeated", F.size(F.array_distinct("relevant_ids")) < F.size("relevant_ids"), key),
        rule(q, "hard_negative_missing", F.col("hard_negative").isNull(), key),
        rule(q.select("query_id", F.explode("relevant_ids").alias("image_id")).join(images.select("image_id").distinct(), "image_id", "left_anti"), "relevant_unknown", F.lit(True), key),
    ]
    return union(parts).distinct()


def unsafe_path(path: Column) -> Column:
    """Absolute, drive-lettered, backslashed, or with a step up."""
    return F.coalesce(path.rlike(r"^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)"), F.lit(True)) | (path == "")


def coverage(gallery: DataFrame, items: DataFrame, owner: str, slug: str) -> DataFrame:
    """covered, total and their ratio (null for an empty catalog)."""
    total = items.select(F.count_distinct(slug).alias("total"))
    covered = gallery.join(items.select(F.col(slug).alias(owner)).distinct(), owner, "left_semi").select(F.count_distinct(owner).alias("covered"))
    return covered.crossJoin(total).withColumn("ratio", F.try_divide(F.col("covered").cast("double"), F.col("total")))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that a row breaks, else null."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(True)), name).otherwise(out)
    return out


def inventory_difference(expected: DataFrame, found: DataFrame, path: str, digest: str) -> DataFrame:
    """path, status (missing, unexpected, changed) of two file inventories."""
    a, b = expected.select(path, F.col(digest).alias("want"), F.lit(1).alias("in_a")), found.select(path, F.col(digest).alias("have"), F.lit(1).alias("in_b"))
    status = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "unexpected").when(~F.col("want").eqNullSafe(F.col("have")), "changed")
    return a.join(b, path, "full").select(path, status.alias("status")).where("status IS NOT NULL")
