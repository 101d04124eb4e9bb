"""Media files: families of renditions, links to catalog items, usability filters, duplicate owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakefold.operators.audit import first_reason

#: Rendition prefixes, and the suffix of an upload.
FAMILY = r"^(?:thumbnail_|small_|medium_|large_)?(.*?)(?:_[0-9a-f]{10})?(\.[A-Za-z0-9]+)$"
RENDITION = r"^(thumbnail|small|medium|large)_"
#: Limits of usable pictures.
LEAST_BYTES, MOST_BYTES, LEAST_SIDE = 15 * 1024, 12 * 1024 * 1024, 256
IMAGE_KINDS = ("image/jpeg", "image/png", "image/webp")


def with_family(files: DataFrame, name: str) -> DataFrame:
    """files with family (stem and extension without rendition prefix and upload suffix), stem and rendition."""
    stem = F.regexp_extract(name, FAMILY, 1)
    return files.withColumns({
        "stem": stem,
        "family": F.regexp_replace(name, RENDITION, ""),
        "rendition": F.coalesce(F.nullif(F.regexp_extract(name, RENDITION, 1), F.lit("")), F.lit("original")),
    })


def inventory(files: DataFrame, name: str, mime: str) -> DataFrame:
    """mime, n, and how many names have an extension of another kind."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    expected = F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "png", "image/png").when(ext == "webp", "image/webp")
    return files.groupBy(mime).agg(F.count("*").alias("n"), F.count_if(~expected.eqNullSafe(F.col(mime))).alias("n_mismatched"))


def usability(size: Column, width: Column, height: Column, decoded: Column) -> Column:
    """The first reason against a picture, else null."""
    return first_reason([
        ("too_small_file", size < LEAST_BYTES), ("too_large_file", size > MOST_BYTES), ("undecodable", ~decoded),
        ("short_side", F.least(width, height) < LEAST_SIDE),
    ])


def shared_owners(files: DataFrame, digest: str, owner: str) -> DataFrame:
    """Content that more than one owner has."""
    return files.groupBy(digest).agg(F.count_distinct(owner).alias("n_owners"), F.array_sort(F.collect_set(owner)).alias("owners")).where("n_owners > 1")


def link(items: DataFrame, families: DataFrame) -> DataFrame:
    """items: slug, photo_stem. families: stem, family, n_originals, mime, size.

    slug, family, method (by_photo, by_slug) or issue, the first of: conflict, missing_name, shared_name, unmatched,
    multiple_families, shared_candidate, originals_not_one, unsupported, oversized.
    """
    by_stem = families.groupBy("stem").agg(F.array_sort(F.collect_set("family")).alias("found"))
    shared = items.where("photo_stem IS NOT NULL").groupBy("photo_stem").agg(F.count_distinct("slug").alias("n_users"))
    joined = (
        items.join(by_stem.select(F.col("stem").alias("photo_stem"), F.col("found").alias("by_photo")), "photo_stem", "left")
        .join(by_stem.select(F.col("stem").alias("slug"), F.col("found").alias("by_slug")), "slug", "left")
        .join(shared, "photo_stem", "left")
    )
    have = lambda c: F.coalesce(F.size(c), F.lit(0))
    photo, slug = have("by_photo") > 0, have("by_slug") > 0
    chosen = F.when(photo, F.col("by_photo")).when(slug, F.col("by_slug"))
    joined = joined.withColumn("chosen", chosen).withColumn("family", F.get("chosen", F.lit(0)))
    consumers = joined.where("family IS NOT NULL").groupBy("family").agg(F.count_distinct("slug").alias("n_consumers"))
    facts = joined.join(consumers, "family", "left").join(families.select("family", "n_originals", "mime", "size"), "family", "left")
    issue = F.coalesce(
        F.when(photo & slug & ~F.arrays_overlap("by_photo", "by_slug"), "conflict"), F.when(F.col("photo_stem").isNull() & ~slug, "missing_name"),
        F.when(F.coalesce("n_users", F.lit(1)) > 1, "shared_name"), F.when(have("chosen") == 0, "unmatched"), F.when(have("chosen") > 1, "multiple_families"),
        F.when(F.col("n_consumers") > 1, "shared_candidate"), F.when(F.col("n_originals") != 1, "originals_not_one"),
        F.when(~F.col("mime").isin(*IMAGE_KINDS), "unsupported"), F.when(F.col("size") > MOST_BYTES, "oversized"),
    )
    return facts.select("slug", "family", issue.alias("issue"), F.when(issue.isNull(), F.when(photo, "by_photo").otherwise("by_slug")).alias("method"))


def contrastive_rows(images: DataFrame, owner: str, path: str, view: str, usable: str) -> DataFrame:
    """Usable images of owners with two distinct paths and a view other than studio_front."""
    good = images.where(F.col(usable))
    owners = good.groupBy(owner).agg(F.count_distinct(path).alias("n"), F.bool_or(F.col(view) != "studio_front").alias("other")).where("n >= 2 AND other").select(owner)
    return good.join(owners, owner, "left_semi")


def joined_or_error(images: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """The inner join; an image without its item is an error."""
    lost = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("no item for "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return images.join(items.withColumn("_known", F.lit(True)), key, "left").withColumn("_known", lost.cast("boolean")).where("_known").drop("_known")
