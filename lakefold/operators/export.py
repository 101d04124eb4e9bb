"""Training tables of items and pictures: rows, reasons against pictures, and a summary counted while they are written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lakefold.operators.media import shared_owners, usability
from lakefold.operators.similarity import hamming_pairs
from lakefold.operators.splits import hashed_split

NEAR_BITS = 6
#: The reasons against a picture, in the order in which they are looked for.
REASONS = ("unresolved_link", "sha256_shared_between_slugs", "missing_file", "too_small", "oversized", "undecodable", "short_side_too_small", "phash_near_duplicate")
_USABILITY = {"too_small_file": "too_small", "too_large_file": "oversized", "undecodable": "undecodable", "short_side": "short_side_too_small"}


def item_rows(items: DataFrame) -> DataFrame:
    """The item table of items (item_id, name, producer, color, vintage): split is the producer's, so all its items are in one
    part."""
    return items.select(F.col("item_id").alias("wine_id"), F.col("name").alias("name_ru"), "producer", "color", "vintage", F.lit("").alias("ean"), hashed_split(F.coalesce("producer", F.lit(""))).alias("producer_split"))


def judged_pictures(links: DataFrame) -> DataFrame:
    """links (item_id, status, path, sha256, size, width, height, decoded, phash; one for each item) with reason, null for a
    picture that is used: linked, its content no other item's, its file there and usable, and no picture of another item
    within NEAR_BITS bits (of such a pair both go; only pictures that are used otherwise count)."""
    shared = shared_owners(links.where("sha256 IS NOT NULL"), "sha256", "item_id").select("sha256", F.lit(True).alias("shared"))
    known = links.join(shared, "sha256", "left")
    unusable = usability(F.col("size"), F.col("width"), F.col("height"), F.coalesce("decoded", F.lit(False)))
    named = F.try_element_at(F.create_map(*(F.lit(x) for pair in _USABILITY.items() for x in pair)), unusable)
    reason = F.when(~F.coalesce(F.col("status") == "candidate", F.lit(False)) | F.col("path").isNull(), "unresolved_link").when(F.col("shared"), "sha256_shared_between_slugs").when(F.col("size").isNull(), "missing_file").otherwise(named)
    first = known.withColumn("reason", reason).drop("shared")
    pairs = hamming_pairs(first.where("reason IS NULL"), "item_id", "phash", "item_id", NEAR_BITS)
    near = pairs.select(F.explode(F.array("a", "b")).alias("item_id")).distinct().withColumn("near", F.lit(True))
    return first.join(near, "item_id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("near"), "phash_near_duplicate"))).drop("near")


def picture_rows(judged: DataFrame) -> DataFrame:
    """The picture table. One studio picture of an item does not make it usable for training pairs."""
    used = judged.where("reason IS NULL")
    return used.select(F.concat("item_id", F.lit("-0001")).alias("image_id"), F.col("item_id").alias("wine_id"), "path", F.lit("studio_front").alias("view"), "sha256", F.lit("strapi").alias("source"), F.lit("").alias("source_url"), F.lit("none").alias("ocr_hit"), F.lit(0).alias("usable_train"))


def export(items: DataFrame, links: DataFrame, path: str) -> dict:
    """Writes path/items, path/pictures (Parquet) and path/summary.json, and gives the summary. Everything is written beside
    the path and becomes visible at once; a path that is there is an error, and nothing of it changes."""
    spark = items.sparkSession
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, staged = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.staged")
    files = target.getFileSystem(hadoop)
    if files.exists(target):
        raise FileExistsError(path)
    files.delete(staged, True)  # of a run that did not end
    n_items, n_links = Observation("items"), Observation("links")
    judged = judged_pictures(links)
    counted = judged.observe(n_links, F.count("*").alias("links"), F.count_if(F.col("status") == "candidate").alias("candidates"), F.count_if(F.col("reason").isNull()).alias("pictures"), *(F.count_if(F.col("reason") == r).alias(r) for r in REASONS))
    item_rows(items).observe(n_items, F.count("*").alias("items")).write.parquet(f"{path.rstrip('/')}.staged/items")
    picture_rows(counted).write.parquet(f"{path.rstrip('/')}.staged/pictures")
    counts = n_links.get
    summary = {"items": n_items.get["items"], "pictures": counts["pictures"], "candidate_links": counts["candidates"], "unresolved": counts["links"] - counts["candidates"], "rejected": {r: counts[r] for r in sorted(REASONS) if counts[r]}}
    out = files.create(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.staged/summary.json"))
    out.write(bytearray(json.dumps(summary).encode()))
    out.close()
    if not files.rename(staged, target):
        raise FileExistsError(path)
    return summary
