"""The corpus pipeline: quality rules, near-dedup, substring dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and gives it to the next. Each
row is judged by its own text, so rows that share an id or have none are decided one by one; columns beside doc_id and
text pass untouched, whatever their names (n_chars, where it is there, is that of the text that is left).
Null texts fail the quality rules; in the other stages they are empty. Rows with a null doc_id are nobody's copy and no
earlier document, so dedup keeps them whole. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold import session
from lakefold.llm import decontaminate, near_dedup, packing, quality, substring_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the classifier keep. The classifier learns from the labelled rows among docs."""
    return quality.keep(docs, quality.train(docs, session.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that with its smallest id."""
    return near_dedup.representatives(docs)


def substring_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those of which nothing is left go."""
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")), F.lit(0).alias("_none"))
    found = substring_dedup.find_repeats(docs.select("doc_id", "text", others.alias("others")))
    kept = found.where("n_removed = 0 OR n_removed < n_words").withColumn("left", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    shown = {"doc_id": F.col("doc_id"), "text": F.col("left"), "n_chars": F.length("left").cast("bigint")}
    return kept.select(*(shown.get(c, F.col(f"others.`{c}`")).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.clean(docs, session.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left, in batches."""
    return packing.pack_texts(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_duplicates", substring_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]
#: None: classes by connected components, alignment and dynamic programming are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What the stages wrote for themselves, and what all but the last returned, is deleted."""
    docs, last = session.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with session.scratch(spark) as kept:
            docs, path = session.stored(stage(spark, docs, sf_dir), name)
            kept.append(path)
        if last:
            session.delete(spark, last)
        last = path
    return docs
