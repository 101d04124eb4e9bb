"""Entity resolution and enrichment: clustering, matching, merging of looked-up fields, quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakefold.functions import arrays as A
from lakefold.functions import text as T
from lakefold.operators import leaders
from lakefold.operators.names import similar_values


def cluster_records(df: DataFrame, row_id: str, name: str, exact: str, least: float = 0.9) -> DataFrame:
    """row_id, cluster: leader clustering by names alone."""
    return leaders.cluster(df, row_id, name, exact, least)


def resolve(records: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """record_id, item_id, score: the best of all items (0.6 producer + 0.4 name similarity, halved where both years are
    known and differ) where it reaches least, which is over 0.6; else null, with score 0. Of equals the smaller id wins.
    Both: id, producer, name, year.

    A score of least needs a producer's similarity of (least - 0.4) / 0.6 and a name's of (least - 0.6) / 0.4, and no
    year against it, so items are met through the distinct producers that are so similar. Only distinct producers and names
    are compared; records and items of equal producer, name and year are one row, and rows meet on their years.
    """
    near = similar_values(records.select("producer"), items.select("producer"), (least - 0.4) / 0.6).toDF("r_producer", "i_producer", "producers")
    mine = records.select(F.col("producer").alias("r_producer"), F.col("name").alias("r_name"), F.col("year").alias("r_year")).distinct()
    theirs = items.groupBy(F.col("producer").alias("i_producer"), F.col("name").alias("i_name"), F.col("year").alias("i_year")).agg(F.min("item_id").alias("item_id"))
    both = mine.select("r_producer", "r_name").distinct().join(near, "r_producer").join(theirs.select("i_producer", "i_name").distinct(), "i_producer")
    # the names' ratio is at most twice the shorter over both lengths
    short, total = F.least(F.length("r_name"), F.length("i_name")), F.length("r_name") + F.length("i_name")
    possible = both.where(F.col("producers") * 0.6 + F.coalesce(F.try_divide(0.8 * short, total), F.lit(0.0)) >= least - 1e-9)
    names = possible.select("r_name", "i_name").distinct().withColumn("names", T.similarity_ratio(F.col("r_name"), F.col("i_name")))
    scored = possible.join(names, ["r_name", "i_name"]).withColumn("score", 0.6 * F.col("producers") + 0.4 * F.col("names")).where(F.col("score") >= least)
    own, texts = ["r_producer", "r_name", "r_year"], ["i_producer", "i_name"]
    alike = mine.join(scored.select("r_producer", "r_name", *texts, "score"), ["r_producer", "r_name"])
    same = alike.where("r_year IS NOT NULL").withColumn("i_year", F.col("r_year")).join(theirs, [*texts, "i_year"])
    open_item = alike.where("r_year IS NOT NULL").join(theirs.where("i_year IS NULL").drop("i_year"), texts)
    open_record = alike.where("r_year IS NULL").join(theirs.groupBy(*texts).agg(F.min("item_id").alias("item_id")), texts)
    met = same.select(*own, "item_id", "score").unionByName(open_item.select(*own, "item_id", "score")).unionByName(open_record.select(*own, "item_id", "score"))
    best = met.groupBy(*own).agg(F.min_by(F.struct("item_id", "score"), F.struct((-F.col("score")).alias("s"), F.col("item_id").alias("i"))).alias("b"))
    found = (F.col("producer") == F.col("r_producer")) & (F.col("name") == F.col("r_name")) & F.col("year").eqNullSafe(F.col("r_year"))
    return records.join(best, found, "left").select("record_id", F.col("b.item_id").alias("item_id"), F.coalesce("b.score", F.lit(0.0)).alias("score"))


def merge_fields(lookups: DataFrame) -> DataFrame:
    """record_id, field, value, confidence, source: of a field's values that are not null the most confident; of equals
    the first lookup, of equal lookups the smallest value, then source, however rows come."""
    order = F.struct((-F.col("confidence")).alias("c"), F.col("lookup").alias("l"), F.col("value").alias("v"), F.col("source").alias("s"))
    return lookups.where("value IS NOT NULL").groupBy("record_id", "field").agg(F.min_by(F.struct("value", "confidence", "source"), order).alias("r")).select("record_id", "field", "r.*")


def quality_report(fields: DataFrame, records: DataFrame) -> DataFrame:
    """field, missing_rate (of all records), mean_confidence"""
    n = F.broadcast(records.agg(F.count("*").alias("n")))  # one row
    each = fields.groupBy("field").agg(F.count("value").alias("known"), F.avg("confidence").alias("mean_confidence")).crossJoin(n)
    return each.select("field", (1 - F.col("known") / F.col("n")).alias("missing_rate"), "mean_confidence")


def field_audit(df: DataFrame, least: float = 0.7) -> DataFrame:
    """field, source (null is a group), n, exact accuracy, mean absolute error where all are numbers, share retained."""
    p, t = F.try_to_number("predicted", F.lit("S999999999D999999")), F.try_to_number("truth", F.lit("S999999999D999999"))
    numeric = F.bool_and(p.isNotNull() & t.isNotNull())
    return df.groupBy("field", "source").agg(
        F.count("*").alias("n"), F.avg(F.col("predicted").eqNullSafe(F.col("truth")).cast("double")).alias("exact"),
        F.when(numeric, F.avg(F.abs(p.cast("double") - t.cast("double")))).alias("mae"), F.avg((F.col("confidence") >= least).cast("double")).alias("retained"),
    )


def confident(df: DataFrame, value: str, confidence: str, least: float) -> DataFrame:
    """value is null where its confidence is unknown or below least."""
    return df.withColumn(value, F.when(F.col(confidence) >= least, F.col(value)))


# Encoders: fitted on some rows, applied to all


def factorize(df: DataFrame, column: str) -> DataFrame:
    """value, code: 0, 1... in the order of the values; null has no code."""
    distinct = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return distinct.withColumn("code", F.row_number().over(Window.orderBy("value")) - 1)  # a row per distinct value


def one_hot(df: DataFrame, code: str, vocabulary: list, marginal: list[float]) -> DataFrame:
    """df with onehot; an unknown code (null or -1) is the marginal."""
    known = F.transform(F.sequence(F.lit(0), F.lit(len(vocabulary) - 1)), lambda i: (i == F.col(code)).cast("double"))
    return df.withColumn("onehot", F.when(F.col(code) >= 0, known).otherwise(F.array(*map(F.lit, marginal))))


def multi_hot(df: DataFrame, codes: str, size: int, marginal: list[float]) -> DataFrame:
    """df with multihot of unit length: how often each code is there; an empty list is the marginal."""
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(codes, lambda c: c == i)).cast("double"))
    some = F.coalesce(F.size(codes), F.lit(0)) > 0
    return df.withColumn("multihot", F.coalesce(A.unit(F.when(some, counts).otherwise(F.array(*map(F.lit, marginal)))), F.array(*map(F.lit, marginal))))


def standardize(df: DataFrame, fit: DataFrame, columns: list[str]) -> DataFrame:
    """df with c_z and c_missing: medians, means and deviations of the fit rows; deviations are of median-filled data, and
    one that is 0 or unknown is 1."""
    medians = fit.agg(*(F.coalesce(F.percentile(c, F.lit(0.5)), F.lit(0.0)).alias(f"{c}_med") for c in columns))
    filled = fit.crossJoin(F.broadcast(medians)).select(*(F.coalesce(F.col(c), F.col(f"{c}_med")).alias(c) for c in columns))
    moments = filled.agg(*(F.avg(c).alias(f"{c}_mean") for c in columns), *(F.coalesce(F.nullif(F.stddev_samp(c), F.lit(0.0)), F.lit(1.0)).alias(f"{c}_sd") for c in columns))
    out = df.crossJoin(F.broadcast(medians)).crossJoin(F.broadcast(moments))
    for c in columns:
        out = out.withColumn(f"{c}_z", (F.coalesce(F.col(c), F.col(f"{c}_med")) - F.col(f"{c}_mean")) / F.col(f"{c}_sd")).withColumn(f"{c}_missing", F.col(c).isNull().cast("double"))
    return out.drop(*(f"{c}_{s}" for c in columns for s in ("med", "mean", "sd")))


def path_levels(columns: list[str]) -> Column:
    """a, a/b, a/b/c...; null from the first missing level on."""
    return F.array(*(F.when(F.forall(F.array(*columns[: i + 1]), lambda c: c.isNotNull()), F.concat_ws("/", *columns[: i + 1])) for i in range(len(columns))))
