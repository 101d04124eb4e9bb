"""Similar names, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakefold.functions import text as T


def similar_values(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b, similarity: of the distinct values of two one-column tables, those with a similarity_ratio of least or more.

    The ratio is twice the characters that match over both lengths, so two such values share at least the characters that
    least asks for, counted with multiplicity, and the longer is at most 2 / least - 1 times as long. With the characters
    of each value in one order, the rarest first, both have one of their first few in common: an equi join on these finds
    every pair, and counts of shared characters leave few for the ratio itself.
    """

    def signs(df: DataFrame) -> DataFrame:
        value = df.toDF("value").where("value <> ''").distinct()
        letters = F.array_sort(F.split(F.lower("value"), ""))
        numbered = F.transform(letters, lambda c, i: F.struct(c.alias("c"), (i - F.array_position(letters, c) + 1).alias("k")))
        return value.withColumn("signs", F.transform(numbered, lambda x: F.concat_ws("#", x["c"], x["k"].cast("string"))))

    a, b = signs(left), signs(right)
    often = b.select(F.explode("signs").alias("sign")).groupBy("sign").agg(F.count("*").alias("n"))

    def first_signs(df: DataFrame, name: str) -> DataFrame:
        each = df.select("value", F.explode("signs").alias("sign")).join(often, "sign", "left")
        ordered = each.groupBy("value").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "sign"))).alias("o"))
        # shared signs >= least / 2 * (own + other) and other >= own * least / (2 - least)
        shared = F.ceil(F.size("o") * (least / (2 - least)) - 1e-9)
        return ordered.select(F.col("value").alias(name), F.explode(F.slice(F.transform("o", lambda x: x["sign"]), 1, F.size("o") - shared.cast("int") + 1)).alias("sign"))

    met = first_signs(a, "a").join(first_signs(b, "b"), "sign").select("a", "b").distinct()
    both = met.join(a.toDF("a", "sa"), "a").join(b.toDF("b", "sb"), "b")
    enough = F.size(F.array_intersect("sa", "sb")) * 2 >= least * (F.size("sa") + F.size("sb")) - 1e-9
    return both.where(enough).select("a", "b", T.similarity_ratio(F.col("a"), F.col("b")).alias("similarity")).where(F.col("similarity") >= least - 1e-9)
