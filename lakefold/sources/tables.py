"""Readers and writers: CSV catalogs, JSON lines, alias lists, query lists, file listings, exclusive outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lakefold.operators.catalog import require

QUERY_ID = "^[A-Za-z0-9._-]+$"


def read_catalog(spark: SparkSession, path: str, required: list[str], key: str) -> DataFrame:
    """All columns as strings, quoted line feeds read, a leading byte order mark dropped, row (from 2) added; a missing
    column or an empty key is an error."""
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    df = header.toDF(*(c.removeprefix("﻿") for c in header.columns))
    require(df, required)
    filled = F.when(F.coalesce(F.trim(key), F.lit("")) == "", F.raise_error(F.lit(f"empty {key}")).cast("string")).otherwise(F.col(key))
    rows = df.withColumn(key, filled).rdd.zipWithIndex().map(lambda r: (*r[0], r[1] + 2))
    return spark.createDataFrame(rows, S.StructType([*(S.StructField(c, S.StringType()) for c in df.columns), S.StructField("row", S.LongType())]))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the schema; blank lines are skipped, and a line that is not such a row is in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path).where(~(F.col("_corrupt_record").isNotNull() & (F.trim("_corrupt_record") == "")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value of one text file, in order."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def read_queries(spark: SparkSession, path: str, columns: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """A tab-separated query list with exactly these columns, and its errors (error, key)."""
    df = spark.read.option("header", True).option("sep", "\t").csv(path)
    if df.columns != columns:
        raise ValueError(f"the header must be {columns}")
    bad = df.where(~F.coalesce(F.col(key).rlike(QUERY_ID), F.lit(False))).select(F.lit("id_invalid").alias("error"), F.col(key).alias("key"))
    twice = df.groupBy(key).count().where("count > 1").select(F.lit("id_repeated").alias("error"), F.col(key).alias("key"))
    return df, bad.unionByName(twice)


def read_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """path, name, length, modificationTime and sha256 of files."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def write_new(df: DataFrame, path: str, kind: str = "json", allow_empty: bool = True) -> None:
    """Write to a path that must not exist; an empty table is an error unless allowed. Quotes in CSV are doubled, as
    read_catalog() reads them."""
    if not allow_empty and df.isEmpty():
        raise ValueError("nothing to write")
    writer = df.write.mode("errorifexists")
    (writer.option("header", True).option("escape", '"') if kind == "csv" else writer).format(kind).save(path)


def predictions(df: DataFrame) -> DataFrame:
    """The columns of a prediction file, in order."""
    return df.select("query_id", "image_path", "image_sha256", "predicted_slug", "latency_ms")
