"""Catalog: load checks, de-duplication, templates, equivalence groups and families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakefold.functions import text as T

#: Colour of a category, by its trimmed lower-case name.
CATEGORY_COLOURS = {"белое": "Белое", "красное": "Красное", "розовое": "Розовое", "оранжевое": "Оранжевое"}


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def deduplicate(df: DataFrame, key: str, row_id: str) -> tuple[DataFrame, DataFrame]:
    """Rows by key with their row ids, and a report of one row. Rows of one key that differ in any other column are
    conflicts: they are counted, and their key is left out of the first table."""
    others = [c for c in df.columns if c not in (key, row_id)]
    grouped = df.groupBy(key).agg(
        F.count("*").alias("n_rows"),
        F.count_distinct(F.to_json(F.struct(*others))).alias("n_versions"),
        F.array_sort(F.collect_list(row_id)).alias("source_rows"),
        *(F.min_by(c, row_id).alias(c) for c in others),
    )
    report = grouped.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows"),
        F.count("*").alias("unique_keys"),
        F.coalesce(F.sum(F.when(F.col("n_versions") == 1, F.col("n_rows") - 1)), F.lit(0)).alias("exact_duplicates"),
        F.count_if(F.col("n_versions") > 1).alias("conflicting_keys"),
    )
    return grouped.where("n_versions = 1").drop("n_rows", "n_versions"), report


def structured(df: DataFrame, name: str, producer: str, category: str, grape: str, slug: str, fold: T.Fold = T.exact_fold) -> DataFrame:
    """name_key, producer_key, colour, year, grape_key, category_key, sweetness; '' where a field is absent."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    category_name = F.trim(blank(F.col(category)))
    colours = F.create_map(*(F.lit(x) for pair in CATEGORY_COLOURS.items() for x in pair))
    return df.withColumns({
        "name_key": T.canonical(blank(F.col(name)), fold),
        "producer_key": T.canonical(blank(F.col(producer)), fold),
        "colour": blank(F.try_element_at(colours, F.lower(category_name))),
        "year": blank(T.year(T.canonical(blank(F.col(name)), fold))),
        "grape_key": T.canonical(blank(F.col(grape)), fold),
        "category_key": category_name,
        "sweetness": blank(T.sweetness_code(T.canonical(F.concat_ws(" ", blank(F.col(slug)), blank(F.col(name))), fold))),
    })


def field_text(*columns: str) -> Column:
    """The columns that are not empty, one space between."""
    return F.concat_ws(" ", *(F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns))


def template(name: Column, producer: Column, tail: list[Column], lead: str, producer_lead: str) -> Column:
    """lead «name»[, producer_lead producer][, tail...]; empty tails are left out, an empty name is an error."""
    kept = [F.when(F.coalesce(t, F.lit("")) != "", F.concat(F.lit(", "), t)).otherwise(F.lit("")) for t in tail]
    clause = F.when(F.coalesce(producer, F.lit("")) != "", F.concat(F.lit(f", {producer_lead} "), producer)).otherwise(F.lit(""))
    body = F.concat(F.lit(f"{lead} «"), name, F.lit("»"), clause, *kept)
    return F.when(F.coalesce(name, F.lit("")) != "", body).otherwise(F.raise_error(F.lit("a template needs a name")).cast("string"))


def equivalence_groups(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Groups of two or more members that share the keys: keys, n_members, members."""
    return df.groupBy(*keys).agg(F.count_distinct(member).alias("n_members"), F.array_sort(F.collect_set(member)).alias("members")).where("n_members > 1")


def group_statistics(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """groups, affected members, their share of all rows, and the largest group."""
    affected = F.coalesce(F.sum("n_members"), F.lit(0))
    found = groups.agg(F.count("*").alias("n_groups"), affected.alias("affected"), F.coalesce(F.max("n_members"), F.lit(0)).alias("largest"))
    total = F.broadcast(rows.agg(F.count("*").alias("total")))  # one row beside one row
    return found.crossJoin(total).select("n_groups", "affected", F.try_divide(F.col("affected").cast("double"), F.col("total")).alias("fraction"), "largest")


def families(df: DataFrame, producer: Column, tokens: Column) -> DataFrame:
    """df with family (producer and ordered name tokens) and family_size."""
    keyed = df.withColumn("family", F.concat_ws("\u001f", producer, F.array_join(tokens, " ")))
    sizes = keyed.groupBy("family").agg(F.count("*").alias("family_size"))
    return keyed.join(sizes, "family")


def shared_keys(df: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys that more than one owner has: key, n_owners."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(owner).alias("n_owners")).where("n_owners > 1")


def aliases(lines: DataFrame, fold: T.Fold = T.exact_fold, positions: bool = False) -> DataFrame:
    """variant, canonical: of lines (line_no, value) "name, variant, variant..."; blank lines, # comments and single fields
    are skipped, and a later line wins a variant. positions: where the variant stands first, for alias_in_text()."""
    parts = F.filter(F.transform(F.split("value", ","), F.trim), lambda p: p != "")
    good = lines.where(~F.trim("value").startswith("#")).withColumn("parts", parts).where(F.size("parts") >= 2)
    each = good.select("line_no", F.get("parts", F.lit(0)).alias("c"), F.posexplode("parts").alias("pos", "v"))
    keyed = each.select("line_no", "pos", T.canonical(F.col("v"), fold).alias("variant"), T.canonical(F.col("c"), fold).alias("canonical"))
    out = keyed.groupBy("variant").agg(F.max_by("canonical", F.struct("line_no", "pos")).alias("canonical"), F.min(F.struct("line_no", "pos")).alias("position"))
    return out if positions else out.drop("position")


def resolve_aliases(df: DataFrame, key: str, alias_table: DataFrame) -> DataFrame:
    """df with canonical: the alias table's name of key, else key itself."""
    return df.join(alias_table.withColumnRenamed("variant", key), key, "left").withColumn("canonical", F.coalesce("canonical", key))


def media_cards(items: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """items with url: the link's cdn, else its upload, else null. The last link of a key (by line_no) counts."""
    last = links.groupBy(key).agg(F.max_by(F.struct("cdn_url", "upload_url"), "line_no").alias("link"))
    url = F.coalesce(F.nullif("link.cdn_url", F.lit("")), F.nullif("link.upload_url", F.lit("")))
    return items.join(last, key, "left").withColumn("url", url).drop("link")
