"""What a client shows: ranked cards, similar and alternative items, reasons, filters, pairings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confidence(score: Column) -> Column:
    """A percentage score as a share with four places, halves up."""
    return F.floor(score * 100 + 0.5) / 10000


def top_with_margin(ranked: DataFrame, query_id: str) -> DataFrame:
    """query_id, slug, confidence, margin (of the two best scores; of a single candidate its score)."""
    w = Window.partitionBy(query_id).orderBy("rank")
    nxt = ranked.withColumn("second", F.lead("score").over(w)).where("rank = 1")
    return nxt.select(query_id, "slug", confidence(F.col("score")).alias("confidence"), confidence(F.col("score") - F.coalesce("second", F.lit(0.0))).alias("margin"))


def similar_and_alternatives(ranked: DataFrame, query_id: str, similar: int = 5, alternatives: int = 6) -> DataFrame:
    """query_id, slug, part, place. ranked: query_id, slug, producer, rank. Similar: others of the first item's producer,
    or, where there are none, of all; alternatives: those not used, of another producer."""
    top = ranked.where("rank = 1").select(query_id, F.col("slug").alias("top_slug"), F.col("producer").alias("top_producer"))
    rest = ranked.join(top, query_id).where("slug <> top_slug")
    q = Window.partitionBy(query_id)
    rest = rest.withColumn("same", F.col("producer").eqNullSafe(F.col("top_producer"))).withColumn("any_same", F.max("same").over(q))
    rest = rest.withColumn("eligible", F.when(F.col("any_same"), F.col("same")).otherwise(F.lit(True)))
    rest = rest.withColumn("place", F.row_number().over(Window.partitionBy(query_id, "eligible").orderBy("rank")))
    chosen = rest.withColumn("is_similar", F.col("eligible") & (F.col("place") <= similar))
    other = chosen.where(~F.col("is_similar") & ~F.col("same")).withColumn("place", F.row_number().over(q.orderBy("rank"))).where(F.col("place") <= alternatives)
    return chosen.where("is_similar").select(query_id, "slug", F.lit("similar").alias("part"), "place").unionByName(other.select(query_id, "slug", F.lit("alternative").alias("part"), "place"))


def reasons(same_producer: Column, same_grape: Column, same_category: Column) -> Column:
    """same_manufacturer or other_manufacturer, then same_grape and same_category where they hold."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    parts = F.array(F.when(yes(same_producer), "same_manufacturer").otherwise("other_manufacturer"), F.when(yes(same_grape), "same_grape"), F.when(yes(same_category), "same_category"))
    return F.array_compact(parts)


def matches_filters(filters: Column, producer: Column, category: Column, region: Column, why: Column) -> Column:
    """All filters (array<struct<kind, value>>) hold: manufacturer is equal or among the reasons, category and region are
    contained or among the reasons, grape is among the reasons, year always holds."""
    has = lambda code: F.array_contains(why, code)
    inside = lambda c, v: F.coalesce(F.contains(F.lower(c), F.lower(v)), F.lit(False))

    def holds(f: Column) -> Column:
        kind, value = f["kind"], f["value"]
        return (
            F.when(kind == "manufacturer", F.coalesce(F.lower(producer) == F.lower(value), F.lit(False)) | has("same_manufacturer"))
            .when(kind == "category", inside(category, value) | has("same_category")).when(kind == "region", inside(region, value) | has("same_region"))
            .when(kind == "grape", has("same_grape")).otherwise(kind == "year")
        )

    return F.forall(filters, holds)


def screen(status: Column, slug: Column, n_candidates: Column) -> Column:
    return (
        F.when(status == "not_found", "similar").when((status == "exact") & slug.isNull(), "contract_violation").when(status == "exact", "item")
        .when((status == "uncertain") & (n_candidates > 0), "offer").otherwise("retry")
    )


def category_line(category: Column, sweetness: Column) -> Column:
    """The category, and the sweetness unless it is already in it."""
    add = sweetness.isNotNull() & (sweetness != "") & ~F.contains(F.lower(category), F.lower(sweetness))
    return F.when(F.coalesce(add, F.lit(False)), F.concat_ws(" ", category, sweetness)).otherwise(category)


def grape_line(grapes: Column) -> Column:
    """Up to three grapes; of more the first two and how many others."""
    return F.when(F.size(grapes) > 3, F.concat(F.array_join(F.slice(grapes, 1, 2), ", "), F.lit(" +"), (F.size(grapes) - 2).cast("string"))).otherwise(F.array_join(grapes, ", "))


def page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    if not (1 <= limit <= 200 and offset >= 0):
        raise ValueError("limit is 1 to 200, offset 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit)


def pairing(items: DataFrame, wanted_colours: list[str], wanted_sweetness: list[str], grapes: list[str], most_strength: float, k: int = 3) -> DataFrame:
    """The k best items for a dish: colour and sweetness must fit, strength must not exceed the limit; ordered by how
    many wanted grapes an item has (at most two count), then slug. items: slug, colour, sweetness, grapes array, strength."""
    fit = items.where(F.col("colour").isin(*wanted_colours) & F.col("sweetness").isin(*wanted_sweetness) & (F.coalesce("strength", F.lit(0.0)) <= most_strength))
    points = F.least(F.lit(2), F.size(F.array_intersect("grapes", F.array(*map(F.lit, grapes))))) if grapes else F.lit(0)
    return fit.withColumn("points", points).orderBy(F.desc("points"), "slug").limit(k)
