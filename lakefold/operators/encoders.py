"""Encoders of list columns, fitted on some rows and applied to all: shares of a blend, and presence.

The fitted vocabulary is a table of members and their part of the fit rows' mass; lists meet it in a join. An encoded row has
a number for each member of the vocabulary, in the order of the members, so the vocabulary is what bounds a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakefold.functions import arrays as A
from lakefold.operators.policy import parsed_list
from lakefold.session import group_count

_PAIR = r"""(?:'([^']*)'|"([^"]*)")\s*[:,]\s*([-+]?(?:[0-9][0-9.]*(?:[eE][-+]?[0-9]+)?|nan|inf))"""
_MEMBERS = "array<struct<member:string,share:double>>"


def blend(text: Column) -> Column:
    """Members and shares, which sum to one, of a written blend: {'a': 2, 'b': 1}, [('a', 2), ('b', 1)], or a list of
    members in equal parts, each once. Of a repeated member the last share counts. A null or empty text, and shares that
    are all zero, give an empty array; a negative or infinite share is an error."""
    none = F.array().cast(_MEMBERS)
    member = lambda name, share: F.struct(name.alias("member"), share.cast("double").alias("share"))
    part = lambda k: F.regexp_extract_all(text, F.lit(_PAIR), F.lit(k))
    pairs = F.zip_with(F.zip_with(part(1), part(2), lambda a, b: F.concat(a, b)), part(3), member)
    last = F.aggregate(pairs, none, lambda kept, p: F.concat(F.filter(kept, lambda m: m["member"] != p["member"]), F.array(p)))
    plain = F.transform(F.array_distinct(parsed_list(text)), lambda m: member(m, F.lit(1.0)))
    members = F.coalesce(F.when(text.rlike(r"^\s*(\{|\[\s*\()"), last).otherwise(plain), none)
    # each step is computed once: as plain columns the text would be read again for every member
    return A.let(members, lambda m: A.let(F.aggregate(m, F.lit(0.0), lambda s, x: s + x["share"]), lambda total: (
        F.when(F.exists(m, lambda x: (x["share"] < 0) | F.isnan(x["share"]) | (x["share"] == float("inf"))), F.raise_error(F.lit("shares have to be finite and not negative")).cast(_MEMBERS))
        .when(total > 0, F.transform(m, lambda x: member(x["member"], x["share"] / total))).otherwise(none)
    )))


def fit_members(fit: DataFrame, members: str) -> DataFrame:
    """member, marginal: the vocabulary of the fit rows (arrays of member and share) and its parts of their mass; equal
    parts where all mass is zero."""
    mass = fit.select(F.explode(members).alias("m")).groupBy("m.member").agg(F.sum("m.share").alias("mass"))
    total = mass.agg(F.sum("mass").alias("total"), F.count("*").alias("n"))  # one row
    return mass.crossJoin(F.broadcast(total)).select("member", F.when(F.col("total") > 0, F.col("mass") / F.col("total")).otherwise(1 / F.col("n")).alias("marginal"))


def _encoded(df: DataFrame, members: str, vocabulary: DataFrame, value) -> DataFrame:
    """df with vector: value(entry of the vocabulary, the row's shares of known members, its unknown share) for each entry. A
    row has its own members, so it meets the vocabulary, one row, where it is: dealt to a stated number of tasks, since rows
    cost far more than their bytes say."""
    order = vocabulary.agg(F.array_sort(F.collect_list(F.struct("member", "marginal"))).alias("_all"))  # one row
    out = df.repartition(group_count(df)).crossJoin(F.broadcast(order))
    own = F.coalesce(F.col(members), F.array().cast(_MEMBERS))
    inside = lambda names, m: F.array_contains(names, m["member"])
    vector = A.let(F.transform("_all", lambda v: v["member"]), lambda names: A.let(
        F.struct(F.map_from_entries(F.filter(own, lambda m: inside(names, m))).alias("known"), F.aggregate(F.filter(own, lambda m: ~inside(names, m)), F.lit(0.0), lambda s, m: s + m["share"]).alias("unknown")),
        lambda met: F.transform("_all", lambda v: value(v, met["known"], met["unknown"])),
    ))
    return out.withColumn("vector", vector).drop("_all")


def share_vectors(df: DataFrame, row_id: str, members: str, vocabulary: DataFrame) -> DataFrame:
    """df with vector: each member's share; the mass of members outside the vocabulary, or all mass of an empty row, is
    spread by the vocabulary's marginals."""
    empty = F.coalesce(F.size(members), F.lit(0)) <= 0
    share = lambda known, v: F.coalesce(F.try_element_at(known, v["member"]), F.lit(0.0))
    return _encoded(df, members, vocabulary, lambda v, known, unknown: share(known, v) + F.when(empty, 1.0).otherwise(unknown) * v["marginal"])


def presence_vectors(df: DataFrame, row_id: str, members: str, vocabulary: DataFrame) -> DataFrame:
    """df with vector, of unit length: one for each member that the row has; the marginals for a row without a known one."""
    there = lambda known, v: F.try_element_at(known, v["member"]).isNotNull().cast("double")
    out = _encoded(df, members, vocabulary, lambda v, known, _: F.when(F.size(known) <= 0, v["marginal"]).otherwise(there(known, v)))
    return out.withColumn("vector", A.unit(F.col("vector")))
