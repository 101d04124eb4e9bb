"""Blends and their encoders by hand."""

import pytest
from pyspark.sql import functions as F

from lakefold.operators import encoders


def read(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    return [{m.member: round(m.share, 6) for m in r.b} for r in df.select("id", encoders.blend(F.col("t")).alias("b")).orderBy("id").collect()]


def test_three_ways_to_write_a_blend(spark):
    got = read(spark, "{'a': 2, 'b': 1.0, \"c\": 1e0}", "[('a', 3), ('b', 1), ('a', 1)]", "['a', 'b', 'a']", "a, b , c,", None, "", "{'a': 0, 'b': 0.0}", "[]", "{}", "['a: 1']")
    assert got == [{"a": 0.5, "b": 0.25, "c": 0.25}, {"b": 0.5, "a": 0.5}, {"a": 0.5, "b": 0.5}, {"a": 0.333333, "b": 0.333333, "c": 0.333333}, {}, {}, {}, {}, {}, {"a: 1": 1.0}]
    for wrong in ("{'a': -1, 'b': 2}", "{'a': inf}", "[('a', nan)]"):
        with pytest.raises(Exception, match="finite and not negative"):
            read(spark, wrong)


def test_unknown_mass_is_spread(spark):
    df = spark.createDataFrame([(1, "{'a': 3, 'b': 1}"), (2, "['a']"), (3, "{'a': 1, 'z': 3}"), (4, None), (5, "['y', 'z']")], "id int, t string").withColumn("members", encoders.blend(F.col("t"))).withColumn("marginal", F.lit("kept"))
    vocabulary = encoders.fit_members(df.where("id <= 2"), "members")
    assert sorted(map(tuple, vocabulary.collect())) == [("a", 0.875), ("b", 0.125)]
    got = {r.id: r.vector for r in encoders.share_vectors(df, "id", "members", vocabulary).collect()}
    assert got == {1: [0.75, 0.25], 2: [1.0, 0.0], 3: [0.25 + 0.75 * 0.875, 0.75 * 0.125], 4: [0.875, 0.125], 5: [0.875, 0.125]}
    there = {r.id: [round(x, 6) for x in r.vector] for r in encoders.presence_vectors(df, "id", "members", vocabulary).collect()}
    assert there[1] == [0.707107, 0.707107] and there[3] == [1, 0] and there[4] == there[5] == [0.989949, 0.141421]
    assert encoders.share_vectors(df.limit(0), "id", "members", vocabulary).collect() == []
    assert encoders.share_vectors(df, "id", "members", vocabulary.limit(0)).select("vector").distinct().collect()[0].vector == []
