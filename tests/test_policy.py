import numpy as np
import pytest
from pyspark.sql import functions as F

from lakefold.operators import policy


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, want", [("['a', \"b\"]", ["a", "b"]), ("(x,)", ["x"]), ("a, b ,c", ["a", "b", "c"]), ("", []), (None, None)])
def test_parsed_list(spark, text, want):
    assert one(spark, policy.parsed_list(F.lit(text).cast("string"))) == want


def test_status_order(spark):
    status = lambda *a: one(spark, policy.pipeline_status(*map(F.lit, a)))
    assert status(False, True, True, 1, "accepted") == "no_object"
    assert status(True, True, True, 1, "accepted") == "deadline"
    assert status(True, False, True, 0, "accepted") == "unknown"
    assert status(True, False, False, 2, "accepted") == "ambiguous"
    assert status(True, False, True, 2, "accepted") == "accepted"


def test_image_files(spark):
    error = lambda m, n, s: one(spark, policy.image_file_error(F.lit(m).cast("string"), F.lit(n), F.lit(s)))
    assert [error("image/png", "a.png", 1), error(None, "a.HEIC", 1), error("", "a.txt", 1), error("image/png", "a", 0), error("image/png", "a", 13 << 20)] == [None, None, "type", "empty", "size"]


def test_alias_ties(spark):
    texts = spark.createDataFrame([(1, "alpha beta"), (2, "alphabet"), (3, "none")], "id int, t string")
    table = spark.createDataFrame([("alpha", "A"), ("betas", "B"), ("beta", "B"), ("alp", "X")], "variant string, canonical string")
    assert [tuple(r) for r in policy.alias_in_text(texts, table, "id", "t", True).collect()] == [(1, "A")]
    assert sorted(tuple(r) for r in policy.alias_in_text(texts, table, "id", "t", False).collect()) == [(1, "A"), (2, "A")]
    tied = spark.createDataFrame([("alpha", "A"), ("gamma", "B")], "variant string, canonical string")
    both = spark.createDataFrame([(1, "alpha gamma")], "id int, t string")
    assert policy.alias_in_text(both, tied, "id", "t", True).first().canonical is None


def plans(df):
    """Nodes of the physical plan, the operators of its joins among them."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [8 << 20, 0])
def test_aliases_go_to_the_texts(spark, tmp_path, monkeypatch, few):
    """A small file of many like texts is not broadcast, whatever its size says; long and short aliases are found at any
    place, of equal ones the first in the list."""
    monkeypatch.setattr(policy, "FEW_BYTES", few)
    made = spark.range(500).select(F.col("id"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("ab\u00e9cd\U0001f377xyz"), (F.col("id") % 3).cast("string"))).alias("t"))
    made.write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    listed = [("c", "one", 1), ("d\U0001f377xy", "long", 9), ("\u00e9cd\U0001f377", "late", 3), ("z", "last", 4), ("xyz1", "tie", 2), ("z2", "two", 5), ("", "none", 0), ("cd\U0001f377xyz2", "longest", 8), ("cd\U0001f377xyz2", "later", 9), ("nowhere", "x", 0)]
    aliases = spark.createDataFrame(listed, "variant string, canonical string, position int")
    got = policy.alias_in_text(texts, aliases, "id", "t", False)
    assert "BroadcastHashJoin [w" not in (plan := plans(got)) or few and "BuildRight" in plan and "BuildLeft" not in plan
    assert ("BroadcastExchange" in plan) == bool(few)
    want = {}
    for r in texts.where("t IS NOT NULL").collect():
        hits = [(-len(v), p, v, c) for v, c, p in listed if v and v in r.t]
        if hits:
            want[r.id] = min(hits)[3]
    assert {r.id: r.canonical for r in got.collect()} == want and set(want.values()) == {"late", "tie", "longest"}
    words = policy.alias_in_text(texts, aliases, "id", "t", True)
    assert "BuildLeft" not in plans(words)


def test_no_aliases(spark):
    texts = spark.createDataFrame([(1, "alpha"), (2, ""), (3, None)], "id int, t string")
    for whole in (True, False):
        assert policy.alias_in_text(texts, spark.createDataFrame([], "variant string, canonical string"), "id", "t", whole).collect() == []
    same = spark.createDataFrame([(1, "a red one"), (1, "an old ring"), (None, "ring")], "id int, t string")
    table = spark.createDataFrame([("red", "A"), ("ring", "B")], "variant string, canonical string")
    assert sorted(((r.id or 0, r.canonical) for r in policy.alias_in_text(same, table, "id", "t", False).collect())) == [(0, "B"), (1, "B")]


def test_ordinal_codes(spark):
    df = spark.createDataFrame([(3.0,), (5.0,), (9.0,), (None,)], "v double")
    got = [r.code for r in policy.ordinal_code(df, df.where("v < 6"), "v").orderBy("v").collect()]
    assert got == [-1, 0, 2, -1]
    with pytest.raises(Exception, match="whole"):
        policy.ordinal_code(spark.createDataFrame([(3.5,)], "v double"), df, "v").collect()


def test_blocks_and_diagnostics(spark):
    v = F.array(F.lit(1.0), F.lit(0.0))
    assert np.allclose(one(spark, policy.block_features([v, v, v, v])), [0.5, 0] * 4)
    d = policy.similarity_diagnostics(np.eye(4))
    assert d["p50"] == 0 and d["effective_rank"] == pytest.approx(4) and d["coverage90"] == 4


def test_paired_interval(spark):
    df = spark.createDataFrame([(u, 0.0, 0.1) for u in range(400)], "u int, a double, b double")
    r = policy.paired_interval(df, "u", "a", "b").first()
    assert (r.n, r.passed) == (400, True) and r.low == pytest.approx(0.1)


def test_paired_interval_has_the_width_of_the_mean(spark):
    import random

    rng = random.Random(5)
    gains = [rng.gauss(0.3, 1.0) for _ in range(900)]
    df = spark.createDataFrame([(u, 0.0, g) for u, g in enumerate(gains)], "u int, a double, b double")
    r, again = policy.paired_interval(df, "u", "a", "b").first(), policy.paired_interval(df.repartition(7), "u", "a", "b").first()
    error = np.std(gains) / len(gains) ** 0.5
    assert r.gain == pytest.approx(np.mean(gains)) and [r.low, r.high] == pytest.approx([r.gain - 1.96 * error, r.gain + 1.96 * error], abs=0.3 * error)
    assert [r.low, r.high] == pytest.approx([again.low, again.high])
    assert policy.paired_interval(df.limit(0), "u", "a", "b").collect() == []
