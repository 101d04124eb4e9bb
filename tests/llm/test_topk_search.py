"""Exact top-k search against sorted inner products of all rows."""

import math
import random

import pytest

from lakefold.llm import topk_search


def plain(rows, k=10):
    """rows: (vec_id, vector). A query's own row is the one that agrees in id and vector."""
    good = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, v in good:
        if i % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if (j, w) != (i, v))[:k]
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scores)]
    return sorted(out)


def found(spark, rows, k=10):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, score string")
    vectors = topk_search.whole_vectors(df)
    out = topk_search.top_k(vectors, vectors.where("vec_id % 100 = 0"), k).select("query_id", "rank", "vec_id", "score")
    return sorted(map(tuple, out.collect()))


def vectors(n, width, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.randint(-64, 64) / 64 * (spread if d % 2 else 1.0) for d in range(width)]) for i in range(n)]


@pytest.mark.parametrize(("rows", "k"), [
    (vectors(900, 6, 1), 10),
    (vectors(700, 7, 2, 0.01), 3),  # one list hardly counts
    ([(i, [1.0, 0.5, -1.0]) for i in range(500)] + vectors(300, 3, 3), 10),  # a vector that most rows share, queries too
    ([(i, [0.0, 0.0]) for i in range(150)], 10),  # every score is a tie
    (vectors(7, 4, 4), 10),  # fewer rows than k
    ([(i, [1.0, -1.0, 0.25][: i % 4]) for i in range(250)], 4),  # lengths differ
])
def test_same_as_all_inner_products(spark, rows, k):
    assert found(spark, rows, k) == plain(rows, k)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk_search, "SLICE_ROWS", 20)
    rows = vectors(600, 5, 6)
    assert found(spark, rows) == plain(rows)


def test_phases_send_few_entries(spark, monkeypatch):
    """Of 40,000 scores in each of two lists the cutoffs let a small part through, and fewer still are resolved."""
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(16)]) for i in range(4000)]
    sizes = {}
    real = topk_search.written
    monkeypatch.setattr(topk_search, "written", lambda df, name: sizes.setdefault(name, real(df, name)))
    assert found(spark, rows) == plain([(i, [float(x) for x in __import__("numpy").float32(v)]) for i, v in rows])
    assert sizes["topk-sums"].count() < 40 * 4000 * 0.2
    assert sizes["topk-cutoffs"].count() == 40


def test_rows_that_take_no_part(spark):
    rows = [(None, [1.0]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 0.0]), (4, [None, 1.0]), (5, []), (100, [1.0, 2.0]), (100, [1.0, 2.0]), (100, [2.0]), (200, []), (7, [3.0, 0.5]), (7, [3.0, 0.5])]
    assert found(spark, rows) == plain(rows)
    assert {r[0] for r in found(spark, rows)} == {100, 200}
    assert found(spark, rows[:3]) == [] and found(spark, [(None, None)]) == []
    with pytest.raises(Exception, match="too large"):
        found(spark, [(0, [1e30]), (1, [1.0])])
