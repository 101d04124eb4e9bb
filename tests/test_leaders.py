"""Leader clustering by rounds against the sequential rule."""

import random
from difflib import SequenceMatcher

import pytest

from lakefold.operators import leaders


def sequential(rows, least, least_cosine):
    """rows: (id, name, year, vector); the first leader that a record is like, in order of ids."""
    heads, out = [], {}
    for i, name, year, vector in sorted(rows, key=lambda r: r[0]):
        name = name or ""
        for j, other, when, head in heads:
            alike = name == other or (name and other and SequenceMatcher(None, name.casefold(), other.casefold()).ratio() >= least)
            length = lambda v: sum(x * x for x in v) ** 0.5 if v else 0
            close = length(vector) and length(head) and sum(a * b for a, b in zip(vector, head)) / length(vector) / length(head) >= least_cosine
            if year == when and (alike or close):
                out[i] = j
                break
        else:
            heads.append((i, name, year, vector))
            out[i] = i
    return out


def clustered(spark, rows, least=0.8, least_cosine=0.9, vector="v"):
    df = spark.createDataFrame(rows, "id bigint, name string, year int, v array<double>")
    return {r.id: r.cluster for r in leaders.cluster(df, "id", "name", "year", least, vector, least_cosine).collect()}


@pytest.mark.parametrize("seed", [1])
def test_same_as_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    words = ["red ring", "red rings", "red wing", "Red Ring!", "blue bolt", "blue bolts", "", None, "x"]
    rows = [(i, rng.choice(words) if rng.random() < 0.5 else f"{rng.choice('abc')}{rng.randint(0, 99)} name", rng.choice([1, 2, None]), rng.choice([None, [0.0, 0.0, 0.0], [rng.randint(-2, 2) + 0.1, rng.randint(-2, 2) / 2, 1.0]])) for i in range(160)]
    rng.shuffle(rows)
    got = clustered(spark, rows)
    assert got == sequential(rows, 0.8, 0.9)
    assert len(set(got.values())) < len(got)
    assert clustered(spark, rows, vector=None) == sequential([(*r[:3], None) for r in rows], 0.8, 2)


def test_a_chain_settles_by_rounds(spark):
    """Each vector is like its neighbours alone: every second one leads, and that is known from the first on only."""
    from math import cos, sin

    rows = [(i, f"{i} {chr(97 + i)}{chr(122 - i)}", 1, [cos(i / 4), sin(i / 4)]) for i in range(7)]
    assert clustered(spark, rows, 0.99, cos(0.3)) == {i: i - i % 2 for i in range(7)}


def test_blocks_and_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(leaders.close_vectors, "__defaults__", (7,))
    rng = random.Random(3)
    rows = [(i, "same" if i % 3 else f"n{i}{i}", 1, [1.0, 0.0] if i % 2 else [rng.random(), rng.random()]) for i in range(120)]
    assert clustered(spark, rows, 0.95, 0.999) == sequential(rows, 0.95, 0.999)
    assert clustered(spark, []) == {}
