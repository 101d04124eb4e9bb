import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lakefold.llm import near_dedup as N
from lakefold.llm import textkit
from lakefold.llm.components import components


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(texts):
    """Classes by all pairs."""
    parent = {i: i for i, _ in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = list(texts)
    for a in range(len(items)):
        for b in range(a):
            x, y = bag(items[a][1]), bag(items[b][1])
            if (not x and not y) or (x and y and jaccard(x, y) >= 0.8 - 1e-12):
                i, j = sorted((find(items[a][0]), find(items[b][0])))
                parent[j] = i
    return {i: find(i) for i, _ in items}


def corpus():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    base = [rng.choice(words) for _ in range(150)]
    out = []
    for i in range(70):  # one large group of near copies, of which some are too far from most
        t = list(base)
        for k in rng.sample(range(150), rng.randint(0, 5)):
            t[k] = f"e{i}_{k}"
        out.append(" ".join(t))
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    out += ["a b", "a b", "a  b", "", None, " \n", "x " * 400, "x " * 390, "one two three four five"]
    return list(enumerate(out))


def test_classes_are_those_of_all_pairs(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "s") for i, t in texts], "doc_id bigint, text string, class_id string")
    got = {r.doc_id: r.class_id for r in N.near_classes(df).collect()}
    assert got == brute(texts)


def test_blocks_give_the_same(spark, monkeypatch):
    texts = corpus()
    monkeypatch.setattr(N, "BLOCK_TEXTS", 20)
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert {r.doc_id: r.class_id for r in N.near_classes(df).collect()} == brute(texts)


def test_null_ids_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (7, "a b c")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in N.near_classes(df).collect()) == [(0, 0), (3, 3), (3, 3), (7, 3)]
    assert N.near_classes(df.limit(0)).collect() == []


def test_signatures_are_unbiased():
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 400)}" for _ in range(300)]
    edited = list(base)
    for j in rng.sample(range(300), 12):
        edited[j] = "z"
    texts = [" ".join(base), " ".join(edited), "a b c d e " * 40, "a b c d e " * 30 + "q r s t " * 5]
    words = textkit.words_of(pa.array(texts))
    s = N.signatures(len(texts), *N.bag(words), 20_000)
    for a, b in ((0, 1), (2, 3)):
        assert (s[a] == s[b]).mean() == pytest.approx(jaccard(bag(texts[a]), bag(texts[b])), abs=0.015)
    assert np.isfinite(s).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: v for k, v in want.items() if near[k] - {k}}


def test_components_of_a_long_shuffled_path(spark):
    ids = list(range(1000))
    random.Random(3).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a bigint, b bigint")
    got = components(edges).collect()
    assert len(got) == 1000 and {r.label for r in got} == {0}
    with pytest.raises(RuntimeError):
        components(edges, limit=2)
