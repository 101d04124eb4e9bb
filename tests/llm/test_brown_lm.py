import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakefold.llm import brown_lm as B

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def held():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2



def rows(spark, texts):
    return spark.createDataFrame(texts, "doc_id bigint, text string, n_tokens int")


def test_base_and_counts(spark):
    texts = [(i, " ".join(f"W{(i * k) % 23} the" for k in range(1, 9)), 5) for i in range(60)] + [(60, None, 1), (61, "", 1), (62, " \t", 1), (5, "repeated id", 1), (None, "no id", 1), (63, "x" * 300_000, 1)]
    got = B.score_texts(rows(spark, texts), held()).collect()
    assert len(got) == len(texts)
    held_out = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _, _ in texts}
    tokens = [(i, [*WORD.findall((t or "").encode().lower()), None]) for i, t, _ in texts]
    c = Counter(w for i, ws in tokens if not held_out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((i or -1, held_out[i], len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) for r in got)


def test_rare_words_take_the_other_way(spark, monkeypatch):
    texts = [(i, f"a b w{i} w{i % 7}", 1) for i in range(40)]
    a = {r.doc_id: (r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in B.score_texts(rows(spark, texts), held()).collect()}
    monkeypatch.setattr(B, "FLUSH", 9)
    whole = B.vocabulary
    monkeypatch.setattr(B, "vocabulary", lambda counts, n: whole(counts, n, local=4))
    b = {r.doc_id: (r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in B.score_texts(rows(spark, texts), held()).collect()}
    assert {i: x[:2] for i, x in a.items()} == {i: x[:2] for i, x in b.items()}


def test_probabilities_sum_to_one(spark):
    docs = rows(spark, [(i, f"a b c{i % 5} d{i % 3} e", 1) for i in range(50)])
    counts = B.word_counts(docs, 4).persist()
    known = B.vocabulary(counts, docs.count())
    model = B.fit(docs, known, 3)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    of = model.words
    for c in range(B.CLASSES):
        mass = (known.counts[of == c] + B.ADD).sum() + B.ADD
        assert np.isclose(mass, 10 ** model.share[c])


@pytest.mark.parametrize("local", [1 << 18, 4])
def test_scores_from_the_classes(spark, monkeypatch, local):
    """All but the classes themselves, again in plain Python; with most words rare too."""
    whole, kept = B.vocabulary, []
    monkeypatch.setattr(B, "vocabulary", lambda counts, n: whole(counts, n, local=local, top=min(6, local)))
    real = B.fit
    monkeypatch.setattr(B, "fit", lambda *a: kept.append(real(*a)) or kept[-1])
    texts = [(i, " ".join(f"w{(i * k) % 11}" + "ab"[k % 2] for k in range(1, 4 + i % 9)), 1) for i in range(80)] + [(80, None, 1), (81, "new words only", 1)]
    got = {r.doc_id: r.score for r in B.score_texts(rows(spark, texts).repartition(3), held()).collect()}
    model = kept[0]
    training = [i for i, _, _ in texts if zlib.crc32(str(i).encode()) % 7 != 2]

    def read(text):
        words, keys = B.tokens(pa.array([text or ""]))
        return keys.tolist(), model.classes(keys, *model.known.find(keys)).tolist()

    c, of, steps, k = Counter(), {}, Counter(), B.CLASSES
    for i in training:
        keys, classes = read(texts[i][1])
        c.update(keys)
        of.update(zip(keys, classes, strict=True))
        steps.update(zip([k, *classes], [*classes, k], strict=True))
    into, out = Counter(), Counter()
    for (a, b), n in steps.items():
        into[b] += n
        out[a] += n
    share = {b: (into[b] + 1) / (sum(into.values()) + k + 1) for b in range(k + 1)}
    mass = {b: sum(n for w, n in c.items() if of[w] == b) + B.ADD * (sum(of[w] == b for w in c) + 1) for b in range(k)}
    for i, text, _ in texts:
        keys, classes = read(text)
        want = sum(math.log10((steps[a, b] + B.TRANSITION * share[b]) / (out[a] + B.TRANSITION)) for a, b in zip([k, *classes], [*classes, k], strict=True))
        want += sum(math.log10((c[w] + B.ADD) / mass[b]) for w, b in zip(keys, classes, strict=True))
        assert math.isclose(got[i], want, rel_tol=1e-9)


def test_words_beyond_the_exchanged_ones_have_classes(spark):
    """Words in the contexts of one planted class share a class, though their last bytes differ."""
    texts = [(i, f"left noun{i % 9}{'xyz'[i % 3]} right verb{i % 7}{'pq'[i % 2]}", 1) for i in range(600)]
    docs = rows(spark, texts)
    known = B.vocabulary(B.word_counts(docs, 3), 600, top=4)
    model = B.fit(docs, known, 3)
    classes = lambda names: set(model.words[known.find(B.tokens(pa.array([" ".join(names)]))[1])[0]].tolist())
    nouns, verbs = classes({t.split()[1] for _, t, _ in texts}), classes({t.split()[3] for _, t, _ in texts})
    assert len(nouns) < 9 and len(verbs) < 9 and not nouns & verbs


def objective(m, of):
    k = of.max() + 1
    member = np.eye(k)[of]
    table = member.T @ m @ member
    x = lambda t: (t * np.log(np.maximum(t, 1))).sum()
    return x(table) - x(table.sum(axis=0)) - x(table.sum(axis=1))


def test_exchange_comes_near_the_planted_classes():
    rng = np.random.default_rng(3)
    planted = rng.integers(0, 4, B.ITEMS)
    planted[B.END] = 4
    follows = rng.random((5, 5)) ** 4
    m = np.zeros((B.ITEMS, B.ITEMS))
    m[:60, :60] = rng.poisson(40 * follows[planted[:60]][:, planted[:60]])
    of = B.exchange(m, classes=4, rounds=20)
    begin = np.arange(B.ITEMS) % 4
    begin[B.END] = 4
    low, high = objective(m, begin), objective(m, planted)
    assert objective(m, of) >= low + 0.8 * (high - low) and of[B.END] == 4


def test_empty_table(spark):
    assert B.score_texts(rows(spark, []), held()).collect() == []


def test_tokens_are_ascii_lowered():
    words, keys = B.tokens(pa.array(["Ab ab ÀB àb", None]))
    assert keys[0] == keys[1] and keys[2] != keys[3] and list(words.counts) == [4, 0]
