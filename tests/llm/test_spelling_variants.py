"""Spelling variants against plain wildcard patterns over the counted words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lakefold.llm import registry, spelling_variants

SF_DIR = "/root/testdata/sf0.01"


def plain_counts(docs, least=5):
    counts = Counter()
    for doc_id, text in docs:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if doc_id is not None and h % 199 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}


def plain_variants(n):
    """Words meet in patterns with one letter left open, or one letter put in."""
    whole, shorter = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            whole[w[:k] + "*" + w[k + 1 :]].add(w)
        for k in range(len(w) + 1):
            shorter[w[:k] + "*" + w[k:]].add(w)
    near = defaultdict(set)
    for pattern, words in whole.items():
        for a in words:
            for b in (words | shorter[pattern]) - {a} if pattern in shorter else words - {a}:
                near[a].add(b)
                near[b].add(a)
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: f for w, f in best.items() if n[f] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def by_word(rows):
    return sorted(map(tuple, rows), key=lambda r: r[0])


def test_query_whole_table(spark):
    docs = pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = by_word(registry.QUERIES["op11_spelling_variants"](spark, SF_DIR).collect())
    assert got == plain_variants(plain_counts([(d["doc_id"], d["text"]) for d in docs]))
    assert sum(r[1] is not None for r in got) > 100


@pytest.mark.parametrize("part_words", [1 << 15, 7])
def test_near_words_however_groups_are_split(spark, part_words):
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(700)} | {"zzzzzz", "zzzzzza", "a" * 300, "a" * 301, "ÿ" * 6, "ß" * 7}
    df = spark.createDataFrame([(w, 5) for w in sorted(words)], "word string, n bigint")
    got = spelling_variants.near_words(df, part_words).collect()
    pairs = Counter(frozenset((r.word, r.near)) for r in got)
    assert set(pairs.values()) == {1}
    want = plain_variants(dict.fromkeys(words, 5))
    assert len(pairs) * 2 == sum(r[4] for r in want)
    assert Counter(w for p in pairs for w in p) == Counter({r[0]: r[4] for r in want if r[4]})


def test_chains_of_forms(spark):
    """Each word's form is five times as frequent; ties go to the first in the order of code points."""
    chain = [("abcdef" + "ghijklmnop"[:k], 5**k) for k in range(10)]
    words = [*chain, ("xbcdefg", 25), ("tietie", 5), ("tietiea", 60), ("tietieß", 60), ("alone", 0)]
    got = spelling_variants.variants(spark.createDataFrame(words[:-1], "word string, n bigint")).select("word", "form", "root", "n", "n_near", "form_n")
    assert by_word(got.collect()) == plain_variants(dict(words[:-1]))
    top = {r.word: r.root for r in got.collect()}
    assert {top[w] for w, _ in chain} == {chain[-1][0]} and top["tietie"] == "tietiea"


def test_counts_of_odd_rows(spark):
    long = "Überraschung" * 4_000
    rows = [(1, None), (None, "Zephyr zephyr ZEPHYR zephyr zephyr"), (2, ""), (3, "Éclair Éclair éclair éclair éclair éclair éclair"), (3, "ÉCLAIR ÉCLAIR ÉCLAIR Éclair Éclair Éclair"), *((k, f"abcdefg7hijklmnĀopqrstu×{long}") for k in range(300)), (4, "×÷×÷×÷ " * 6)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, n string")
    got = {r.word: r.n for r in spelling_variants.word_counts(df).collect()}
    assert got == plain_counts(rows)
    assert got["zephyr"] == 5 and any(len(w) > 40_000 for w in got)
    empty = spelling_variants.word_counts(df.limit(0))
    assert empty.collect() == [] and spelling_variants.variants(empty).collect() == []


def test_checksums():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 3000, dtype=np.uint8)
    starts = np.sort(rng.integers(0, 2500, 200))
    ends = starts + rng.integers(0, 120, 200)
    prefixes = np.array([zlib.crc32(f"{i}:".encode()) for i in range(200)], dtype=np.uint32)
    want = [zlib.crc32(f"{i}:".encode() + data[a:b].tobytes()) for i, (a, b) in enumerate(zip(starts, ends))]
    assert spelling_variants.checksums(prefixes, data, starts, ends).tolist() == want
    assert spelling_variants.letter_runs(pa.array(["", None])).counts.tolist() == [0, 0]
