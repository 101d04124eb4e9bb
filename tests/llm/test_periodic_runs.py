"""Periodic runs of words against a plain scan of every lag."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pyarrow.parquet as pq

from lakefold.llm import periodic_runs, registry, textkit

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """Every lag is scanned whole; a stretch met before has a smaller period."""
    found, seen = [], set()
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i and (i, j - i + q) not in seen:
                seen.add((i, j - i + q))
                found.append((i, j - i + q, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), best[0], best[1], best[2], milli, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    for _ in range(n):
        kinds, words = rng.choice([1, 2, 3, 5, 30]), []
        for _ in range(rng.randint(0, 12)):
            block = [str(rng.randint(0, kinds)) for _ in range(rng.randint(1, 9))]
            words += (block * 12)[: rng.randint(0, 8 * len(block))]
        yield rng.choice([" ", "\n", "\t  "]).join(words)


def test_runs_of_many_texts():
    texts = [*odd_texts(1500), "", "a a a a a", "a a a a a a", "é x é x é x é x", " ".join(["w"] * 700), " ".join(map(str, range(300))) + " 7" * 9]
    runs, _ = periodic_runs.text_runs(textkit.words_of(pa.array(texts)))
    assert runs == [plain_runs(t.split()) for t in texts]


def test_heavy_and_light_words_count_alike(monkeypatch):
    rng = random.Random(5)
    codes = periodic_runs.word_codes(textkit.words_of(pa.array([" ".join(rng.choice("aaaabbcdefgh") + rng.choice(["", "", "", "x"]) for _ in range(900))])))
    want = [0] + [sum(codes[i] == codes[i + q] for i in range(900 - q)) for q in range(1, 226)]
    assert periodic_runs.lag_counts(codes, 225).tolist() == want
    monkeypatch.setattr(periodic_runs, "PAIRS", 7)
    assert periodic_runs.lag_counts(codes, 225).tolist() == want


def test_long_texts_end_soon():
    """Lags that a run of a smaller period explains are not scanned; a grid settles most others."""
    rng = random.Random(2)
    words = [*["a"] * 200_000, *(rng.choice("ab") for _ in range(30_000)), *[str(rng.randint(0, 10**9)) for _ in range(30_000)] * 5]
    runs, stays = periodic_runs.text_runs(textkit.words_of(pa.array([" ".join(words)])))
    assert (0, 200_000, 1) in [(s, min(n, 200_000), q) for s, n, q in runs[0]] and any(n >= 150_000 and q == 30_000 for _, n, q in runs[0])
    assert stays.sum() < 70_000


def test_query_whole_table(spark):
    docs = pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = sorted(map(tuple, registry.QUERIES["op12_periodic_runs"](spark, SF_DIR).collect()))
    assert got == sorted(plain_row(d["doc_id"], d["text"]) for d in docs)
    assert any(r[1] for r in got)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "x"), (None, "a b " * 9, "x"), (1, "", None), (20, "q " * 50, "x"), (20, "q " * 50, "x"), (10, "é ü " * 40 + "z", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs string")
    out = periodic_runs.find_runs(df).collect()
    assert sorted(out[0].asDict()) == ["doc_id", "kept_text", "n_words", "runs"] and len(out) == 6
    by = {r.doc_id: r for r in out}
    assert by[None].kept_text == "a b" and [tuple(r) for r in by[None].runs] == [(0, 18, 2)]
    assert by[1].n_words == 0 and by[1].runs == [] and by[1].kept_text == ""
    got = {tuple(r) for r in spark.createDataFrame(rows, df.schema).transform(lambda d: periodic_runs.planted(d)).collect()}
    assert {r[0] for r in got} == {1, None, 20, 10}
    assert periodic_runs.find_runs(df.limit(0)).collect() == []
