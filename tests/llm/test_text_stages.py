"""Chat formatting, quality rules, substring dedup and packing against plain Python."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakefold.llm import chat_format, packing, quality, registry, substring_dedup
from tests.compare import oracle, rows

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, name):
    got, want = registry.QUERIES[name](spark, SF_DIR).toPandas(), oracle(SF_DIR, registry.ORACLES[name])
    assert rows(got) == rows(want)


def test_chat_round_trip(spark):
    rng = random.Random(3)
    bits = ["<|im_start|>", "<|im_end|>\n", "<|turn|>", "␛", "␛1", "</s>", "[INST]", "\n", "<", "|", ">", "x", "é🙂", "user", ""]
    turns = [(c, t, rng.choice(["user", "assistant", "system", "a\nb", None]), rng.choice([None, "".join(rng.choices(bits, k=rng.randint(0, 9)))]), "x") for c in [*range(40), None] for t in range(rng.randint(1, 7))]
    turns += [(3, 0, "user", "tie", "x"), (3, 0, "user", "tie", "x")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, formatted string")
    out = chat_format.format_chat(df).withColumn("turns", chat_format.parse(F.col("formatted"))).collect()
    assert len(out) == 41
    for r in out:
        want = sorted((t, role or "", text or "") for c, t, role, text, _ in turns if c == r.conv_id)
        assert [(x.role, x.text) for x in r.turns] == [w[1:] for w in want]
        assert sum(x.chars for x in r.loss_runs) == len(r.formatted)
        at, loss = 0, []
        for x in r.loss_runs:
            loss += [r.formatted[at : at + x.chars]] if x.loss else []
            at += x.chars
        back = [x for s in loss for x in [s]]
        for plain, code in reversed(chat_format.ESCAPES):
            back = [b.replace(chat_format.MARK + code, plain) for b in back]
        assert back == [w[2] for w in want if w[1] == "assistant"]
    assert chat_format.format_chat(df.limit(0)).collect() == []


def test_loss_text_is_read_through_the_mask(spark):
    turns = [(c, t, "assistant" if t % 3 else "user", f"é<|{t}|>␛" * (t % 4)) for c, n in ((1, 400), (2, 1), (3, 64), (4, 65), (5, 2)) for t in range(n)] + [(6, 0, "user", "x" * 300_000), (6, 1, "assistant", "y" * 300_000)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string")
    made = chat_format.format_chat(df)
    want = {c: "".join(x for k, t, r, x in turns if k == c and r == "assistant") for c, *_ in turns}
    assert {r.conv_id: r.loss_text for r in chat_format.with_loss_text(made).collect()} == want
    wrong = made.withColumn("loss_runs", F.transform("loss_runs", lambda r: F.struct(r["chars"].alias("chars"), (~r["loss"]).alias("loss"))))
    assert all(r.loss_text != want[r.conv_id] for r in chat_format.with_loss_text(wrong).collect())


def test_chat_is_native(spark):
    plan = registry.QUERIES["op3_chat_format"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def statistics(text):
    w = WORD.findall(text or "")
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_statistics(spark):
    rng = random.Random(5)
    parts = ["a", "b", "é", "word", " ", " ", "\n", "\t", "#", "<x>", "a b c d e f", "\n\n", "日本"]
    texts = [None, "", "   ", "\n", "x" * 200_000, "a b c d e " * 30, *("".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("kept", F.lit("clash"))
    got = quality.score(df, None).collect()
    for r in got:
        want = statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r.kept == (not r.base_failed)
    assert quality.score(df.limit(0), None).collect() == []


def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = known.where("doc_id % 3 = 0")
    model = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    scored = quality.score(docs.join(held, "doc_id").select("doc_id", "text", "quality"), model).where("NOT base_failed").toPandas()
    assert ((scored.p_good >= quality.KEEP_AT) == (scored.quality == 1)).mean() >= 0.9
    assert quality.train(docs, labels.where("quality = 1")) is None
    assert quality.train(docs.limit(0), labels.limit(0)) is None


def test_quality_depends_on_the_text_alone(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    columns = ["doc_id", "n_words", "n_repeat_words", "p_good", "p_toxic", "kept"]
    whole, dealt = (sorted(map(tuple, quality.score(d.select("doc_id", "text"), model).select(columns).collect())) for d in (docs.coalesce(1), docs.repartition(17, F.rand(3))))
    assert whole == dealt
    import pyarrow as pa

    alone = [quality.features(pa.array([t])) for t in ("one two", "zwei drei")]
    both = quality.features(pa.array(["one two", "zwei drei"]))
    assert both.column.tolist() == [*alone[0].column.tolist(), *alone[1].column.tolist()]
    assert model.probabilities(pa.array(["ab cé", "x"]))[0] == model.probabilities(pa.array(["ab cé"]))[0]


def test_quality_learns_each_label_once(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    some = labels.orderBy("doc_id").limit(1).select("doc_id")
    copies = docs.join(some, "doc_id").select("doc_id", F.lit("zzzz ").alias("text")).crossJoin(spark.range(300).select())
    more = labels.unionByName(spark.createDataFrame([(10**9, 1, 0)], labels.schema))
    a, b = (quality.train(d, x) for d, x in ((docs, labels), (docs.select("doc_id", "text").unionByName(copies), more)))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias and a.offset != b.offset


def test_toxic_documents_are_rejected(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    known = labels.where("doc_id % 3 = 0").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    scored = quality.score(docs.join(known, "doc_id").select("doc_id", "text", "quality", "toxic"), model).where("NOT base_failed").toPandas()
    toxic, clean = scored[scored.toxic == 1], scored[(scored.toxic == 0) & (scored.quality == 1)]
    assert (~toxic.kept).mean() >= 0.75 and clean.kept.mean() >= 0.97


def test_substring_dedup(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    texts = []
    for i in range(120):
        w = [rng.choice(words) for _ in range(rng.randint(0, 70))]
        if i % 3 == 0:
            a = rng.randint(0, 30)
            at = rng.randint(0, len(w))
            w[at:at] = passage[a : a + rng.randint(5, 40)]
        texts.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    texts += [(200, texts[0][1]), (201, "x " * 60), (202, "x " * 50), (203, None), (204, ""), (0, texts[0][1]), (None, texts[3][1]), (205, "y" * 100_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id bigint, text string, removed int")
    got = substring_dedup.find_repeats(df).collect()
    first = {}
    for i, t in texts:
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            if i is not None:
                key = tuple(w[k : k + 13])
                first[key] = min(i, first.get(key, i))
    want = []
    for i, t in texts:
        w = WORD.findall(t or "")
        gone = {j for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        want.append((i if i is not None else -1, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, " ".join(WORD.findall(r.kept_text))) for r in got) == sorted(want)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got)
    assert substring_dedup.find_repeats(df.limit(0)).collect() == []


def test_bucket_lengths_are_optimal():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randint(1, 8)
        lengths, counts, k = sorted(rng.sample(range(1, 40), n)), [rng.randint(1, 9) for _ in range(n)], rng.randint(1, 5)
        cost = lambda bs: sum(c * min(b for b in bs if b >= x) for x, c in zip(lengths, counts, strict=True))  # noqa: B023, E731
        best = min(cost(b) for j in range(1, min(k, n) + 1) for b in itertools.combinations(lengths, j) if b[-1] == lengths[-1])
        found = packing.bucket_lengths(np.array(lengths), np.array(counts), k)
        assert cost(found) == best and len(found) <= k


def test_packing(spark):
    data = [(i, (i * 37) % 500) for i in range(400)] + [(1000, 50_000), (1001, None), (1002, 0), (7, 259), (None, 3)]
    df = spark.createDataFrame([(i, n, "x") for i, n in data], "doc_id bigint, n int, batch string")
    got = packing.pack(packing.segments(df, "doc_id", F.col("n"), 256), budget=1024, buckets=5).toPandas()
    assert sorted(got.groupby(got.doc_id.fillna(-1)).n_tokens.sum().items()) == sorted(Counter({-1: 3} | {}).items() | {(i, sum(n or 0 for j, n in data if j == i)) for i, _ in data if i is not None})
    assert (got.n_tokens <= got.bucket_length).all() and got.bucket_length.nunique() <= 5
    assert not got.duplicated(["bucket_length", "batch", "slot"]).any()
    for length, part in got.groupby("bucket_length"):
        capacity = max(1, 1024 // length)
        assert part.groupby("batch").size().max() <= capacity and part.batch.nunique() == -(-len(part) // capacity)
    assert packing.pack(packing.segments(df.limit(0), "doc_id", F.col("n"))).collect() == []


def test_packed_sequences_are_the_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "no id"), (4, "é x " * 300), (5, "a b c")]
    df = spark.createDataFrame([(i, t, b"x", "clash") for i, t in texts], "doc_id bigint, text string, ids binary, slot string")
    got = packing.pack_texts(df, max_length=64).toPandas()
    want = Counter((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in texts)
    read, held = Counter(), {}
    for r in got.itertuples():
        ids = np.frombuffer(r.ids, dtype="<u2").tolist()
        assert len(ids) == r.n_tokens <= r.bucket_length
        held.setdefault((None if r.doc_id != r.doc_id else r.doc_id, r.segment), []).append(ids)
    for (i, k), parts in held.items():
        if k == 0:
            for ids in parts:
                read[i, tuple(ids + [x for n in range(1, 99) for p in held.get((i, n), []) for x in p])] += 1
    assert read == want
    cost = lambda lengths: sum(min(b for b in lengths if b >= n) - n for n in got.n_tokens)
    assert cost(got.bucket_length.unique()) == 0  # as many lengths as buckets
    assert packing.pack_texts(df.limit(0)).collect() == []


def test_digest_of_kept_words(spark):
    r = registry.QUERIES["op7_substring_dedup"](spark, SF_DIR).where("n_removed = 0").limit(1).first()
    text = spark.read.parquet(f"{SF_DIR}/documents.parquet").where(F.col("doc_id") == r.doc_id).first().text
    assert r.kept_sha256 == hashlib.sha256(" ".join(WORD.findall(text)).encode()).hexdigest()
