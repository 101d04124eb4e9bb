"""The pipeline against its stages in plain Python."""

import re

import corpus_pipeline
import numpy as np
import public_tokenizers
from lakefold.llm import near_dedup, quality
from tests.llm.test_near_dedup import brute
from tokenizers import Tokenizer

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "substring_duplicates", "decontamination", "packing"]
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        seen.append(docs.toPandas())
        docs = stage(spark, docs, SF_DIR).persist()
        if stage is not corpus_pipeline.packed:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    packed = docs.toPandas()
    first, good, single, cut, clean = seen
    model = quality.train(spark.createDataFrame(first), spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    kept = {r.doc_id for r in quality.score(spark.createDataFrame(first), model).where("kept").collect()}
    assert set(good.doc_id) == kept
    classes = brute(list(zip(good.doc_id, good.text, strict=True)))
    assert set(single.doc_id) == {i for i, c in classes.items() if i == c}
    words = {i: WORD.findall(t) for i, t in zip(single.doc_id, single.text, strict=True)}
    earliest = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            earliest.setdefault(tuple(words[i][k : k + 13]), i)
    left = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - 12) if earliest[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        if len(gone) < len(w) or not w:
            left[i] = [x for j, x in enumerate(w) if j not in gone]
    assert {i: WORD.findall(t) for i, t in zip(cut.doc_id, cut.text, strict=True)} == left
    assert (cut.n_chars == cut.text.str.len()).all() and set(clean.doc_id) <= set(cut.doc_id)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {i: b"".join(part.sort_values("segment").ids) for i, part in packed.groupby("doc_id")}
    assert got == {i: np.array([*library.encode(t, add_special_tokens=False).ids, 2], dtype="<u2").tobytes() for i, t in zip(clean.doc_id, clean.text, strict=True)}


def test_run_writes_each_stage(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.columns == ["doc_id", "segment", "n_tokens", "ids", "bucket_length", "batch", "slot"] and out.count() > 0
    assert near_dedup.SIMILARITY == 0.8 and near_dedup.RUN == 5


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept int, n_words int, _part string, removed string, k1 int"
FILL = [f"w{k}" for k in range(4000)]


def rows_of(texts):
    return [(i, t, "en", f"s{n}", len(t or ""), n, n, "p", "r", n) for n, (i, t) in enumerate(texts)]


def test_stages_judge_rows_by_their_texts(spark, monkeypatch):
    """Null and repeated ids, null and empty texts, ties, columns that clash with the stages' own."""
    text = lambda a, n: " ".join(FILL[a : a + n])
    leak = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").first().text
    texts = [(1, text(0, 60)), (1, text(100, 60)), (1, text(0, 60)), (2, text(0, 60)), (3, text(100, 59)), (4, text(200, 30) + " " + text(0, 30)), (None, text(0, 60)), (None, None)]
    texts += [(5, None), (5, ""), (6, leak), (6, text(300, 40)), (None, leak), (7, "")]
    df = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    names = lambda d: sorted(r.k1 for r in d.collect())  # noqa: E731  k1 is the row's number
    monkeypatch.setattr(quality, "train", lambda docs, labels: None)
    assert names(corpus_pipeline.quality_rules(spark, df, SF_DIR)) == [n for n, (_, t) in enumerate(texts) if t and len(t.split()) >= 10]
    got = corpus_pipeline.near_duplicates(spark, df, SF_DIR)
    assert got.columns == df.columns
    kept = names(got)
    assert [n for n in kept if n > 3] == [5, 6, 7, *([8] if 8 in kept else [9]), 10, 11, 12]  # the empty texts are one class, whose smallest id is 5
    assert [n for n in kept if n < 5 and n not in (0, 2)] == [1] and len(kept) == 9
    cut = {r.k1: r for r in corpus_pipeline.substring_duplicates(spark, df, SF_DIR).collect()}
    assert set(cut) == set(range(14)) - {3, 4}
    assert cut[5].text.split() == FILL[200:230] and cut[5].n_chars == len(cut[5].text) and cut[6].text == texts[6][1] and cut[2].text == texts[2][1]
    assert cut[5][5:] == rows_of(texts)[5][5:]
    assert names(corpus_pipeline.decontamination(spark, df, SF_DIR)) == [n for n in range(14) if n not in (10, 12)]
    packed = corpus_pipeline.packed(spark, df, SF_DIR)
    assert packed.count() == 14 and packed.where("doc_id IS NULL").count() == 3
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), SF_DIR).collect() == []
