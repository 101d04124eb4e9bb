"""Near-duplicate classes by BagMinHash.

A text is the multiset of its runs of five words. Each run's multiplicity is cut into dyadic intervals [0,1), [1,2),
[2,4)...; each interval is a Poisson process whose points carry a time, a position in the interval (its bits halve the
interval level by level) and a signature component. Points at positions below the multiplicity count; the earliest point
of each component is the signature, and two signatures agree in a component with probability equal to the multisets'
weighted Jaccard similarity.

Texts with the same words are one representative. Signatures are banded; texts that meet in a band form clusters, and
inside each cluster exact multiset overlaps are computed (a matrix product over the runs that its texts share), so the
links are exact and no pair is sent anywhere. Large clusters are cut into blocks, and each pair of blocks is its own
task. Classes are the connected components of the links.

BANDS x ROWS = 42 x 6 finds a pair of similarity 0.8 but for 3 in a million.

Nulls and ties: null text has no words; texts without words are copies of one another; a text of fewer than five words
is one run. Rows with a null doc_id are left out of classes (class_id null). Repeated rows each get a row. A class is
named by its smallest doc_id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.llm import textkit
from lakefold.llm.components import components
from lakefold.llm.substring_dedup import BLOBS_DDL, _batch, _blobs, _read
from lakefold.session import group_count, written

RUN = 5
SIMILARITY = 0.8
BANDS, ROWS = 42, 6
SIZE = BANDS * ROWS
BLOCK_TEXTS, BLOCK_WORDS = 2500, 2_000_000
GRAIN = float(1 << 20)


def bag(words: textkit.Words, n: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, runs (hashes) and multiplicities; sorted by text, then run."""
    hashes = words.hashes()
    starts = textkit.window_starts(words, n)
    text = words.text_of_word()
    runs, of = textkit.windows(hashes, n)[starts] if len(starts) else np.zeros(0, dtype=np.uint64), text[starts]
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        whole = [int(textkit.windows(hashes[words.word_at[i] : words.word_at[i + 1]], int(words.counts[i]))[0]) for i in short]
        runs, of = np.concatenate((runs, np.array(whole, dtype=np.uint64))), np.concatenate((of, short))
    order = np.lexsort((runs, of))
    runs, of = runs[order], of[order]
    first = np.flatnonzero(np.concatenate(([True], (runs[1:] != runs[:-1]) | (of[1:] != of[:-1])))) if len(runs) else np.zeros(0, dtype=np.int64)
    return of[first], runs[first], np.diff(np.concatenate((first, [len(runs)])))


def signatures(texts: int, of: np.ndarray, runs: np.ndarray, weight: np.ndarray, size: int = SIZE) -> np.ndarray:
    """texts x size: the time of the earliest point of each component; infinite for texts without runs."""
    out = np.full(texts * size, np.inf)
    total = np.bincount(of, weights=weight, minlength=texts)
    levels = np.ceil(np.log2(weight)).astype(np.int64) + 1 if len(weight) else np.zeros(0, dtype=np.int64)
    token = np.repeat(np.arange(len(of)), levels)
    level = np.arange(len(token)) - np.repeat(np.cumsum(levels) - levels, levels)
    width = np.where(level == 0, 1.0, np.exp2(level - 1.0))
    begin = np.where(level == 0, 0.0, width)
    seed = textkit.mix(runs[token] + level.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    wait = np.log(size) + 1.5
    todo = total > 0
    while todo.any():
        until = np.where(todo, wait * size / np.maximum(total, 1), -1.0)
        now = np.flatnonzero(todo[of[token]])
        h, time = seed[now], np.zeros(len(now))
        while len(now):
            h = textkit.mix(h + np.uint64(0xE7037ED1A0B428DB))
            uniform = ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            time = time + np.floor(-np.log(uniform) * GRAIN) / GRAIN / width[now]
            at = of[token[now]]
            alive = time <= until[at]
            now, h, time, at = now[alive], h[alive], time[alive], at[alive]
            other = textkit.mix(h ^ np.uint64(0x8EBC6AF09C88C6E3))
            place = begin[now] + width[now] * ((other >> np.uint64(32)).astype(np.float64) * 2.0**-32)
            inside = (width[now] == 1.0) | (place < weight[token[now]])
            slot = at[inside] * size + ((other[inside] & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)
            np.minimum.at(out, slot, time[inside])
        todo &= np.isinf(out.reshape(texts, size)).any(axis=1)
        wait *= 1.6
    return out.reshape(texts, size)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """texts x BANDS hashes."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    h = np.zeros((len(signature), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        h = h * np.uint64(0x9FB21C651E98DF25) + textkit.mix(bits[:, :, r].copy())
    return textkit.mix(h + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


SIGNED_DDL = "doc_id bigint, text_key bigint, k1 bigint, k2 bigint, n_words bigint, bands binary"


def sign(docs: DataFrame) -> DataFrame:
    """A row per document: two hashes of its sequence of words, their number, and its band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in textkit.pieces(batches, "text"):
            words = textkit.words_of(textkit.column(piece, "text"))
            place = (np.arange(len(words.starts)) - np.repeat(words.word_at[:-1], words.counts)).astype(np.uint64)
            keys = []
            for which in (0, 1):
                h = textkit.mix(words.hashes(which) + place * np.uint64(0xD1B54A32D192ED03))
                total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(h)))
                keys.append((total[words.word_at[1:]] - total[words.word_at[:-1]]).view(np.int64))
            hashes = band_hashes(signatures(piece.num_rows, *bag(words)))
            bands = [b.tobytes() if n else None for b, n in zip(hashes, words.counts, strict=True)]
            yield pa.record_batch(
                [textkit.column(piece, "doc_id").cast(pa.int64()), textkit.column(piece, "text_key"), *map(pa.array, keys), pa.array(words.counts, pa.int64()), pa.array(bands, pa.binary())],
                names=["doc_id", "text_key", "k1", "k2", "n_words", "bands"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, SIGNED_DDL)


def _deal(buckets: int):
    """Band hashes of each document, by bucket of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                hashes = np.frombuffer(b"".join(textkit.column(part, "bands").to_pylist()), dtype=np.uint64)
                docs = np.repeat(textkit.column(part, "doc_id").to_numpy(), BANDS)
                yield _batch(list(_blobs(((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32), docs, hashes, 0)))

    return run


EDGES_DDL = "a bigint, b bigint"


def _meet(parts: int):
    """Of one bucket: each document with the smallest of those in its band, dealt by document."""

    def run(_key: tuple, table: pa.Table) -> pa.Table:
        keys, docs = _read(table, 0, "<u8")
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=bool)
        smallest = docs[first][np.cumsum(first) - 1] if len(keys) else docs
        pairs = np.unique(np.stack((docs, smallest), axis=1)[docs != smallest], axis=0)
        return pa.Table.from_batches([_batch(list(_blobs((pairs[:, 0] % parts).astype(np.int32), pairs[:, 0], pairs[:, 1], 1)))])

    return run


def _contract(_key: tuple, table: pa.Table) -> pa.Table:
    """Of some documents' edges to smaller ones: each document to its smallest, and the others of them to that one."""
    smaller, docs = _read(table, 1, "<i8")
    order = np.lexsort((smaller, docs))
    smaller, docs = smaller[order], docs[order]
    first = np.concatenate(([True], docs[1:] != docs[:-1])) if len(docs) else np.zeros(0, dtype=bool)
    least = smaller[first][np.cumsum(first) - 1] if len(docs) else docs
    pairs = np.unique(np.concatenate((np.stack((docs, least), axis=1)[first], np.stack((smaller, least), axis=1)[~first])), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def linked(texts: pa.Array, ids: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """For each text: the smallest id of the texts that it is linked to, directly or through others, itself included."""
    n = len(texts)
    words = textkit.words_of(texts)
    of, runs, weight = bag(words)
    size = np.bincount(of, weights=weight, minlength=n)
    # a run with multiplicity w is w tokens, so that multisets become sets
    token = np.repeat(textkit.mix(runs), weight) + textkit.runs(np.zeros(len(weight), dtype=np.int64), weight).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    row = np.repeat(of, weight)
    order = np.lexsort((row, token))
    token, row = token[order], row[order]
    first = np.concatenate(([True], token[1:] != token[:-1])) if len(token) else np.zeros(0, dtype=bool)
    column = np.cumsum(first) - 1
    often = np.bincount(column, minlength=1)[column] > 1 if len(column) else np.zeros(0, dtype=bool)
    leads = row[first][column] if len(column) else row  # columns go by their first text, so that each step touches few texts
    column, row, leads = column[often], row[often], leads[often]
    order = np.lexsort((column, leads))
    column, row = column[order], row[order]
    column = np.cumsum(np.concatenate(([0], (column[1:] != column[:-1]).astype(np.int64)))) if len(column) else column
    overlap = np.zeros((n, n), dtype=np.float32)
    for c0 in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        a, b = np.searchsorted(column, (c0, c0 + 2048))
        rows, place = np.unique(row[a:b], return_inverse=True)
        m = np.zeros((len(rows), min(2048, int(column[b - 1]) + 1 - c0)), dtype=np.float32)
        m[place, column[a:b] - c0] = 1
        overlap[np.ix_(rows, rows)] += m @ m.T
    label = np.arange(n)
    for i in range(n):
        near = overlap[i] >= least * (size[i] + size - overlap[i]) - 1e-3
        near &= overlap[i] > 0
        near[i] = True
        found = np.unique(label[near])
        if len(found) > 1:
            label[np.isin(label, found)] = found[0]
    out = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(out, label, ids)
    return out[label]


def _verify(least: float):
    def run(_key: tuple, table: pa.Table) -> pa.Table:
        ids = table["doc_id"].to_numpy()
        root = linked(table["text"].combine_chunks(), ids, least)
        return pa.table({"a": pa.array(ids[ids != root]), "b": pa.array(root[ids != root])})

    return run


def near_classes(docs: DataFrame, least: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, class_id, n_words, text_key (which tells texts of the same doc_id apart) and first: whether
    the row stands for its class, that is for its words, and its id names the class."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    buckets = group_count(docs)
    signed = written(sign(docs), "signed")
    known = signed.where("doc_id IS NOT NULL")
    groups = written(known.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "text_key", "n_words", "bands")).alias("r")).select("k1", "k2", "r.*"), "representatives")
    met = groups.where("bands IS NOT NULL").select("doc_id", "bands").mapInArrow(_deal(buckets), BLOBS_DDL).groupBy("bucket").applyInArrow(_meet(buckets), BLOBS_DDL)
    met = met.groupBy("bucket").applyInArrow(_contract, EDGES_DDL)
    clusters = components(met).join(groups.select(F.col("doc_id").alias("node"), "n_words"), "node")
    clusters = written(clusters, "clusters")
    blocks = clusters.groupBy("label").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n_words") / BLOCK_WORDS)).cast("int").alias("blocks"))
    placed = clusters.join(blocks, "label").select(F.col("node").alias("doc_id"), "label", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    # a merge join at every size, so that what moves grows in proportion
    pairs = docs.join(placed.hint("merge"), "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("doc_id", "text", "label", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    links = pairs.groupBy("label", "b1", "b2").applyInArrow(_verify(least), EDGES_DDL)
    classes = components(links).toDF("rep", "class")
    named = groups.select("k1", "k2", F.col("doc_id").alias("rep"), F.col("text_key").alias("rep_key")).join(classes, "rep", "left")
    named = named.select("k1", "k2", F.coalesce("class", "rep").alias("class_id"), "rep_key")
    out = signed.join(named.hint("merge"), ["k1", "k2"], "left")
    first = F.coalesce((F.col("doc_id") == F.col("class_id")) & (F.col("text_key") == F.col("rep_key")), F.lit(False))
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), "n_words", "text_key", first.alias("first"))


def representatives(docs: DataFrame, least: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The document of each class that has the smallest id, with all its columns: of rows that agree in id and words, one
    (that with the smallest text_key, else any); where other texts have this id too, they stay unless they are copies of a
    smaller id's. Rows with a null id all stay."""
    first = near_classes(docs, least, doc_id, text).where("first").select("doc_id", "text_key")
    id_name, key_name = "_near_dedup_id", "_near_dedup_key"
    keyed = docs.withColumn(id_name, F.col(doc_id).cast("bigint")).withColumn(key_name, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    kept = keyed.join(first.toDF(id_name, key_name).hint("merge"), [id_name, key_name], "left_semi").dropDuplicates([id_name, key_name])
    return kept.unionByName(keyed.where(F.col(doc_id).isNull())).select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key", "first")
