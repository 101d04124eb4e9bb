"""Exact substring dedup with fixed-block anchors.

Of any N consecutive words of a document, some aligned block of (N + 1) // 2 words lies wholly inside. So:
1. every document indexes its non-overlapping blocks and probes the index with every rolling window of a block's length;
2. where another document's block is met, both sides' hits are extended to the N-word windows around them, and windows
   with equal hashes are repeats: they are taken to the smallest doc_id, which makes runs of them maximal exact repeats;
3. each document drops the words covered by windows that start in a document with a smaller doc_id.

Hashes travel as arrays of fixed-width integers, a row per bucket of hashes and batch, not as a row per window; the
text passes the network once (both readers share that exchange). Buckets are as many as shuffle partitions, so a bucket
holds a fixed share of the words. What a task can decide among its own windows it does not send, so a passage that very
many documents share is a few rows from each task. Block hits are only candidates; repeats are decided by a hash of 64
bits within a bucket that other bits choose: right but for a chance of collision of 1 in 2**64 for each pair of windows.

Nulls and ties: null text has no words; rows with a null doc_id are returned whole and never serve as the earlier
document; rows with equal doc_id are no earlier documents of one another; repeated rows stay. Extra columns stay;
columns named n_words, n_removed, removed or kept_text are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.llm import textkit
from lakefold.session import group_count

WINDOW = 13
FLUSH = 1 << 19
LOW = np.uint64(0xFFFFFFFF)
PART, REST = "_part", ("n_words", "n_removed", "removed", "kept_text")
BLOBS_DDL = "bucket int, kind int, docs binary, counts binary, keys binary"
BLOBS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    return (ids ^ (ids.view(np.uint64) >> np.uint64(17)).view(np.int64)) % parts


def part_column(doc_id: str, parts: int) -> Column:
    """As _part(); rows without an id go to part 0."""
    c = F.col(doc_id).cast("bigint")
    return F.coalesce(F.pmod(c.bitwiseXOR(F.shiftrightunsigned(c, 17)), F.lit(parts)), F.lit(0)).cast("int")


def _blobs(bucket: np.ndarray, docs: np.ndarray, keys: np.ndarray, kind: int, grouped: bool = False) -> Iterator[tuple]:
    """Rows (bucket, kind, documents, how many keys each has, keys). grouped: the keys of a document stand together."""
    if not len(bucket):
        return
    if grouped:
        order = np.argsort(bucket.astype(np.uint16) if int(bucket.max()) < 1 << 16 else bucket, kind="stable")
    else:
        order = np.lexsort((docs, bucket))
    bucket, docs, keys = bucket[order], docs[order], keys[order]
    del order
    new = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (bucket[1:] != bucket[:-1]))))
    counts = np.diff(np.concatenate((new, [len(docs)]))).astype(np.uint32)
    run_bucket, run_docs = bucket[new], docs[new]
    first = np.flatnonzero(np.concatenate(([True], run_bucket[1:] != run_bucket[:-1])))
    for a, b in zip(first, np.concatenate((first[1:], [len(new)])), strict=True):
        k0, k1 = new[a], (new[b] if b < len(new) else len(docs))
        yield int(run_bucket[a]), kind, run_docs[a:b].tobytes(), counts[a:b].tobytes(), keys[k0:k1].tobytes()


def _batch(rows: list[tuple], schema: pa.Schema = BLOBS) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.record_batch([pa.array(list(c), type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _read(table: pa.Table, kind: int, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and documents of the rows of one kind."""
    docs, keys = [], []
    for r_kind, d, c, k in zip(*(table[n].to_pylist() for n in ("kind", "docs", "counts", "keys")), strict=True):
        if r_kind == kind:
            docs.append(np.repeat(np.frombuffer(d, dtype=np.int64), np.frombuffer(c, dtype=np.uint32)))
            keys.append(np.frombuffer(k, dtype=dtype))
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([np.zeros(0, dtype=dtype), *keys]), np.concatenate([empty, *docs])


def _block_codes(words: textkit.Words, block: int, buckets: int) -> np.ndarray:
    """For each window of block words: its bucket above 32 bits of hash."""
    h = textkit.windows(words.hashes(), block)
    return (((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (h & LOW)


def _met_here(codes: np.ndarray, docs: np.ndarray, aligned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows are hits among these already, and which have to meet those of other tasks: of a code's aligned blocks
    the one of the smallest document, and no window of a later document. So a code that many documents share sends a few
    windows from a task, not one for each of them."""
    order = np.lexsort((~aligned, docs, codes))
    code, doc, block = codes[order], docs[order], aligned[order]
    first = np.concatenate(([True], code[1:] != code[:-1])) if len(code) else np.zeros(0, dtype=bool)
    run = np.cumsum(first) - 1
    leads = np.flatnonzero(block)
    leads = leads[np.concatenate(([True], run[leads][1:] != run[leads][:-1]))] if len(leads) else leads
    least = np.full(int(first.sum()), np.iinfo(np.int64).max)
    least[run[leads]] = doc[leads]
    later = doc > least[run]
    shared = np.zeros(len(least), dtype=bool)
    shared[run[later]] = True
    hit, sent = np.empty(len(codes), dtype=bool), np.empty(len(codes), dtype=bool)
    hit[order] = later | (block & shared[run])
    lead = np.zeros(len(codes), dtype=bool)
    lead[leads] = True
    sent[order] = np.where(block, lead, ~later)
    return hit, sent


def _probe(block: int, buckets: int, parts: int):
    """Aligned blocks (kind 0) and the other rolling windows (kind 1) of each document, by bucket; hits among the windows
    of one task (kind 2), by part, which go through the same exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # codes, documents, whether aligned
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            codes, docs, aligned = (np.concatenate([h[i] for h in held]) for i in range(3))
            held.clear()
            hit, sent = _met_here(codes, docs, aligned)
            rows = list(_blobs(_part(docs[hit], parts).astype(np.int32), docs[hit], codes[hit].astype("<u8"), 2, grouped=True))
            for kind, chosen in ((0, sent & aligned), (1, sent & ~aligned)):
                found = codes[chosen]
                rows += _blobs((found >> np.uint64(32)).astype(np.int32), docs[chosen], (found & LOW).astype("<u4"), kind, grouped=True)
            del codes, docs, aligned, hit, sent
            out = _batch(rows)
            rows.clear()
            textkit.release_memory()
            yield out

        for piece in textkit.pieces(batches, "text"):
            words = textkit.words_of(textkit.column(piece, "text"))
            starts = textkit.window_starts(words, block)
            ids = textkit.column(piece, "doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            owner = words.text_of_word()[starts]
            starts, owner = starts[known[owner]], owner[known[owner]]
            codes = _block_codes(words, block, buckets)[starts] if len(starts) else np.zeros(0, dtype=np.uint64)
            held.append((codes, ids[owner], (starts - words.word_at[owner]) % block == 0))
            size += len(starts)
            if size >= FLUSH:
                yield from flush()
                size = 0
        if size:
            yield from flush()

    return run


def _smallest(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the smallest document of each."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=bool)
    return keys[first], docs[first]


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys among sorted_keys, and whether they are there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _with(table: pa.Table, kind: int, rows: list[tuple]) -> pa.Table:
    """rows, and those of the table that are of this kind."""
    passed = table.filter(pa.compute.equal(table["kind"], kind)).select(BLOBS.names).cast(BLOBS)
    return pa.concat_tables([passed, pa.Table.from_batches([_batch(rows)])])


def _released(run):
    """run, and the memory that it has freed goes back before the next group comes."""

    def wrapped(*args):
        out = run(*args)
        textkit.release_memory()
        return out

    # the number of parameters tells Spark whether a function wants the key
    return (lambda key, a: wrapped(key, a)) if run.__code__.co_argcount == 2 else (lambda key, a, b: wrapped(key, a, b))


def _hits(parts: int):
    """Of one bucket: the codes that two documents share, sent to the parts of both."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = np.uint64(key[0].as_py())
        index, index_docs = _read(table, 0, "<u4")
        probes, probe_docs = _read(table, 1, "<u4")
        keys, smallest = _smallest(index, index_docs)
        live = np.zeros(len(keys), dtype=bool)
        at, there = _find(keys, probes)
        hit = there & (probe_docs > smallest[at]) if len(keys) else there
        live[at[hit]] = True
        own, _ = _find(keys, index)
        if len(keys):
            live[own[index_docs > smallest[own]]] = True
        shared = live[own] if len(keys) else np.zeros(0, dtype=bool)
        codes = (bucket << np.uint64(32)) | np.concatenate((probes[hit], index[shared])).astype(np.uint64)
        docs = np.concatenate((probe_docs[hit], index_docs[shared]))
        return _with(table, 2, list(_blobs(_part(docs, parts).astype(np.int32), docs, codes.astype("<u8"), 2)))

    return run


def _repeats(parts: int):
    """Of one bucket of N-word windows: those that start in a smaller document too, sent to their document's part."""

    def run(_key: tuple, table: pa.Table) -> pa.Table:
        keys, docs = _read(table, 3, "<u8")
        known, smallest = _smallest(keys, docs)
        at, _ = _find(known, keys)
        later = docs > smallest[at] if len(known) else np.zeros(0, dtype=bool)
        return _with(table, 4, list(_blobs(_part(docs[later], parts).astype(np.int32), docs[later], keys[later], 4)))

    return run


def _documents(table: pa.Table) -> Iterator[pa.RecordBatch]:
    return textkit.pieces(iter(table.to_batches()), "text")


def _ids(piece: pa.RecordBatch) -> np.ndarray:
    return textkit.column(piece, "doc_id").cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()


def _keyed(codes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return textkit.mix(codes + textkit.mix(docs.view(np.uint64) + np.uint64(7)))


def _marked(piece: pa.RecordBatch, words: textkit.Words, n: int, codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Starts of the windows of n words whose (code, document) is wanted (sorted)."""
    starts = textkit.window_starts(words, n)
    if not len(starts) or not len(wanted):
        return np.zeros(0, dtype=np.int64)
    _, there = _find(wanted, _keyed(codes[starts], _ids(piece)[words.text_of_word()[starts]]))
    return starts[there]


def _extend(n: int, block: int, buckets: int, parts: int):
    """The N-word windows around the hits of each document of a part, by bucket (kind 3): of equal ones, those of the
    smallest document; the others are repeats already (kind 4)."""

    def run(_key: tuple, docs: pa.Table, hits: pa.Table) -> pa.Table:
        codes, of = _read(hits, 2, "<u8")
        rows: list[tuple] = []
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(codes):
            docs = docs.filter(pa.compute.is_in(docs["doc_id"], value_set=pa.array(np.unique(of))))
            wanted = np.unique(_keyed(codes, of))
            for piece in _documents(docs):
                words = textkit.words_of(textkit.column(piece, "text"))
                at = _marked(piece, words, block, _block_codes(words, block, buckets), wanted)
                near = np.zeros(len(words.starts) + 1, dtype=np.int32)
                np.add.at(near, np.maximum(at - (n - block), 0), 1)
                np.add.at(near, at + 1, -1)
                starts = textkit.window_starts(words, n)
                starts = starts[np.cumsum(near)[starts] > 0]
                if len(starts):
                    first, second = _window_codes(words, n)
                    bucket = (second[starts] % np.uint64(buckets)).astype(np.int32)
                    found.append((bucket, _ids(piece)[words.text_of_word()[starts]], first[starts].astype("<u8")))
        if found:
            bucket, of, codes = (np.concatenate([f[i] for f in found]) for i in range(3))
            found.clear()
            order = np.lexsort((of, codes, bucket))
            bucket, of, codes = bucket[order], of[order], codes[order]
            first = np.concatenate(([True], (codes[1:] != codes[:-1]) | (bucket[1:] != bucket[:-1])))
            later = of > of[first][np.cumsum(first) - 1]
            rows += _blobs(bucket[first], of[first], codes[first], 3)
            rows += _blobs(_part(of[later], parts).astype(np.int32), of[later], codes[later], 4)
        return pa.Table.from_batches([_batch(rows)])

    return run


def _window_codes(words: textkit.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    return textkit.windows(words.hashes(0), n, 0), textkit.windows(words.hashes(1), n, 1)


def _cut(n: int, schema: pa.Schema, text: str):
    """The documents of a part, with their repeats found and cut out."""

    def run(_key: tuple, docs: pa.Table, repeats: pa.Table) -> pa.Table:
        codes, of = _read(repeats, 4, "<u8")
        wanted = np.unique(_keyed(codes, of))
        out = []
        for piece in _documents(docs):
            words = textkit.words_of(textkit.column(piece, "text"))
            covered = np.zeros(len(words.starts) + 1, dtype=np.int32)
            if len(wanted):
                at = _marked(piece, words, n, textkit.windows(words.hashes(0), n, 0), wanted)
                np.add.at(covered, at, 1)
                np.add.at(covered, at + n, -1)
            gone = np.cumsum(covered[:-1]) > 0
            raw = words.data.tobytes()
            counts, removed, spans, texts = words.counts, [], [], []
            for i, (a, b) in enumerate(zip(words.word_at[:-1].tolist(), words.word_at[1:].tolist(), strict=True)):
                lost = gone[a:b]
                removed.append(int(lost.sum()))
                if not removed[-1]:
                    spans.append([])
                    texts.append(raw[words.text_at[i] : words.text_at[i + 1]].decode())
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate(([0], lost.astype(np.int8), [0]))))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
                kept, at = [], int(words.text_at[i])
                for s, e in zip(edge[::2], edge[1::2], strict=True):
                    kept.append(raw[at : words.starts[a + s]])
                    at = int(words.starts[a + e]) if a + e < b else int(words.text_at[i + 1])
                kept.append(raw[at : words.text_at[i + 1]])
                texts.append(b"".join(kept).decode())
            named = {"n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "removed": pa.array(spans, schema.field("removed").type), "kept_text": pa.array(texts, pa.string())}
            columns = [named[f.name] if f.name in named else textkit.column(piece, {"doc_id": "doc_id"}.get(f.name, f.name)).cast(f.type) for f in schema]
            out.append(pa.RecordBatch.from_arrays(columns, schema=schema))
        return pa.Table.from_batches(out, schema=schema)

    return run


def find_repeats(docs: DataFrame, n: int = WINDOW, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs (without columns named as the added ones, and without text unless keep_text) with n_words, n_removed, removed (ranges of word positions) and
    kept_text: the text with the removed words, and the white space after them, cut out."""
    spark = docs.sparkSession
    block = (n + 1) // 2
    buckets = group_count(docs)
    parts = buckets
    if (doc_id, text) != ("doc_id", "text"):
        docs = docs.drop(*({"doc_id", "text"} - {doc_id, text})).withColumnsRenamed({doc_id: "doc_id", text: "text"})
    docs = docs.drop(*REST, PART).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    dealt = docs.withColumn(PART, part_column("doc_id", parts))
    probes = docs.select("doc_id", "text").mapInArrow(_probe(block, buckets, parts), BLOBS_DDL)
    hits = probes.groupBy("bucket").applyInArrow(_released(_hits(parts)), BLOBS_DDL).withColumnRenamed("bucket", PART)
    windows = dealt.groupBy(PART).cogroup(hits.groupBy(PART)).applyInArrow(_released(_extend(n, block, buckets, parts)), BLOBS_DDL)
    repeats = windows.groupBy("bucket").applyInArrow(_released(_repeats(parts)), BLOBS_DDL).withColumnRenamed("bucket", PART)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
    added = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("removed", ArrayType(span)), StructField("kept_text", StringType())]
    schema = StructType([*(StructField(f.name, f.dataType) for f in docs.schema if keep_text or f.name != "text"), *added])
    again = docs.withColumn(PART, part_column("doc_id", parts))
    return again.groupBy(PART).cogroup(repeats.groupBy(PART)).applyInArrow(_released(_cut(n, to_arrow_schema(schema), text)), schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in textkit.column(batch, "kept_text").to_pylist()]
        shas = [hashlib.sha256(b" ".join(t.encode().split())).hexdigest() for t in texts]
        names = ["doc_id", "n_words", "n_removed"]
        yield pa.RecordBatch.from_arrays([*(textkit.column(batch, c) for c in names), pa.array(shas, pa.string())], names=[*names, "kept_sha256"])


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_repeats(docs, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_text").mapInArrow(_digest, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
