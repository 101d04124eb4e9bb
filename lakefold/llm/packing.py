"""Packing of token-id sequences into length buckets with the least padding, and of buckets into token-budget batches.

Texts become token ids and one end. Documents longer than max_length are cut into segments of max_length and a rest. The
global histogram of segment lengths (at most max_length / multiple rows, whatever the corpus) goes to the driver, where
dynamic programming chooses the bucket lengths: with multiple 1 the padding is the least possible. A batch of bucket b
holds budget // b segments; its sequences are its rows' ids in order of slot, each padded to the bucket's length.

A segment's batch follows from its rank in the bucket. Ranks come from counts per (bucket, block of documents) and ranks
inside a block, so a bucket with a third of all rows is ranked by many tasks.

Nulls and ties: a null text is empty, so its ids are the end alone; a null or negative length (where lengths are given) is
no token and gives one segment of length 0; a null id is an id like others; repeated rows each get their segments, in any
order among equals. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakefold.llm import textkit
from lakefold.llm.unit_encoder import encoder
from lakefold.session import group_count, written

MAX_LENGTH, MULTIPLE, BUCKETS, BUDGET = 2048, 1, 16, 65_536


def bucket_lengths(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most buckets of the lengths (ascending) such that padding each sequence to the next of them is least; of equal
    choices, that with the fewest, then the smallest lengths."""
    n = len(lengths)
    if not n:
        return []
    cumulative = np.concatenate(([0], np.cumsum(counts))).astype(np.float64)
    # cost of a bucket over lengths i .. j: everything in it is as long as lengths[j]
    cost = np.full(n + 1, np.inf)
    cost[0] = 0.0
    choices, totals = [], []
    lower = np.tri(n, k=-1, dtype=bool)
    for _ in range(min(buckets, n)):
        span = cost[:n, None] + (cumulative[None, 1:] - cumulative[:n, None]) * lengths[None, :]
        span[lower] = np.inf
        best = span.argmin(axis=0)
        cost = np.concatenate(([np.inf], span[best, np.arange(n)]))
        choices.append(best)
        totals.append(cost[n])
    k = int(np.argmin(totals))
    out, j = [], n - 1
    for best in reversed(choices[: k + 1]):
        out.append(int(lengths[j]))
        j = int(best[j]) - 1
    return sorted(out)


def segments(docs: DataFrame, doc_id: str, length: Column, max_length: int = MAX_LENGTH) -> DataFrame:
    """Of documents whose lengths are known: doc_id, segment (0, 1...), n_tokens."""
    total = F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("bigint")
    pieces = docs.select(F.col(doc_id).alias("doc_id"), total.alias("total"))
    last = F.greatest(F.ceil(F.col("total") / max_length) - 1, F.lit(0)).cast("int")
    cut = pieces.withColumn("segment", F.explode(F.sequence(F.lit(0), last)))
    return cut.select("doc_id", "segment", F.least(F.lit(max_length), F.col("total") - F.col("segment") * max_length).cast("int").alias("n_tokens"))


SEGMENTS_DDL = "doc_id bigint, segment int, n_tokens int, ids binary"
_SEGMENTS = pa.schema([("doc_id", pa.int64()), ("segment", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary())])


def token_segments(docs: DataFrame, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", max_length: int = MAX_LENGTH) -> DataFrame:
    """doc_id, segment, n_tokens and ids: little-endian unsigned integers of two bytes (four where the vocabulary has more
    than 65,536 entries). The end id is the last of a document's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for piece in textkit.pieces(batches, "text"):
            ids, at = enc.encode(textkit.column(piece, "text"))
            ids = np.insert(ids, at[1:], enc.dtype.type(end_id))
            at = at + np.arange(len(at))
            many = -(-np.diff(at) // max_length)
            row = np.repeat(np.arange(piece.num_rows), many)
            segment = textkit.runs(np.zeros(len(many), dtype=np.int64), many)
            begins = at[:-1][row] + segment * max_length
            ends = np.minimum(begins + max_length, at[1:][row])
            raw, size = ids.tobytes(), enc.dtype.itemsize
            parts = [raw[a * size : b * size] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            names = textkit.column(piece, "doc_id").take(pa.array(row))
            yield pa.record_batch([names, pa.array(segment, pa.int32()), pa.array(ends - begins, pa.int32()), pa.array(parts, pa.binary())], schema=_SEGMENTS)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SEGMENTS_DDL)


def pack(found: DataFrame, multiple: int = MULTIPLE, buckets: int = BUCKETS, budget: int = BUDGET, blocks: int | None = None) -> DataFrame:
    """A row per segment: its columns (doc_id, segment, n_tokens and, if it has them, ids), bucket_length, batch (in its
    bucket) and slot (in its batch)."""
    spark = found.sparkSession
    found = written(found, "segments")  # texts are encoded once
    own = found.columns
    padded = (F.ceil(F.greatest("n_tokens", F.lit(1)) / multiple) * multiple).cast("int")
    histogram = sorted((r.length, r.n) for r in found.groupBy(padded.alias("length")).agg(F.count("*").alias("n")).collect())
    lengths = bucket_lengths(np.array([h[0] for h in histogram]), np.array([h[1] for h in histogram]), buckets)
    if not lengths:
        return found.select(*own, F.lit(0).alias("bucket_length"), F.lit(0).cast("bigint").alias("batch"), F.lit(0).alias("slot")).limit(0)
    bucket = F.lit(lengths[-1])
    for b in reversed(lengths[:-1]):
        bucket = F.when(F.col("n_tokens") <= b, b).otherwise(bucket)
    blocks = blocks or 4 * group_count(found)
    found = found.withColumn("bucket_length", bucket).withColumn("block", F.pmod(F.xxhash64("doc_id", "segment"), F.lit(blocks)))
    counts = found.groupBy("bucket_length", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("bucket_length").orderBy("block")) - F.col("n")
    starts = counts.select("bucket_length", "block", before.alias("before"))  # at most buckets x blocks rows
    inside = F.row_number().over(Window.partitionBy("bucket_length", "block").orderBy("doc_id", "segment", "n_tokens"))
    ranked = found.withColumn("inside", inside).join(F.broadcast(starts), ["bucket_length", "block"])
    rank = F.col("before") + F.col("inside") - 1
    capacity = F.greatest(F.lit(1), F.expr(f"{budget} div bucket_length"))
    return ranked.select(*own, "bucket_length", F.floor(rank / capacity).cast("bigint").alias("batch"), F.pmod(rank, capacity).cast("int").alias("slot"))


def pack_texts(docs: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """pack() over the token ids of docs (doc_id, text), in the byte-level vocabulary of 50,257 entries and its end id."""
    import public_tokenizers

    return pack(token_segments(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, max_length=max_length))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of token ids, and the batches that they are in."""
    return pack_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
