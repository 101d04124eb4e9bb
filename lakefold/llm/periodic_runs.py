"""Periodic runs of words by heavy and light lag counts.

A run is a stretch of consecutive words with smallest period q, at least max(LEAST, REPEATS * q) words long, that no
neighbouring word extends keeping that period.

1. Every word of a run stands in it REPEATS times or more, so texts are cut at words that are rarer in their stretch,
   again and again until nothing falls out. What is left are segments; no run crosses their edges.
2. For every lag q of a segment the pairs of equal words q apart are counted: by exact autocorrelation (one real FFT for
   each word, whole numbers again after rounding) for words more frequent than the root of the segment's length times its
   logarithm, by differences of positions for the others.
3. A run of period q has at least max(LEAST, REPEATS * q) - q such pairs, next to each other. Lags with fewer are done;
   so are those whose pairs belong to runs of a smaller period (a run of period d is one of period 2d, 3d... too, with a
   known number of pairs). Only the other lags get an island scan: first on a grid so fine that a long enough island
   holds many of its points, then word by word where a row of grid points agrees.

A text is a task's own work, in memory linear in its words; nothing is shuffled.

Nulls and ties: a null text has no words; an empty text no runs; repeated rows each get a row; extra columns stay, and
columns named n_words, runs or kept_text are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.llm import textkit

LEAST, REPEATS = 6, 4
GRID = 8  # grid points of an island scan to a period
PAIRS = 1 << 22  # position differences held at once
ADDED = {"n_words": "bigint", "runs": "array<struct<start:bigint,length:bigint,period:bigint>>", "kept_text": "string"}


def word_codes(words: textkit.Words) -> np.ndarray:
    """A number for each word, the same for equal words (exact: no hashes)."""
    sizes = words.ends - words.starts
    at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    packed = words.data[textkit.runs(words.starts, sizes)]
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(packed))])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _edges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    step = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0]))))
    return step[::2], step[1::2]


def segments(codes: np.ndarray, text_of: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches, within a text each, whose words all stand in them repeats times or more."""
    at = np.arange(len(codes))
    stretch = text_of
    while len(at):
        _, group, count = np.unique(stretch * (codes.max() + 1) + codes[at], return_inverse=True, return_counts=True)
        keep = count[group] >= repeats
        new = np.concatenate(([True], (np.diff(at[keep]) != 1) | (np.diff(stretch[keep]) != 0))) if keep.any() else np.zeros(0, dtype=bool)
        at, stretch = at[keep], np.cumsum(new) - 1
        long = np.bincount(stretch, minlength=1)[stretch] >= least if len(at) else np.zeros(0, dtype=bool)
        done = keep.all() and long.all()
        at, stretch = at[long], stretch[long]
        if done:
            break
    if not len(at):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate(([True], np.diff(stretch) != 0)))
    return at[first], at[np.concatenate((first[1:] - 1, [len(at) - 1]))] + 1


def lag_counts(codes: np.ndarray, most: int) -> np.ndarray:
    """How many positions i have codes[i] == codes[i + q], for each q up to most (index q; index 0 is 0)."""
    n = len(codes)
    out = np.zeros(most + 1, dtype=np.int64)
    heavy_from = np.sqrt(n * max(1.0, np.log2(n)))
    count = np.bincount(codes)
    heavy = np.flatnonzero(count > heavy_from)
    if len(heavy):
        size = 1 << int(n + most).bit_length()
        power = np.zeros(size // 2 + 1)
        for word in heavy:
            f = np.fft.rfft(codes == word, size)
            power += f.real**2 + f.imag**2
        out += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    light = np.flatnonzero(count[codes] <= heavy_from)
    light = light[np.argsort(codes[light], kind="stable")]
    block = max(1, PAIRS)
    for a in range(0, len(light), block):
        place = np.arange(a, min(a + block, len(light)))
        for k in range(1, int(heavy_from) + 1):
            place = place[place + k < len(light)]
            near = (codes[light[place]] == codes[light[np.minimum(place + k, len(light) - 1)]]) if len(place) else np.zeros(0, dtype=bool)
            place = place[near]
            gap = light[place + k] - light[place]
            place, gap = place[gap <= most], gap[gap <= most]  # later occurrences are farther still
            if not len(place):
                break
            out += np.bincount(gap, minlength=most + 1)
    out[0] = 0
    return out


def _islands(codes: np.ndarray, q: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches of i with codes[i] == codes[i + q], of shortest or more."""
    step = q // GRID
    for s in (step, step - 1, 5 * step // 8) if step > 2 else ():  # another period agrees with few of them
        a, b = _edges(codes[: len(codes) - q : s] == codes[q::s])
        if not (b - a >= shortest // s).any():
            return a[:0], b[:0]
    a, b = _edges(codes[:-q] == codes[q:])
    return a[b - a >= shortest], b[b - a >= shortest]


def segment_runs(codes: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a segment."""
    n = len(codes)
    most = n // repeats
    counts = lag_counts(np.unique(codes, return_inverse=True)[1], most)
    lags = np.arange(most + 1)
    shortest = np.maximum(least, repeats * lags) - lags
    found: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()
    for q in (np.flatnonzero(counts[1:] >= shortest[1:]) + 1).tolist():
        if counts[q] < shortest[q]:
            continue
        for a, b in zip(*_islands(codes, q, int(shortest[q])), strict=True):
            start, length = int(a), int(b - a) + q
            if (start, length) in known:  # its smallest period is a smaller one
                continue
            known.add((start, length))
            found.append((start, length, q))
            multiples = lags[2 * q : min(most, length // 2) + 1 : q]
            counts[multiples] -= length - multiples
    return found


def text_runs(words: textkit.Words, least: int = LEAST, repeats: int = REPEATS) -> tuple[list[list[tuple[int, int, int]]], np.ndarray]:
    """The runs of each text by start, then period (word numbers from 0), and which of all words are not repetitions."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in words.counts]
    change = np.zeros(len(words.starts) + 1, dtype=np.int32)
    if len(words.starts):
        codes, text_of = word_codes(words), words.text_of_word()
        for a, b in zip(*segments(codes, text_of, least, repeats), strict=True):
            text = int(text_of[a])
            for start, length, period in segment_runs(codes[a:b], least, repeats):
                out[text].append((int(a - words.word_at[text]) + start, length, period))
                change[a + start + period] += 1
                change[a + start + length] -= 1
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out], np.cumsum(change[:-1]) == 0


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """docs without the text, with n_words, runs (start and length in words, and period; by start, then period) and
    kept_text: the words that no run repeats, that is all but those in a run after its first period, joined by one space."""
    kept = [f for f in docs.schema if f.name not in (text, *ADDED)]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} {t}" for n, t in ADDED.items())])
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in textkit.pieces(batches, text):
            words = textkit.words_of(textkit.column(piece, text))
            found, stays = text_runs(words, least, repeats)
            raw, texts = words.data.tobytes(), []
            for i, (a, b) in enumerate(zip(words.word_at[:-1].tolist(), words.word_at[1:].tolist(), strict=True)):
                if found[i]:
                    at = np.flatnonzero(stays[a:b]) + a
                    texts.append(b" ".join([raw[s:e] for s, e in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)]).decode())
                else:
                    texts.append(b" ".join(raw[words.text_at[i] : words.text_at[i + 1]].split()).decode())
            runs = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found], run_type)
            columns = [*(textkit.column(piece, f.name) for f in kept), pa.array(words.counts, pa.int64()), runs, pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), *ADDED])

    return docs.select(*(f"`{f.name}`" for f in kept), text).mapInArrow(run, ddl)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and the text with the periods that the contract plants: where crc32(doc_id) is divisible by ten, the words from
    number a on repeat the p words from a."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    g = F.floor(h / 10)
    split = docs.select("doc_id", "text", F.when(chosen, words).alias("w"), g.alias("g")).withColumn("n", F.size("w").cast("bigint"))
    shaped = split.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("bigint"))
    repeated = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda i: F.element_at("w", (F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")) + 1).cast("int")))
    return shaped.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    best = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("best"), F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").alias("lines"), "kept_text")
    return best.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )
