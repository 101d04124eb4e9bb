"""Quality rules: plain text statistics, and a hashed n-gram logistic regression with calibrated probabilities.

The model is linear in the shares of hashed word n-grams (1, 2) and character n-grams (1, 3, 4) of a text, so a text is
scored by gathering weights: no feature vector is made, and a score depends on its text alone, to the last bit. It is
trained on at most SAMPLE labelled rows of each class (those with the smallest hash of doc_id) as sparse rows, calibrated
on the fifth of them that training leaves out, and moved to the class shares of all labels. A second model, from at most
TOXIC_SAMPLE rows of each class, finds toxic texts by words (and beginnings of words) that labelled toxic ones have much
more often: one such word is enough, however long the text. Batches are scored in Arrow against fixed thresholds.

Nulls and ties: a null text has no words and fails the base rules; labels without a quality or a document are left out; a
document with several labels has the lowest quality, and is toxic if one says so; of documents with the same id the one
with the smallest text is learnt. Without quality labels of both classes every text that passes the base rules is kept;
without toxic ones of both classes, or words that tell them apart, none is read as toxic. Repeated rows each get a row.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.llm import textkit

SAMPLE = 1000
BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS
WORD_ORDERS = (1, 2)
CHAR_ORDERS = (1, 3, 4)
GROUPS = len(WORD_ORDERS) + len(CHAR_ORDERS)
UNIT = 1 << 20
KEEP_AT = 0.5
TOXIC_AT = 0.5
#: What makes a word telling: standard errors by which it is more frequent in toxic texts, and the share of toxic ones
#: among texts that have it, if both kinds were as many.
LEAST_Z, LEAST_SHARE = 4.0, 0.9
TOXIC_SAMPLE = 2000
PREFIX = 4
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20
REPEAT_WINDOW = 5
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: ASCII punctuation becomes space.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[b for b in range(33, 127) if not chr(b).isalnum()]] = 0x20


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]]."""
    return textkit.segment_sums(values, at[:-1], at[1:])


def grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each group of features: bucket of each n-gram, and where those of each text begin and end. An n-gram never
    reaches into the next text."""
    words = textkit.words_of(texts)
    hashes = words.hashes()
    for n in WORD_ORDERS:
        starts = textkit.window_starts(words, n)
        values = textkit.windows(hashes, n)[starts] if len(starts) else np.zeros(0, dtype=np.uint64)
        at = np.searchsorted(starts, words.word_at)
        yield (values & np.uint64(BUCKETS - 1)).astype(np.int32), at[:-1], at[1:]
    characters, at = textkit.characters(words.data, words.text_at)
    for n in CHAR_ORDERS:
        size = max(0, len(characters) - n + 1)
        values = np.zeros(size, dtype=np.uint32)
        for k in range(n):
            values *= np.uint32(0x01000193)
            values += characters[k : k + size]
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x9E3779B1)
        yield (values >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), at[:-1], np.maximum(at[:-1], at[1:] - n + 1)


@dataclass
class Model:
    """weights: GROUPS x BUCKETS, of shares, in units of 1 / UNIT, so that sums over a text are exact in any order;
    probability = 1 / (1 + exp(-(slope * margin + offset)))."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    toxic: Toxic | None = None

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        margin = np.full(len(texts), self.bias)
        for table, (buckets, begins, ends) in zip(self.weights, grams(texts), strict=True):
            margin += textkit.segment_sums(table[buckets], begins, ends) / (UNIT * np.maximum(1.0, ends - begins))
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -50, 50)))


@dataclass
class Rows:
    """Shares of each bucket that a text has, a sparse row per text: rows ascend."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    n: int

    def times(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * weight[self.column], minlength=self.n)

    def back(self, gap: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=self.value * gap[self.row], minlength=GROUPS * BUCKETS)

    def scaled(self, scale: np.ndarray) -> Rows:
        return Rows(self.row, self.column, self.value / scale[self.column], self.n)

    def only(self, chosen: np.ndarray) -> Rows:
        keep = chosen[self.row]
        return Rows((np.cumsum(chosen) - 1)[self.row[keep]].astype(np.int32), self.column[keep], self.value[keep], int(chosen.sum()))


def features(texts: pa.Array) -> Rows:
    """For training: a text at a time, so only the texts' own buckets are held."""
    rows, columns, values = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.float32)]
    for i in range(len(texts)):
        for g, (buckets, _, _) in enumerate(grams(texts.slice(i, 1))):
            found, n = np.unique(buckets, return_counts=True)
            rows.append(np.full(len(found), i, dtype=np.int32))
            columns.append((found + g * BUCKETS).astype(np.int32))
            values.append((n / max(1, len(buckets))).astype(np.float32))
    return Rows(np.concatenate(rows), np.concatenate(columns), np.concatenate(values), len(texts))


def _logistic(x: Rows | np.ndarray, y: np.ndarray, penalty: float, steps: int = 200) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression by gradient steps with momentum; the step is set by the Lipschitz bound. x: rows,
    or one column."""
    sparse = isinstance(x, Rows)
    times = x.times if sparse else lambda w: x * w[0]
    back = x.back if sparse else lambda g: np.array([x @ g])
    width = GROUPS * BUCKETS if sparse else 1
    weight, bias = np.zeros(width), 0.0
    speed, bias_speed = np.zeros(width), 0.0
    v = np.ones(width)
    for _ in range(8):
        v = back(times(v))
        v /= np.linalg.norm(v) + 1e-12
    top = float(np.linalg.norm(times(v)) ** 2) / len(y) / 4 + penalty + 0.25
    for _ in range(steps):
        gap = 1 / (1 + np.exp(-np.clip(times(weight) + bias, -50, 50))) - y
        speed = 0.9 * speed - (back(gap) / len(y) + penalty * weight) / top
        bias_speed = 0.9 * bias_speed - float(gap.mean()) / top
        weight, bias = weight + speed, bias + bias_speed
    return weight, bias


def _calibrated(margin: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset of the probability, for a class that has this share of all labels."""
    spread = float(np.abs(margin).mean()) or 1.0
    (slope,), offset = _logistic(margin / spread, y, 1e-3, 2000)
    return slope / spread, offset + np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))


def fit(texts: pa.Array, good: np.ndarray, share_good: float) -> Model | None:
    """share_good: of all labels, for the prior."""
    if len(good) < 10 or good.min() == good.max():
        return None
    held = np.arange(len(good)) % 5 == 4
    if good[held].min() == good[held].max() or good[~held].min() == good[~held].max():
        held[:] = False
    x = features(texts)
    learns = x.only(~held)
    scale = np.sqrt(np.bincount(learns.column, weights=learns.value.astype(np.float64) ** 2, minlength=GROUPS * BUCKETS) / learns.n) + 1e-4
    weight, bias = _logistic(learns.scaled(scale), good[~held], 1e-2)
    whole = np.rint(weight / scale * UNIT).astype(np.int64)
    margin, y = (x.times(whole / UNIT) + bias)[held if held.any() else ~held], good[held if held.any() else ~held]
    return Model(whole.reshape(GROUPS, BUCKETS), bias, *_calibrated(margin, y, share_good))


@dataclass
class Toxic:
    """Words (hashes, sorted) that speak for toxicity, and their weights; a text's margin is the greatest of them, since one
    such word is enough and many forms of one word say no more."""

    words: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def margins(self, texts: pa.Array) -> np.ndarray:
        text, hashes = plain_words(texts)
        where = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        at = np.flatnonzero(self.words[where] == hashes)
        out = np.zeros(len(texts))
        np.maximum.at(out, text[at], self.weights[where[at]])
        return out

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.offset, -50, 50)))


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words without ASCII punctuation, and the first PREFIX bytes of those that are longer: text and hash of
    each, as pairs."""
    words = textkit.words_of(pc.utf8_lower(texts), PLAIN)
    text = words.text_of_word()
    longer = np.flatnonzero(words.ends - words.starts > PREFIX)
    cut = textkit.Words(words.data, words.starts[longer], words.starts[longer] + PREFIX, words.word_at, words.text_at)
    return np.concatenate((text, text[longer])), np.concatenate((words.hashes(), textkit.mix(cut.hashes())))


def fit_toxic(texts: pa.Array, toxic: np.ndarray, share_toxic: float) -> Toxic | None:
    """share_toxic: of all labels, for the prior. Weights are log odds."""
    if len(toxic) < 10 or toxic.min() == toxic.max():
        return None
    each = [np.unique(plain_words(texts.slice(i, 1))[1]) for i in range(len(texts))]  # a text at a time, so only distinct words are held
    text = np.repeat(np.arange(len(each)), [len(e) for e in each])
    known, which = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *each]), return_inverse=True)
    if not len(known):
        return None

    def learned(rows: np.ndarray) -> Toxic | None:
        n = [int((rows & (toxic == v)).sum()) for v in (0, 1)]
        has = [np.bincount(which[(rows & (toxic == v))[text]], minlength=len(known)) for v in (0, 1)]
        p = (has[0] + has[1]) / max(1, sum(n))
        z = (has[1] / max(1, n[1]) - has[0] / max(1, n[0])) / np.sqrt(p * (1 - p) * (1 / max(1, n[0]) + 1 / max(1, n[1])) + 1e-12)
        share = [(h + 0.5) / (k + 1) for h, k in zip(has, n, strict=True)]
        speak = (z >= LEAST_Z) & (has[1] >= 2) & (share[1] >= LEAST_SHARE * (share[0] + share[1]))
        weight = [np.log((h + 0.5) / (k - h + 0.5)) for h, k in zip(has, n, strict=True)]
        return Toxic(known[speak], (weight[1] - weight[0])[speak], 1.0, 0.0) if speak.any() else None

    held = np.arange(len(toxic)) % 5 == 4
    if toxic[held].min() == toxic[held].max() or toxic[~held].min() == toxic[~held].max():
        held[:] = False
    model, y = learned(~held), toxic[held] if held.any() else toxic
    if model is None:
        return None
    margin = model.margins(texts.filter(pa.array(held)) if held.any() else texts)
    return Toxic(model.words, model.weights, *_calibrated(margin, y, share_toxic))


QUALITY, TOXIC = 0, 1
TRAINED_DDL = "kind int, weights binary, words binary, bias double, slope double, offset double"


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, toxic: str = "toxic", toxic_sample: int = TOXIC_SAMPLE) -> Model | None:
    """The model, from at most sample labelled rows of each class; of toxicity too, from at most toxic_sample, where labels
    have that column. Each fit runs in one executor task over its sample."""

    def known(name: str, value: Column) -> DataFrame:
        found = labels.where(F.col(name).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(value.alias("yes"))
        return found.withColumn("order", F.xxhash64("doc_id"))

    tables = {QUALITY: known(label, F.min(label) >= 1)}
    if toxic in labels.columns:
        tables[TOXIC] = known(toxic, F.max(toxic) >= 1)
    shares, parts = {}, []
    for kind, found in tables.items():
        counts = {r.yes: r.n for r in found.groupBy("yes").agg(F.count("*").alias("n")).collect()}
        if len(counts) == 2:
            shares[kind] = counts[True] / sum(counts.values())
            size = sample if kind == QUALITY else toxic_sample
            parts += [found.where(F.col("yes") == v).orderBy("order", "doc_id").limit(size).withColumn("kind", F.lit(kind)) for v in (True, False)]
    if QUALITY not in shares:
        return None
    chosen = F.broadcast(reduce(DataFrame.unionByName, parts))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(chosen, "doc_id")
    rows = rows.groupBy("kind", "order", "doc_id", "yes").agg(F.min("text").alias("text"))  # a row for each label, however often its id stands in docs

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
        kind, texts, yes = table["kind"][0].as_py(), table["text"].combine_chunks(), np.asarray(table["yes"]).astype(np.float64)
        model = (fit if kind == QUALITY else fit_toxic)(texts, yes, shares[kind])
        row = {} if model is None else {"kind": kind, "weights": model.weights.tobytes(), "words": b"" if kind == QUALITY else model.words.tobytes()}
        row |= {} if model is None else {"bias": float(model.bias) if kind == QUALITY else 0.0, "slope": float(model.slope), "offset": float(model.offset)}
        types = {"kind": pa.int32(), "weights": pa.binary(), "words": pa.binary(), "bias": pa.float64(), "slope": pa.float64(), "offset": pa.float64()}
        return pa.table({k: pa.array([row[k]] if row else [], t) for k, t in types.items()})

    found = {r.kind: r for r in rows.groupBy("kind").applyInArrow(one, TRAINED_DDL).collect()}
    if QUALITY not in found:
        return None
    r, t = found[QUALITY], found.get(TOXIC)
    words = Toxic(np.frombuffer(t.words, dtype=np.uint64), np.frombuffer(t.weights), t.slope, t.offset) if t else None
    return Model(np.frombuffer(r.weights, dtype=np.int64).reshape(GROUPS, BUCKETS), r.bias, r.slope, r.offset, words)


def repeated_words(words: textkit.Words, n: int = REPEAT_WINDOW) -> np.ndarray:
    """For each text: words covered by windows of n words that the text has twice or more."""
    starts = textkit.window_starts(words, n)
    cover = np.zeros(len(words.starts) + 1, dtype=np.int32)
    if len(starts):
        keys = textkit.mix(textkit.windows(words.hashes(), n)[starts] + textkit.mix(words.text_of_word()[starts].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        found = np.zeros(len(starts), dtype=bool)
        found[order[1:][same]] = True
        found[order[:-1][same]] = True
        np.add.at(cover, starts[found], 1)
        np.add.at(cover, starts[found] + n, -1)
    return _sums((np.cumsum(cover[:-1]) > 0).astype(np.int64), words.word_at)


def duplicate_lines(words: textkit.Words) -> np.ndarray:
    """For each text: lines with a word that equal an earlier line."""
    out = np.zeros(len(words.text_at) - 1, dtype=np.int64)
    for i in range(len(out)):
        lines = words.data[words.text_at[i] : words.text_at[i + 1]].tobytes().split(b"\n")
        if len(lines) > 1:
            held = [x for x in lines if x and not x.isspace()]
            out[i] = len(held) - len(set(held))
    return out


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    words = textkit.words_of(texts)
    begins = (words.data & 0xC0) != 0x80
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": _sums((begins & ~textkit.SPACE[words.data]).astype(np.int64), words.text_at),
        "n_symbols": _sums(SYMBOLS[words.data].astype(np.int64), words.text_at),
        "n_dup_lines": duplicate_lines(words),
        "n_repeat_words": repeated_words(words),
    }


def verdicts(texts: pa.Array, model: Model | None, keep_at: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, base_failed, p_good, p_toxic and kept of each text."""
    stats = statistics(texts)
    failed = (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEATED_PERCENT * stats["n_words"])
    good = model.probabilities(texts) if model else np.ones(len(texts))
    toxic = model.toxic.probabilities(texts) if model and model.toxic else np.zeros(len(texts))
    return stats, failed, good, toxic, ~failed & (good >= keep_at) & (toxic < TOXIC_AT)


def keep(docs: DataFrame, model: Model | None, text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs that are kept, with all their columns, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in textkit.pieces(batches, text):
            yield piece.filter(pa.array(verdicts(textkit.column(piece, text), model, keep_at)[-1]))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model | None, text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """docs with the statistics, base_failed, p_good and kept added; columns of those names are replaced."""
    added = [*STATS, "base_failed", "p_good", "p_toxic", "kept"]
    docs = docs.drop(*[a for a in added if a != text])
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{s} bigint" for s in STATS), "base_failed boolean", "p_good double", "p_toxic double", "kept boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in textkit.pieces(batches, text):
            stats, failed, good, toxic, kept = verdicts(textkit.column(piece, text), model, keep_at)
            columns = [*piece.columns, *(pa.array(stats[s]) for s in STATS), pa.array(failed), pa.array(good), pa.array(toxic), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, names=[*piece.schema.names, *added])

    return docs.mapInArrow(run, ddl)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return score(docs, train(docs, labels)).drop("text")
