"""Spelling variants of the words of a corpus, by bands of letter-parity masks.

1. Words are counted over all texts: each task sums its own, Spark sums the tasks'.
2. A word's mask has a bit for each letter: whether the word holds it an odd number of times. One edit flips at most two
   bits, so of three bands of the mask at least one is as before. Words meet those of their length and of the next one
   in groups of equal (band, its bits, length).
3. In a group masks are compared before words: words of one length differ in no bit or two, words of neighbouring lengths in
   one bit. What is left is verified letter by letter. A pair counts in the first of its equal bands only.

A group of more than PART_WORDS words is split into parts, and every pair of parts is a group of its own, so a task's
work and memory are bounded however common a band is. Roots are found by pointer doubling over written tables.

Nulls and ties: null text has no words; repeated rows count again; of near words of equal frequency the first in the order
of code points is the form. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.llm import textkit
from lakefold.session import written

LEAST_LETTERS, LEAST_COUNT, FORM_TIMES = 6, 5, 5
SLIP = 199
PART_WORDS = 1 << 15
FLUSH_BYTES = 1 << 24
PAIRS = 1 << 20  # pairs of words or masks compared at once
#: The 26 letters by how often texts use them, so that bands get as many of the telling ones each; only speed depends on it.
OFTEN = "etaoinshrdlucmfwypvbgkjqxz"
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bit of each Latin-1 letter; accented ones share the bits from 26 on.
_BIT = np.zeros(256, dtype=np.uint64)
_BIT[[ord(c) for c in OFTEN]] = np.arange(26)
_BIT[0xC0:] = 26 + np.arange(64) % 36
BANDS = [np.uint64(sum(1 << b for b in range(62) if b % 3 == k)) for k in range(3)]
_CRC = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], dtype=np.uint32)  # one byte's step
_LONG = 64  # bytes from which zlib is quicker than a step for all words at once
CELL = ("band", "bits", "length", "a", "b")
NEAR_DDL = "word string, n bigint, near string, near_n bigint"


def letter_runs(column: pa.Array) -> textkit.Words:
    """Maximal runs of A-Z, a-z and U+00C0-U+00FF (in UTF-8 the bytes C3 80 - C3 BF), A-Z lower-cased."""
    data, at = textkit.text_bytes(column)
    lead = data == 0xC3
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return textkit.Words(_LOWER[data], starts, ends, np.searchsorted(starts, at), at)


def checksums(prefixes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of a prefix (given by its crc32) and the bytes data[start:end], for each."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    state = prefixes[order] ^ np.uint32(0xFFFFFFFF)
    long = int((sizes > _LONG).sum())
    for k in range(int(sizes[long]) if long < len(sizes) else 0):
        live = slice(long, int(np.searchsorted(-sizes, -k)))
        state[live] = _CRC[(state[live] ^ data[starts[live] + k]) & np.uint32(255)] ^ (state[live] >> np.uint32(8))
    out = np.empty(len(order), dtype=np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in order[:long].tolist():
        at = int(np.flatnonzero(order == i)[0])
        out[i] = zlib.crc32(data[starts[at] : starts[at] + sizes[at]].tobytes(), int(prefixes[i]))
    return out


def _packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs of bytes as strings."""
    sizes = ends - starts
    at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[textkit.runs(starts, sizes)])))


def _counted(slip: int):
    """Words of LEAST_LETTERS or more and how often a task meets them, after slips."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            summed = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            held.clear()
            yield from summed.select(["word", "n_sum"]).rename_columns(["word", "n"]).cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches(1 << 16)
            textkit.release_memory()

        for piece in textkit.pieces(batches, "text"):
            words = letter_runs(textkit.column(piece, "text"))
            begins = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
            letters = begins[words.ends] - begins[words.starts]
            long = np.flatnonzero(letters >= LEAST_LETTERS)
            if not len(long):
                continue
            coded = _packed(words.data, words.starts[long], words.ends[long]).dictionary_encode()
            code, text = coded.indices.to_numpy().astype(np.int64), words.text_of_word()[long]
            _, place, count = np.unique(text * len(coded.dictionary) + code, return_index=True, return_counts=True)
            ids = textkit.column(piece, "doc_id")
            prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in ids.to_pylist()], dtype=np.uint32)
            at = long[place]
            h = checksums(prefix[text[place]], words.data, words.starts[at], words.ends[at])
            slips = (h % np.uint32(slip) == 0) & ids.is_valid().to_numpy(zero_copy_only=False)[text[place]]
            n = np.bincount(code[place[~slips]], count[~slips], minlength=len(coded.dictionary)).astype(np.int64)
            held.append(pa.table({"word": coded.dictionary.filter(pa.array(n > 0)), "n": n[n > 0]}))
            changed: list[str] = []
            for i in np.flatnonzero(slips).tolist():
                word = words.data[words.starts[at[i]] : words.ends[at[i]]].tobytes().decode()
                gone = int(h[i]) % len(word)
                changed.append(word[:gone] + word[gone + 1 :])
            held.append(pa.table({"word": pa.array(changed, pa.large_string()), "n": pa.array(count[slips].astype(np.int64), pa.int64())}))
            size += piece.nbytes
            if size >= FLUSH_BYTES:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return run


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """word, n: the words of LEAST_LETTERS code points or more that the texts have least times or more. Where slip divides
    the crc32 of "<doc_id>:<word>", that document's word has lost the code point of that number, counted around; rows
    without an id slip nothing."""
    read = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    met = read.mapInArrow(_counted(slip), "word string, n bigint").where(F.length("word") >= LEAST_LETTERS)
    return met.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def latin(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points below 256 of UTF-8 bytes, and the number of code points before each byte."""
    lead = data == 0xC3
    after = np.zeros(len(data), dtype=bool)
    after[1:] = lead[:-1]
    return np.where(after, data + 0x40, data)[~lead], np.concatenate(([0], np.cumsum(~lead)))


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            data, at = textkit.text_bytes(textkit.column(batch, "word"))
            points, before = latin(data)
            starts = before[at]
            masks = np.bitwise_xor.reduceat(np.uint64(1) << _BIT[points], starts[:-1])
            columns = [*(textkit.column(batch, c) for c in ("word", "n")), pa.array(masks.view(np.int64)), pa.array(np.diff(starts).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "mask", "letters"])


def _mask_pairs(left: np.ndarray, right: np.ndarray, flips: tuple[int, ...], band: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the masks that differ in as many bits as flips says, and in every band before this one."""
    step = max(1, PAIRS // max(1, len(right)))
    for a in range(0, len(left), step):
        x = left[a : a + step, None] ^ right[None]
        near = np.isin(np.bitwise_count(x), flips)
        for k in range(band):
            near &= (x & BANDS[k]) != 0
        i, j = np.nonzero(near)
        yield i + a, j


class _Side:
    """Words of one length, by mask."""

    def __init__(self, table: pa.Table):
        self.n = table["n"].to_numpy()
        masks = table["mask"].to_numpy().view(np.uint64)
        order = np.argsort(masks, kind="stable")
        self.words, self.n = table["word"].take(pa.array(order)), self.n[order]
        self.masks, self.first, self.size = np.unique(masks[order], return_index=True, return_counts=True)
        points, _ = latin(textkit.text_bytes(self.words)[0])
        self.letters = points.reshape(len(order), -1) if len(order) else points.reshape(0, 1)
        ends = self.letters[:, [0, 1, 2, -3, -2, -1]].astype(np.uint32) if len(order) else np.zeros((0, 6), dtype=np.uint32)
        self.head, self.tail = (ends[:, k] << 16 | ends[:, k + 1] << 8 | ends[:, k + 2] for k in (0, 3))


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of a becomes that of b by one replacement, or one insertion where b is longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    head = np.cumprod(a == b[:, :-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    tail = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    return head + tail >= a.shape[1]


def _near(left: _Side, right: _Side, same: bool, flips: tuple[int, ...], band: int) -> Iterator[pa.RecordBatch]:
    """The near words of two sides, each pair once. same: the sides are one."""
    wide = max(1, left.letters.shape[1])
    for i, j in _mask_pairs(left.masks, right.masks, flips, band):
        if same:
            i, j = i[i <= j], j[i <= j]
        rows, of = textkit.runs(left.first[i], left.size[i]), np.repeat(j, left.size[i])
        total = np.cumsum(right.size[of])
        at = 0
        while at < len(rows):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS // wide + 1)))
            size = right.size[of[at:stop]]
            a, b = np.repeat(rows[at:stop], size), textkit.runs(right.first[of[at:stop]], size)
            at = stop
            met = (left.head[a] == right.head[b]) | (left.tail[a] == right.tail[b])
            if same:
                met &= a < b
            a, b = a[met], b[met]
            met = _one_edit(left.letters[a], right.letters[b])
            a, b = a[met], b[met]
            if len(a):
                yield pa.RecordBatch.from_arrays([left.words.take(pa.array(a)).combine_chunks(), pa.array(left.n[a]), right.words.take(pa.array(b)).combine_chunks(), pa.array(right.n[b])], names=["word", "n", "near", "near_n"])


def _compare(table: pa.Table) -> pa.Table:
    """The near words of a cell: words of one length in two parts (or one), and those one letter longer."""
    band, _, _, a, b = (table[c][0].as_py() for c in CELL)
    side = lambda longer, part: _Side(table.filter(pc.and_(pc.equal(table["longer"], longer), pc.equal(table["part"], part))))
    out: list[pa.RecordBatch] = []
    own, other = side(False, a), side(False, b) if a != b else None
    out += _near(own, other or own, other is None, (0, 2), band)
    out += _near(own, side(True, b), False, (1,), band)
    if other:
        out += _near(other, side(True, a), False, (1,), band)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])
    textkit.release_memory()
    return pa.Table.from_batches([r.cast(schema) for r in out], schema=schema)


def near_words(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """word, n, near, near_n: each pair of words (word, n; distinct, letters as in word_counts, three or more) that differ by
    one inserted, deleted or replaced code point, once."""
    masked = words.select("word", "n").mapInArrow(_masked, "word string, n bigint, mask bigint, letters int")
    bands = [F.struct(F.lit(k).alias("band"), F.col("mask").bitwiseAND(F.lit(int(m))).alias("bits"), (F.col("letters") - longer).alias("length"), F.lit(bool(longer)).alias("longer")) for k, m in enumerate(BANDS) for longer in (0, 1)]
    keyed = masked.select("word", "n", "mask", F.explode(F.array(*bands)).alias("k")).select("word", "n", "mask", "k.*")
    large = keyed.groupBy("band", "bits", "length").agg(F.count("*").alias("size")).where(F.col("size") > part_words)
    parts = F.coalesce(F.ceil(F.col("size") / part_words), F.lit(1)).cast("int")
    dealt = keyed.join(large, ["band", "bits", "length"], "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    cells = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"a": F.least("part", "with"), "b": F.greatest("part", "with")})
    cells = cells.select(F.struct(*CELL).alias("cell"), *CELL, "longer", "part", "word", "n", "mask")
    return cells.groupBy("cell").applyInArrow(_compare, NEAR_DDL)


def roots(forms: DataFrame) -> DataFrame:
    """forms: word, form, where a form is never reached from itself. word, root: the form of the form and so on, to the last.
    Steps double each round; ends when no root has a form."""
    links = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = written(links.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-roots")
        links = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return links


def variants(words: DataFrame, times: int = FORM_TIMES) -> DataFrame:
    """words (word, n) with n_near, form, form_n and root: the form is the most frequent near word (of equals the first in the
    order of code points), where it is times as frequent as the word or more."""
    words = written(words.select("word", "n"), "variant-words")
    pairs = near_words(words)
    ways = F.explode(F.array(F.struct("word", F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")).alias("by")), F.struct(F.col("near").alias("word"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("near")).alias("by"))))
    near = pairs.select(ways.alias("w")).groupBy("w.word").agg(F.count("*").alias("n_near"), F.min("w.by").alias("by"))
    has = -F.col("by.less") >= times * F.col("n")
    formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(has, F.col("by.near")).alias("form"), F.when(has, -F.col("by.less")).alias("form_n"))
    formed = written(formed, "variant-forms")
    return formed.join(roots(formed.where("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(word_counts(docs)).select("word", "form", "root", "n", "n_near", "form_n")
