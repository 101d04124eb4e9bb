"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Words are those of the lower-cased text with ASCII punctuation read as space. Each run of SEED words of a test item is
a seed, however many documents have it: which documents are reported does not depend on the other documents. Where a
document has a seed, the words around it, as far as the gaps of a passing score reach, are aligned with the item, unless they have too few of its words for any
alignment to pass; the score is the best local alignment's as a share of a perfect one. Edited and paraphrased copies
keep some seeds and lose some score.

The items are the query set: they go to the tasks as arrays in blocks of at most BLOCK_ITEMS items, which end when they
have BLOCK_CHARS characters, each block a pass over all documents; documents are never grouped or moved.

Nulls and ties: null text (document or item) has no words and meets nothing; an item of fewer than SEED words has itself
as its seed; rows with a null id are treated like others; repeated rows each get their pairs, repeated items too. Of
alignments with equal scores the first place is reported. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.llm import textkit

SEED = 3
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST = 0.5
#: Bounds of a block of items, which goes to every task.
BLOCK_ITEMS, BLOCK_CHARS = 100_000, 32 << 20
FILTER_BITS = 22
#: ASCII punctuation becomes space.
TABLE = np.arange(256, dtype=np.uint8)
TABLE[[b for b in range(33, 127) if not chr(b).isalnum()]] = 0x20


def word_hashes(texts: pa.Array) -> tuple[textkit.Words, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    words = textkit.words_of(pc.utf8_lower(texts.fill_null("")), TABLE)
    return words, words.hashes()


@dataclass
class Items:
    """A block of test items. Runs are sorted by hash; of equal hashes each (item, place) is an entry."""

    ids: list[int | None]
    words: list[np.ndarray]
    runs: np.ndarray
    of: np.ndarray
    place: np.ndarray

    def __post_init__(self) -> None:
        self.word_counts = np.array([len(w) for w in self.words], dtype=np.int64)
        self._known: dict[int, np.ndarray] = {}

    def known(self, i: int) -> np.ndarray:
        """An item's distinct words, ascending."""
        if i not in self._known:
            self._known[i] = np.unique(self.words[i])
        return self._known[i]

    @classmethod
    def of_texts(cls, ids: list[int | None], texts: list[str | None]) -> Items:
        words, hashes = word_hashes(pa.array(texts, pa.string()))
        per = [hashes[a:b] for a, b in zip(words.word_at[:-1], words.word_at[1:], strict=True)]
        runs, of, place = [np.zeros(0, dtype=np.uint64)], [], []
        for i, w in enumerate(per):
            n = min(SEED, len(w))
            if n:
                found = textkit.windows(w, n)
                runs.append(found)
                of += [i] * len(found)
                place += range(len(found))
        runs = np.concatenate(runs)
        order = np.argsort(runs, kind="stable")
        return cls(ids, per, runs[order], np.array(of, dtype=np.int64)[order], np.array(place, dtype=np.int64)[order])

    def sizes(self) -> list[int]:
        """Lengths of runs: SEED, and those of shorter items."""
        return sorted({min(SEED, len(w)) for w in self.words if len(w)})


class Finder:
    """Where a text has one of the runs."""

    def __init__(self, items: Items):
        self.distinct = np.unique(items.runs)
        self.sizes = items.sizes()
        self.bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.bits[(self.distinct & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True

    def find(self, words: textkit.Words, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Word positions, and the runs (places in distinct) that begin there."""
        if not len(self.distinct):
            return
        for n in self.sizes:
            found = textkit.windows(hashes, n)
            at = np.flatnonzero(self.bits[(found & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
            where = np.minimum(np.searchsorted(self.distinct, found[at]), len(self.distinct) - 1)
            good = self.distinct[where] == found[at]
            at, where = at[good], where[good]
            ends = words.word_at[np.searchsorted(words.word_at, at, side="right")]
            inside = at + n <= ends
            yield at[inside], where[inside]


def align(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: the best local score, and the region's words [start, end) that it covers."""
    n = len(region)
    steps = np.arange(n + 1) * -GAP
    score = np.zeros(n + 1, dtype=np.int64)
    start = np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        diagonal = score[:-1] + np.where(region == w, MATCH, MISMATCH)
        down = score[1:] + GAP
        new = np.zeros(n + 1, dtype=np.int64)
        begin = np.arange(n + 1)
        take = diagonal >= down
        new[1:] = np.maximum(np.where(take, diagonal, down), 0)
        begin[1:] = np.where(new[1:] > 0, np.where(take, start[:-1], start[1:]), begin[1:])
        reach = new + steps  # a gap in the item: the best cell to the left, less its distance
        ahead = np.maximum.accumulate(reach)
        from_left = ahead > reach
        source = np.maximum.accumulate(np.where(reach == ahead, np.arange(n + 1), 0))
        new = np.where(from_left, ahead - steps, new)
        begin = np.where(from_left, begin[source], begin)
        score, start = new, begin
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (int(score[top]), int(start[top]), top)
    return best


def may_pass(known: np.ndarray, length: int, region: np.ndarray, least: float) -> bool:
    """False only where no alignment of an item of length words, known when sorted, has a score of least: each match
    takes a word of the region that the item has."""
    where = np.minimum(np.searchsorted(known, region), len(known) - 1)
    return np.count_nonzero(known[where] == region) >= least * length - 1e-9


def gaps(length: int, least: float) -> int:
    """Words that gaps of an alignment with a score of least can have: what a perfect score has to spare."""
    return max(0, math.floor(length * MATCH * (1 - least) / -GAP + 1e-9))


FOUND_DDL = "doc_id bigint, item_id bigint, score double, word_start int, word_end int"


def _passes(items: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    """The items, in blocks. Blocks are read one by one, so the driver holds one at a time."""
    chosen = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    ids, texts, size = [], [], 0
    for r in chosen.orderBy("id", "text").toLocalIterator():
        ids.append(r.id)
        texts.append(r.text)
        size += len(r.text or "")
        if len(ids) >= BLOCK_ITEMS or size >= BLOCK_CHARS:
            yield Items.of_texts(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items.of_texts(ids, texts)


def candidates(items: Items, finder: Finder, words: textkit.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, item and diagonal of each run of an item that a text has, each once, in this order."""
    first = np.searchsorted(items.runs, finder.distinct)
    many = np.searchsorted(items.runs, finder.distinct, side="right") - first
    found = [np.zeros((0, 3), dtype=np.int64)]
    for at, which in finder.find(words, hashes):
        n = many[which]
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[which], n)
        at = np.repeat(at, n)
        found.append(np.stack((np.searchsorted(words.word_at, at, side="right") - 1, items.of[entry], at - items.place[entry]), axis=1))
    text, of, diagonal = np.concatenate(found).T
    order = np.lexsort((diagonal, of, text))
    text, of, diagonal = text[order], of[order], diagonal[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (of[1:] != of[:-1]) | (diagonal[1:] != diagonal[:-1])
    return text[new], of[new], diagonal[new]


def _best(items: Items, finder: Finder, least: float, texts: pa.Array) -> list[tuple[int, int, float, int, int]]:
    """Text, item, score and place (words of the text) of the best alignment of each text and item that reaches least."""
    words, hashes = word_hashes(texts)
    text, of, diagonal = candidates(items, finder, words, hashes)
    size = items.word_counts
    cut = np.ones(len(text), dtype=bool)
    cut[1:] = (text[1:] != text[:-1]) | (of[1:] != of[:-1]) | (np.diff(diagonal) > size[of[1:]])
    begins = np.flatnonzero(cut)
    ends = np.concatenate((begins[1:], [len(text)]))[: len(begins)] - 1
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for t, i, low, high in zip(text[begins].tolist(), of[begins].tolist(), diagonal[begins].tolist(), diagonal[ends].tolist(), strict=True):
        begin, end = int(words.word_at[t]), int(words.word_at[t + 1])
        item = items.words[i]
        slack = gaps(len(item), least)
        a, b = max(begin, low - slack), min(end, high + len(item) + slack)
        if not may_pass(items.known(i), len(item), hashes[a:b], least):
            continue
        s, x, y = align(item, hashes[a:b])
        if s > best.get((t, i), (0, 0, 0))[0]:
            best[t, i] = (s, a + x - begin, a + y - begin)
    shares = ((t, i, s / (MATCH * len(items.words[i])), x, y) for (t, i), (s, x, y) in best.items())
    return [r for r in shares if r[2] >= least]


def _search(items: Items, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(items)
        for piece in textkit.pieces(batches, "text"):
            ids = textkit.column(piece, "doc_id").cast(pa.int64()).to_pylist()
            rows = [(ids[t], items.ids[i], share, x, y) for t, i, share, x, y in _best(items, finder, least, textkit.column(piece, "text"))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array(list(c), type=k) for c, k in zip(columns, types, strict=True)], names=["doc_id", "item_id", "score", "word_start", "word_end"])

    return run


def _without(items: Items, least: float, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(items)
        for piece in textkit.pieces(batches, text):
            clean = np.ones(piece.num_rows, dtype=bool)
            clean[[r[0] for r in _best(items, finder, least, textkit.column(piece, text))]] = False
            yield piece.filter(pa.array(clean))

    return run


def clean(docs: DataFrame, items: DataFrame, least: float = LEAST, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs in which no item is found, with all their columns. Each row is judged by its own text, whatever
    its id; no row is moved."""
    for block in _passes(items, item_id, item_text):
        docs = docs.mapInArrow(_without(block, least, text), docs.schema)
    return docs


def find_leaks(docs: DataFrame, items: DataFrame, least: float = LEAST, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item with a score of least or more: doc_id, item_id, score, and the words [word_start,
    word_end) of the document that the best alignment covers."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = None
    for block in _passes(items, item_id, item_text):
        part = docs.mapInArrow(_search(block, least), FOUND_DDL)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], FOUND_DDL) if found is None else found


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
