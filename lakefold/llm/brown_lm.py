"""Brown class-based bigram language model.

P(text) is the product over its tokens (lower-cased words, then one end) of P(class | class before) P(word | class).
Classes come in three steps, all from counts over all training texts:
1. exchange clustering: the TOP most frequent words and TAILS groups of all others (by their last bytes) move one by one
   to the class that makes the likelihood greatest, until none moves;
2. every other word of the local table with LEAST_COUNT or more goes to the class that makes the likelihood of its own
   neighbours greatest, given step 1;
3. the rest, seen or not, have the class of their tail group.
So the number of words with a class of their own grows with the vocabulary, up to the local table's bound.

Transitions are counts between the final classes interpolated with class frequencies; a word's share of its class is its
training count plus ADD, over the class's tokens plus ADD for each of its words and one more for all unseen words together.

A word is its 64-bit hash, whose low bits are its tail group: N, V and all counts are exact but for two words with the
same 55 other bits and the same group. Counts of the words with at least some count (so many that at most LOCAL words have
it) go to every task; the others are rare, so no single one is a hot key, and meet the texts that have them bucket by
bucket, as arrays. Neighbour counts are rows of (code, count) that Spark sums before and after the exchange; there are at
most ITEMS ** 2 or LOCAL x 2 (CLASSES + 1) codes, whatever the corpus.

Nulls and ties: a null text is empty, and its only token is the end; a row with a null id is in the training part.
Repeated rows each get a row and each count. Equal frequencies are ordered by hash, equal classes by number. Without
training rows N and V are 0 and every token is unseen. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.llm import textkit
from lakefold.session import group_count, written

TOP, TAILS, CLASSES = 1024, 512, 48
#: A bound for safety: every move raises the likelihood, so exchange ends by itself.
ROUNDS = 200
LOCAL, LEAST_COUNT = 1 << 18, 2
CODES_FLUSH = 4_000_000
ADD, TRANSITION = 0.4, 20.0
FLUSH = 3_000_000
TAIL_MASK = np.uint64(TAILS - 1)
END = TOP + TAILS
ITEMS = END + 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tokens(texts: pa.Array) -> tuple[textkit.Words, np.ndarray]:
    """The lower-cased words and their keys."""
    words = textkit.words_of(texts, LOWER)
    keys = words.hashes() & ~TAIL_MASK
    tail = np.zeros(len(keys), dtype=np.uint64)
    for back in (1, 2, 3):
        at = words.ends - back
        tail = tail * np.uint64(257) + np.where(at >= words.starts, words.data[np.maximum(at, 0)], 0).astype(np.uint64)
    return words, keys | (textkit.mix(tail) & TAIL_MASK)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(24)) % np.uint64(buckets)).astype(np.int32)


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of a sorted bucket column."""
    if len(bucket):
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        yield from zip(bucket[first].tolist(), first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True)


COUNTS_DDL = "bucket int, keys binary, counts binary"


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.record_batch([pa.array(list(c), type=t) for c, t in zip(columns, types, strict=True)], names=names)


def _joined(table: pa.Table, name: str, dtype: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=dtype), *(np.frombuffer(b, dtype=dtype) for b in table[name].to_pylist())])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], (np.add.reduceat(counts, first) if len(first) else counts)


def word_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """docs: text, of training rows. A row per bucket: its words' keys, ascending, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, counts = _summed(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
            bucket = bucket_of(keys, buckets)
            order = np.argsort(bucket, kind="stable")
            keys, counts, bucket = keys[order], counts[order], bucket[order]
            rows = [(b, keys[x:y].tobytes(), counts[x:y].astype("<u4").tobytes()) for b, x, y in _slices(bucket)]
            return _batch(rows, ["bucket", "keys", "counts"], [pa.int32(), pa.binary(), pa.binary()])

        for piece in textkit.pieces(batches, "text"):
            _, keys = tokens(textkit.column(piece, "text"))
            held.append(np.unique(keys, return_counts=True))
            size += len(held[-1][0])
            if size >= FLUSH:
                yield flush()
                held.clear()
                size = 0
        if held:
            yield flush()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = _summed(_joined(table, "keys", "<u8"), _joined(table, "counts", "<u4").astype(np.int64))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([keys.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})

    return docs.select("text").mapInArrow(run, COUNTS_DDL).groupBy("bucket").applyInArrow(merge, COUNTS_DDL)


@dataclass
class Vocabulary:
    """What every task gets: bounded by LOCAL, whatever the corpus."""

    tokens: int
    distinct: int
    texts: int
    keys: np.ndarray  # ascending, with at least the count that makes them local
    counts: np.ndarray
    top: np.ndarray  # of each key: its item, or -1
    tail_tokens: np.ndarray  # of words that are not top, by tail group
    tail_words: np.ndarray

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def items(self, keys: np.ndarray) -> np.ndarray:
        """TOP words have items of their own, all others those of their tail groups."""
        out = TOP + (keys & TAIL_MASK).astype(np.int64)
        at, found = self.find(keys)
        if len(self.keys):
            own = self.top[at]
            out = np.where(found & (own >= 0), own, out)
        return out


def vocabulary(counts: DataFrame, texts: int, local: int = LOCAL, top: int = TOP) -> Vocabulary:
    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys, n = _joined(table, "keys", "<u8"), _joined(table, "counts", "<i8")
            tail = (keys & TAIL_MASK).astype(np.int64)
            values, often = np.unique(n, return_counts=True)
            rows = [(values.tobytes(), often.tobytes(), np.bincount(tail, weights=n, minlength=TAILS).tobytes(), np.bincount(tail, minlength=TAILS).astype(np.float64).tobytes())]
            yield _batch(rows, ["values", "often", "tokens", "words"], [pa.binary()] * 4)

    seen: dict[int, int] = {}
    tail_tokens, tail_words = np.zeros(TAILS), np.zeros(TAILS)
    for r in counts.mapInArrow(summary, "values binary, often binary, tokens binary, words binary").toLocalIterator():
        for v, n in zip(np.frombuffer(r.values, dtype=np.int64).tolist(), np.frombuffer(r.often, dtype=np.int64).tolist(), strict=True):
            seen[v] = seen.get(v, 0) + n
        tail_tokens += np.frombuffer(r.tokens)
        tail_words += np.frombuffer(r.words)
    least, room = 1 << 62, local
    for v in sorted(seen, reverse=True):
        if seen[v] > room:
            break
        room -= seen[v]
        least = v

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys, n = _joined(table, "keys", "<u8"), _joined(table, "counts", "<i8")
            yield _batch([(keys[n >= least].tobytes(), n[n >= least].tobytes())], ["keys", "counts"], [pa.binary()] * 2)

    rows = counts.mapInArrow(chosen, "keys binary, counts binary").collect()
    keys = np.concatenate([np.zeros(0, dtype=np.uint64), *(np.frombuffer(r.keys, dtype=np.uint64) for r in rows)])
    n = np.concatenate([np.zeros(0, dtype=np.int64), *(np.frombuffer(r.counts, dtype=np.int64) for r in rows)])
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.sort(np.lexsort((keys, -n))[:top])
    item = np.full(len(keys), -1, dtype=np.int64)
    item[first] = np.arange(len(first))
    tail = (keys[first] & TAIL_MASK).astype(np.int64)
    tail_tokens -= np.bincount(tail, weights=n[first], minlength=TAILS)
    tail_words -= np.bincount(tail, minlength=TAILS)
    total = sum(v * k for v, k in seen.items())
    return Vocabulary(total + texts, sum(seen.values()) + (texts > 0), texts, keys, n, item, tail_tokens, tail_words)


def stream(words: textkit.Words, items: np.ndarray, use: np.ndarray) -> np.ndarray:
    """END, then for each used text its items and END."""
    counts = np.where(use, words.counts, 0)
    out = np.full(int(counts.sum()) + int(use.sum()) + 1, END, dtype=np.int64)
    starts = 1 + np.cumsum(np.where(use, counts + 1, 0)) - np.where(use, counts + 1, 0)
    out[textkit.runs(starts[use], counts[use])] = items[textkit.runs(words.word_at[:-1][use], counts[use])]
    return out


def _code_counts(docs: DataFrame, codes_of) -> DataFrame:
    """code, n: how often each of the codes that codes_of(words, keys) gives occurs in docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for at in range(0, len(codes), 1 << 18):
                yield pa.record_batch([pa.array(codes[at : at + (1 << 18)], pa.int64()), pa.array(n[at : at + (1 << 18)], pa.int64())], names=["code", "n"])

        for piece in textkit.pieces(batches, "text"):
            held.append(codes_of(*tokens(textkit.column(piece, "text"))))
            size += len(held[-1])
            if size >= CODES_FLUSH:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return docs.select("text").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def _square(counts: DataFrame, size: int) -> np.ndarray:
    """The summed counts as a size x size matrix; the code is row * size + column."""
    found = counts.toArrow()
    out = np.zeros(size * size)
    out[found["code"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(size, size)


def item_bigrams(docs: DataFrame, known: Vocabulary) -> np.ndarray:
    """ITEMS x ITEMS counts of neighbouring items over the training texts."""

    def codes(words: textkit.Words, keys: np.ndarray) -> np.ndarray:
        seq = stream(words, known.items(keys), np.ones(len(words.counts), dtype=bool))
        return seq[:-1] * ITEMS + seq[1:]

    return _square(_code_counts(docs, codes), ITEMS)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each item. END is alone in the last class. In turn, most frequent first, each item moves to the class
    that makes the training likelihood greatest, until a round moves none."""
    n = len(bigrams)
    m = bigrams.astype(np.float64)
    frequency = m.sum(axis=1) + m.sum(axis=0)
    order = [int(i) for i in np.argsort(-frequency[: n - 1], kind="stable") if frequency[i] > 0]
    of = np.arange(n) % classes
    of[order] = np.arange(len(order)) % classes
    of[n - 1] = classes
    k = classes + 1
    member = np.zeros((n, k))
    member[np.arange(n), of] = 1
    right, left = m @ member, m.T @ member  # of each item: counts of the classes after and before it
    table = member.T @ right
    for _ in range(rounds):
        moved = 0
        for i in order:
            a, own = int(of[i]), m[i, i]
            r, l = right[i].copy(), left[i].copy()
            r[a] -= own
            l[a] -= own
            table[a] -= r
            table[:, a] -= l
            table[a, a] -= own
            rows, columns = table.sum(axis=1), table.sum(axis=0)
            # adding i to b changes row b by r, column b by l, and the cell (b, b) by both and own
            gain = (_xlogx(table + r) - _xlogx(table)).sum(axis=1) + (_xlogx(table + l[:, None]) - _xlogx(table)).sum(axis=0)
            cell = np.diagonal(table)
            gain += _xlogx(cell + r + l + own) - _xlogx(cell + r) - _xlogx(cell + l) + _xlogx(cell)
            gain -= _xlogx(rows + r.sum() + own) - _xlogx(rows) + _xlogx(columns + l.sum() + own) - _xlogx(columns)
            gain[classes] = -np.inf
            b = int(np.argmax(gain))
            if gain[a] >= gain[b] - 1e-9:
                b = a
            table[b] += r
            table[:, b] += l
            table[b, b] += own
            if b != a:
                moved += 1
                of[i] = b
                right[:, a] -= m[:, i]
                right[:, b] += m[:, i]
                left[:, a] -= m[i]
                left[:, b] += m[i]
        if not moved:
            break
    return of


def _smoothed(table: np.ndarray) -> np.ndarray:
    """log10 transitions: counts interpolated with the frequencies of the class that follows."""
    into = table.sum(axis=0)
    share = (into + 1) / (into.sum() + len(table))
    return np.log10((table + TRANSITION * share) / (table.sum(axis=1, keepdims=True) + TRANSITION))


def word_classes(docs: DataFrame, known: Vocabulary, of: np.ndarray, table: np.ndarray, buckets: int) -> np.ndarray:
    """The class of each local word, given those of the items (of) and the counts between them (table): for words that are
    no items and have LEAST_COUNT, the class under which the classes before and after the word, and the word, are most
    likely; for others that of their item."""
    k = CLASSES + 1
    move = _smoothed(table)
    emit = -np.log10(table.sum(axis=0) + ADD)  # a word's share of a class, but for its own count
    own = known.top < 0
    own &= known.counts >= LEAST_COUNT

    def codes(words: textkit.Words, keys: np.ndarray) -> np.ndarray:
        used = np.ones(len(words.counts), dtype=bool)
        seq = of[stream(words, known.items(keys), used)]
        at, found = known.find(keys)
        chosen = np.flatnonzero(found & own[at]) if len(known.keys) else np.zeros(0, dtype=np.int64)
        place = chosen + words.text_of_word()[chosen] + 1  # in seq
        return np.concatenate((at[chosen] * (2 * k) + seq[place - 1], at[chosen] * (2 * k) + k + seq[place + 1]))

    def choose(_key: tuple, rows: pa.Table) -> pa.Table:
        code, n = rows["code"].to_numpy(), rows["n"].to_numpy()
        word, which = np.unique(code // (2 * k), return_inverse=True)
        context = np.zeros((len(word), 2 * k))
        context[which, code % (2 * k)] = n
        before, after = context[:, :k], context[:, k:]
        likely = before @ move + after @ move.T + before.sum(axis=1, keepdims=True) * emit
        likely[:, CLASSES] = -np.inf
        return pa.table({"word": pa.array(word, pa.int64()), "class": pa.array(likely.argmax(axis=1), pa.int32())})

    counts = _code_counts(docs, codes).withColumn("bucket", F.pmod(F.floor(F.col("code") / (2 * k)), F.lit(buckets)))
    found = counts.groupBy("bucket").applyInArrow(choose, "word bigint, class int").toArrow()
    out = of[known.items(known.keys)]
    out[found["word"].to_numpy()] = found["class"].to_numpy()
    return out


@dataclass
class Model:
    known: Vocabulary
    items: np.ndarray  # class of each item
    words: np.ndarray  # class of each local word
    transition: np.ndarray  # log10, from a class to a class
    share: np.ndarray  # log10 of what a class's word counts are divided by

    def classes(self, keys: np.ndarray, at: np.ndarray, found: np.ndarray) -> np.ndarray:
        out = self.items[TOP + (keys & TAIL_MASK).astype(np.int64)]
        return np.where(found, self.words[at], out) if len(self.words) else out

    def scores(self, words: textkit.Words, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per text, without its rare words' counts: known tokens, base, score; and which words are rare."""
        known = self.known
        texts = len(words.word_at) - 1
        at, found = known.find(keys)
        seq = class_stream(words, self.classes(keys, at, found))
        step = self.transition[seq[:-1], seq[1:]] - self.share[seq[1:]]
        count = known.counts[at] if len(known.keys) else np.zeros(len(keys), dtype=np.int64)
        base, emit = np.where(found, np.log10(count + 1.0), 0.0), np.where(found, np.log10(count + ADD), 0.0)
        begins, ends = words.word_at[:-1], words.word_at[1:]
        sums = [textkit.segment_sums(v, begins, ends) for v in (found.astype(np.float64), base, emit)]
        n = words.counts + 1
        last = np.cumsum(n)
        n_known = sums[0] + (known.texts > 0)
        base = sums[1] + np.log10(known.texts + 1.0) - n * np.log10(known.tokens + known.distinct + 1.0)
        return n_known, base, sums[2] + textkit.segment_sums(step, last - n, last), ~found


def class_stream(words: textkit.Words, classes: np.ndarray) -> np.ndarray:
    """The end's class, then for each text its words' classes and the end's."""
    out = np.full(len(classes) + len(words.counts) + 1, CLASSES, dtype=np.int64)
    out[1 + np.arange(len(classes)) + words.text_of_word()] = classes
    return out


def fit(docs: DataFrame, known: Vocabulary, buckets: int) -> Model:
    """docs: text, of training rows."""
    k = CLASSES + 1
    bigrams = item_bigrams(docs, known)
    of = exchange(bigrams)
    member = np.zeros((ITEMS, k))
    member[np.arange(ITEMS), of] = 1
    words = word_classes(docs, known, of, member.T @ bigrams @ member, buckets)
    model = Model(known, of, words, np.zeros((k, k)), np.zeros(k))

    def codes(texts: textkit.Words, keys: np.ndarray) -> np.ndarray:
        seq = class_stream(texts, model.classes(keys, *known.find(keys)))
        return seq[:-1] * k + seq[1:]

    model.transition = _smoothed(_square(_code_counts(docs, codes), k))
    # tail groups hold what is not local
    tail = (known.keys & TAIL_MASK).astype(np.int64)
    rest = known.top < 0
    tokens = known.tail_tokens - np.bincount(tail[rest], weights=known.counts[rest], minlength=TAILS)
    many = known.tail_words - np.bincount(tail[rest], minlength=TAILS)
    groups = of[TOP : TOP + TAILS]
    total = np.bincount(words, weights=known.counts, minlength=k) + np.bincount(groups, weights=tokens, minlength=k)
    distinct = np.bincount(words, minlength=k) + np.bincount(groups, weights=many, minlength=k)
    model.share = np.log10(total + ADD * (distinct + 1))
    model.share[CLASSES] = 0.0  # the end is its class's only token
    return model


PARTS_DDL = "bucket int, kind int, rows binary, counts binary, keys binary"
_PARTS = (["bucket", "kind", "rows", "counts", "keys"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])


def _parts(model: Model, buckets: int):
    """Rare words (kind 0: keys) by bucket of the word, and what is known of each text without them (kind 1) by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, rows = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            bucket = bucket_of(keys, buckets)
            order = np.lexsort((rows, bucket))
            keys, rows, bucket = keys[order], rows[order], bucket[order]
            out = []
            for b, x, y in _slices(bucket):
                first = np.flatnonzero(np.concatenate(([True], rows[x + 1 : y] != rows[x : y - 1])))
                counts = np.diff(np.concatenate((first, [y - x]))).astype("<u4")
                out.append((b, 0, rows[x:y][first].tobytes(), counts.tobytes(), keys[x:y].tobytes()))
            return _batch(out, *_PARTS)

        for piece in textkit.pieces(batches, "text"):
            words, keys = tokens(textkit.column(piece, "text"))
            row = textkit.column(piece, "row").to_numpy()
            n_known, base, score, rare = model.scores(words, keys)
            local = np.stack((words.counts + 1.0, n_known, base, score), axis=1)
            deal = (row % buckets).astype(np.int32)
            order = np.argsort(deal, kind="stable")
            names = np.stack((textkit.column(piece, "doc_id").fill_null(0).to_numpy(), textkit.column(piece, "flags").to_numpy()), axis=1)
            yield _batch([(b, 1, row[order[x:y]].tobytes(), names[order[x:y]].tobytes(), local[order[x:y]].tobytes()) for b, x, y in _slices(deal[order])], *_PARTS)
            held.append((keys[rare], row[words.text_of_word()[rare]]))
            size += int(rare.sum())
            if size >= FLUSH // 3:
                yield flush()
                held.clear()
                size = 0
        if size:
            yield flush()

    return run


def _look_up(buckets: int):
    """Of one bucket: sums over each text's rare words, dealt by row."""

    def run(_key: tuple, parts: pa.Table, counts: pa.Table) -> pa.Table:
        keys, n = _joined(counts, "keys", "<u8"), _joined(counts, "counts", "<i8")
        rows, found, out = [], [], []
        for kind, r, c, k in zip(*(parts[x].to_pylist() for x in ("kind", "rows", "counts", "keys")), strict=True):
            if kind == 1:
                out.append((_key[0].as_py(), 1, r, c, k))
            else:
                rows.append(np.repeat(np.frombuffer(r, dtype=np.int64), np.frombuffer(c, dtype=np.uint32)))
                found.append(np.frombuffer(k, dtype=np.uint64))
        if rows:
            rows, found = np.concatenate(rows), np.concatenate(found)
            at = np.minimum(np.searchsorted(keys, found), max(0, len(keys) - 1))
            count = np.where(keys[at] == found, n[at], 0) if len(keys) else np.zeros(len(found), dtype=np.int64)
            order = np.argsort(rows, kind="stable")
            rows, count = rows[order], count[order]
            first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            values = np.stack((np.zeros(len(rows)), count > 0, np.log10(count + 1.0), np.log10(count + ADD)), axis=1)
            sums = np.add.reduceat(values, first, axis=0)
            row = rows[first]
            deal = (row % buckets).astype(np.int32)
            order = np.argsort(deal, kind="stable")
            out += [(b, 0, row[order[x:y]].tobytes(), b"", sums[order[x:y]].tobytes()) for b, x, y in _slices(deal[order])]
        return pa.Table.from_batches([_batch(out, *_PARTS)])

    return run


SUMS_DDL = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _add_up(_key: tuple, table: pa.Table) -> pa.Table:
    """Sums by row; a row's id and flags (1: held out, 2: no id) come with its local part."""
    named = table.filter(pa.compute.equal(table["kind"], 1))
    order = np.argsort(_joined(named, "rows", "<i8"), kind="stable")
    names = _joined(named, "counts", "<i8").reshape(-1, 2)[order]
    rows = _joined(table, "rows", "<i8")
    values = _joined(table, "keys", "<f8").reshape(-1, 4)
    order = np.argsort(rows, kind="stable")
    rows, values = rows[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else np.zeros(0, dtype=np.int64)
    sums = np.add.reduceat(values, first, axis=0) if len(first) else values
    whole = [pa.array(np.rint(sums[:, i]).astype(np.int64)) for i in (0, 1)]
    ids = pa.array(names[:, 0], mask=(names[:, 1] & 2) > 0)
    return pa.table([ids, pa.array((names[:, 1] & 1) > 0), *whole, pa.array(sums[:, 2]), pa.array(sums[:, 3])], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def score_texts(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity. The
    model learns from the rows that are not held out."""
    spark = docs.sparkSession
    buckets = group_count(docs)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = docs.where("NOT held_out").select("text")
    counts = written(word_counts(training, buckets), "word-counts")
    known = vocabulary(counts, training.count())
    model = fit(training, known, buckets)
    flags = F.col("held_out").cast("bigint") + F.when(F.col("doc_id").isNull(), 2).otherwise(0)
    placed = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), flags.alias("flags"), "text")
    parts = placed.mapInArrow(_parts(model, buckets), PARTS_DDL)
    sums = parts.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(_look_up(buckets), PARTS_DDL)
    out = sums.groupBy("bucket").applyInArrow(_add_up, SUMS_DDL)
    per_token = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(known.tokens).cast("bigint").alias("train_tokens"), "base_score", "score", per_token.alias("perplexity"))


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
