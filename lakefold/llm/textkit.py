"""Words and word-window hashes of Arrow string columns, computed over the UTF-8 bytes without an object per word.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which is the regular expression [^\\x20\\x09-\\x0D]+.
Word hashes are polynomial sums modulo 2**64 over a table of random byte values, then mixed; window hashes are
polynomial sums of word hashes, mixed again.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PIECE_BYTES = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_STEPS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_TABLES = [np.random.default_rng(s).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for s in (11, 12)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE_BYTES + (PIECE_BYTES >> 4))
        base = _BASES[which]
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            full = np.full(size, b, dtype=np.uint64)
            full[0] = 1
            pair.append(np.multiply.accumulate(full))
        have = (pair[0], pair[1])
        if size <= 4 * PIECE_BYTES:
            _POWERS[which] = have
    return have


@dataclass
class Words:
    """The words of a run of texts. word_at[i]:word_at[i + 1] are those of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    word_at: np.ndarray
    text_at: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.word_at) - 1), self.counts)

    def hashes(self, which: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, which)


_TRIM = None


def release_memory() -> None:
    """Gives freed memory back to the system, so that a worker holds what its present group needs and no more."""
    global _TRIM
    if _TRIM is None:
        try:
            _TRIM = ctypes.CDLL(None).malloc_trim
        except (OSError, AttributeError):  # another C library
            _TRIM = lambda _: 0
    pa.default_memory_pool().release_unused()
    _TRIM(0)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of each run of bytes data[starts[i]:ends[i]]; starts and ends ascend. Work arrays are as long as a few
    PIECE_BYTES, however long the data."""
    out = np.zeros(len(starts), dtype=np.uint64)
    done = 0
    while done < len(starts):
        base = int(starts[done])
        stop = max(done + 1, int(np.searchsorted(ends, base + PIECE_BYTES, side="right")))
        size = int(ends[stop - 1]) - base
        if size > PIECE_BYTES:  # one long run
            power, _ = _powers(which, PIECE_BYTES)
            step, factor, total = int(power[PIECE_BYTES - 1]) * _BASES[which] % (1 << 64), 1, 0
            for a in range(base, base + size, PIECE_BYTES):
                part = data[a : min(a + PIECE_BYTES, base + size)]
                total += factor * int((_TABLES[which][part] * power[: len(part)]).sum(dtype=np.uint64))
                factor = factor * step % (1 << 64)
            out[done] = np.uint64(total % (1 << 64))
        else:
            power, inverse = _powers(which, size + 1)
            sums = np.zeros(size + 1, dtype=np.uint64)
            np.multiply(_TABLES[which][data[base : base + size]], power[:size], out=sums[1:])
            np.cumsum(sums, out=sums)
            a = starts[done:stop] - base
            out[done:stop] = (sums[ends[done:stop] - base] - sums[a]) * inverse[a]
        done = stop
    out += (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    return mix(out)


def first_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each run, as a number; shorter ones are padded with zeros."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for k in range(8):
        at = starts + k
        out |= np.where(at < ends, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint64) << np.uint64(8 * k)
    return out


def windows(hashes: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """The hash of each n consecutive words, by the first; windows over a text's end are to be left out by the caller."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, dtype=np.uint64)
    step = np.uint64(_STEPS[which])
    for k in range(n):
        out *= step
        out += hashes[k : k + size]
    return mix(out)


def window_starts(words: Words, n: int) -> np.ndarray:
    """Positions (among all words) at which n words of one text begin."""
    left = np.repeat(words.word_at[1:], words.counts) - np.arange(len(words.starts))
    return np.flatnonzero(left >= n)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or buffers[2] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words_of(column: pa.Array, table: np.ndarray | None = None) -> Words:
    """table: maps each byte before words are looked for (ASCII lower case, say)."""
    data, at = text_bytes(column)
    if table is not None:
        data = table[data]
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, starts, ends, np.searchsorted(starts, at), at)


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in runs of about size bytes of the column, so that work arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        _, at = text_bytes(texts)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(at, at[start] + size, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def characters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character (its UTF-8 bytes), and the offsets of the texts among them."""
    begins = (data & 0xC0) != 0x80
    first = np.flatnonzero(begins)
    sizes = np.diff(np.append(first, len(data)))
    out = data[first].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(sizes > k)
        if len(longer):
            out[longer] = (out[longer] << np.uint32(8)) | data[first[longer] + k]
    return out, np.searchsorted(first, at)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def segment_sums(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[begins[i]:ends[i]]; each depends on its own values alone, to the last bit. Segments ascend and do
    not overlap; an end before its begin is an empty segment."""
    out = np.zeros(len(begins), dtype=values.dtype if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(ends > begins)
    if len(full):
        edges = np.stack((begins[full], ends[full]), axis=1).ravel()
        out[full] = np.add.reduceat(np.append(values, values.dtype.type(0)), edges, dtype=out.dtype)[::2]
    return out


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of starts[i] + 0 .. lengths[i] - 1."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(total)
