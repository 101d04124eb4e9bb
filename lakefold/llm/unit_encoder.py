"""Token ids of whole texts by the tokenizers library, each distinct unit of text encoded once.

The byte-level pre-tokenizer splits a text into pieces that are encoded one by one. A unit is one or more whole pieces;
units are cut where a piece is sure to begin:
- before a run of white space, and before its last character if something follows (a space goes with what follows it,
  any other white space is a piece of its own, so a cut follows it);
- between a letter, a digit and ASCII punctuation but the apostrophe, in any order.
Letters are ASCII ones and those of some two- and three-byte ranges; next to other characters no cut is made, which is
always right. Texts with an added token, or with other white space at a cut, are encoded whole.

Units are found, hashed (64 bits), looked up and put together as arrays; only units not met before become strings. Hash
and first bytes have to agree, so two units are taken for one another only where both do.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from lakefold.llm import textkit

#: Bounds of what is kept between batches: units, and their ids.
CACHED_UNITS, CACHED_IDS = 1 << 20, 1 << 23
LINE_UNITS = 200
SPACE, LETTER, DIGIT, MARK, OTHER = range(5)


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        if b in (0x20, *range(0x09, 0x0E)):
            out[b] = SPACE
        elif c.isalpha():
            out[b] = LETTER
        elif c.isdigit():
            out[b] = DIGIT
        elif 32 < b < 127 and c != "'":
            out[b] = MARK
    return out


CLASSES = _classes()
#: Lead bytes whose characters are all letters: U+00C0-024F without U+00D7 and U+00F7, U+0400-047F, U+5000-8FFF.
LEADS = np.zeros(256, dtype=np.uint8)
LEADS[[0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xD0, 0xD1]] = 2
LEADS[0xE5:0xE9] = 3
#: Lead bytes of white space (and of marks without width) beyond ASCII, and controls that some take for white space.
RARE = np.zeros(256, dtype=bool)
RARE[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True


def classes_of(data: np.ndarray) -> np.ndarray:
    """The class of each byte; all bytes of a letter that has several are LETTER."""
    out = CLASSES[data]
    at = np.flatnonzero(LEADS[data])
    if len(at):
        at = at[at + LEADS[data[at]] <= len(data)]
        sign = (data[at] == 0xC3) & ((data[at + 1] == 0x97) | (data[at + 1] == 0xB7))
        at = at[~sign]
        out[at] = LETTER
        out[at + 1] = LETTER
        three = at[LEADS[data[at]] == 3]
        out[three + 2] = LETTER
    return out


def _rare_spaces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of characters that may be white space and are not ASCII white space."""
    at = np.flatnonzero(RARE[data])
    if not len(at):
        return at, at
    padded = np.concatenate((data, np.zeros(2, dtype=np.uint8)))
    a, b, c = data[at], padded[at + 1], padded[at + 2]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    general = (a == 0xE2) & (((b == 0x80) & ((c < 0x90) | ((c >= 0xA8) & (c < 0xB0)))) | (b == 0x81))
    three = general | ((a == 0xE1) & ((b == 0x9A) | (b == 0xA0))) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xEF) & (b == 0xBB))
    found = (a < 0x20) | two | three
    return at[found], at[found] + np.where(a < 0x20, 1, np.where(two, 2, 3))[found]


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        feed = self._whole(["\n", "a\nb", "\n a"])
        byte_level = "ByteLevel" in repr(self.tokenizer.pre_tokenizer) and self.tokenizer.normalizer is None
        self.feed = int(feed[0][0]) if byte_level and [len(f) for f in feed] == [1, 3, 2] else None
        self.clear()

    def clear(self) -> None:
        self.keys, self.first = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        self.at, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.ids = np.zeros(0, dtype=self.dtype)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cuts(self, data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where units begin."""
        space = kind == SPACE
        before = np.empty(len(data), dtype=bool)
        before[1:] = space[:-1]
        edges = at[:-1][np.diff(at) > 0]
        before[edges] = False
        after = np.empty(len(data), dtype=bool)
        after[:-1] = space[1:]
        after[at[1:][np.diff(at) > 0] - 1] = True  # the end of a text: no last character of a run there
        cut = space & (~before | ~after)
        joined = np.empty(len(data), dtype=bool)
        joined[1:] = before[1:] & (data[:-1] != 0x20)
        joined[0] = False
        cut |= ~space & joined
        cut[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] < OTHER) & (kind[:-1] < OTHER) & ~space[1:] & ~space[:-1]
        cut[edges] = True
        return np.flatnonzero(cut)

    def _odd_texts(self, data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Texts that are encoded whole."""
        begin, end = _rare_spaces(data)
        if len(begin):
            text = np.searchsorted(at, begin, side="right") - 1
            left = (begin == at[text]) | (kind[np.maximum(begin - 1, 0)] == SPACE)
            right = (end >= at[text + 1]) | (kind[np.minimum(end, len(data) - 1)] == SPACE)
            begin = begin[left | right]
        raw = data.tobytes()
        found = []
        for token in self.added:
            k = raw.find(token)
            while k >= 0:
                found.append(k)
                k = raw.find(token, k + 1)
        where = np.concatenate((begin, np.array(found, dtype=np.int64)))
        return np.unique(np.searchsorted(at, where, side="right") - 1)

    def _learn(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, and how many each has. Units are put on lines, each after a line feed, whose id shows where it begins."""
        sizes = ends - begins
        plain = ~((CLASSES[data[begins]] == SPACE) & ((data[begins] != 0x20) | (sizes == 1)) | (sizes > 1) & (CLASSES[data[ends - 1]] == SPACE))
        out_sizes = np.zeros(len(begins), dtype=np.int32)
        chosen = np.flatnonzero(plain)
        line = np.full(int(sizes[chosen].sum()) + len(chosen), 0x0A, dtype=np.uint8)
        place = np.cumsum(sizes[chosen] + 1) - sizes[chosen]
        line[textkit.runs(place, sizes[chosen])] = data[textkit.runs(begins[chosen], sizes[chosen])]
        raw = line.tobytes()
        edges = [*(place[::LINE_UNITS] - 1).tolist(), len(raw)]
        lines = [raw[a:b].decode() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), dtype=self.dtype, count=sum(map(len, found)))
        marks = np.flatnonzero(ids == self.feed)
        if len(marks) != len(chosen):  # not so with this tokenizer's rules; kept for others
            each = self._whole([data[a:b].tobytes().decode() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)])
            return np.concatenate([np.zeros(0, dtype=self.dtype), *each]), np.array([len(e) for e in each], dtype=np.int32)
        out_sizes[chosen] = np.diff(np.append(marks, len(ids))) - 1
        keep = np.ones(len(ids), dtype=bool)
        keep[marks] = False
        ids = ids[keep]
        rest = np.flatnonzero(~plain)
        if not len(rest):
            return ids, out_sizes
        spaces = self._whole([data[a:b].tobytes().decode() for a, b in zip(begins[rest].tolist(), ends[rest].tolist(), strict=True)])
        out_sizes[rest] = [len(e) for e in spaces]
        out = np.empty(int(out_sizes.sum()), dtype=self.dtype)
        starts = np.cumsum(out_sizes, dtype=np.int64) - out_sizes
        out[textkit.runs(starts[chosen], out_sizes[chosen].astype(np.int64))] = ids
        for k, e in zip(rest, spaces, strict=True):
            out[starts[k] : starts[k] + len(e)] = e
        return out, out_sizes

    def _look_up(self, keys: np.ndarray, first: np.ndarray, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places, in the tables, of distinct units given by key, ascending; those not there are learnt."""
        if len(self.keys) > CACHED_UNITS or len(self.ids) > CACHED_IDS:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        there = np.zeros(len(keys), dtype=bool)
        if len(self.keys):
            near = np.minimum(at, len(self.keys) - 1)
            there = (self.keys[near] == keys) & (self.first[near] == first)
        new = np.flatnonzero(~there)
        if len(new):
            ids, sizes = self._learn(data, begins[new], ends[new])
            starts = len(self.ids) + np.cumsum(sizes, dtype=np.int64) - sizes
            self.ids = np.concatenate((self.ids, ids))
            self.at, self.size = np.insert(self.at, at[new], starts), np.insert(self.size, at[new], sizes)
            self.keys, self.first = np.insert(self.keys, at[new], keys[new]), np.insert(self.first, at[new], first[new])
            at = at + np.cumsum(~there) - ~there
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the offset at which those of each begin. A null is an empty text."""
        data, at = textkit.text_bytes(texts)
        n = len(at) - 1
        if not len(data):
            return np.zeros(0, dtype=self.dtype), np.zeros(n + 1, dtype=np.int64)
        kind = classes_of(data)
        odd = self._odd_texts(data, at, kind) if self.feed is not None else np.flatnonzero(np.diff(at))
        begins = self._cuts(data, at, kind)
        ends = np.append(begins[1:], len(data))
        text = np.searchsorted(at, begins, side="right") - 1
        if len(odd):
            usual = ~np.isin(text, odd)
            begins, ends, text = begins[usual], ends[usual], text[usual]
        hashes = textkit.span_hashes(data, begins, ends)
        keys, which, back = np.unique(hashes, return_index=True, return_inverse=True)
        at_unit = self._look_up(keys, textkit.first_bytes(data, begins[which], ends[which]), data, begins[which], ends[which])[back]
        sizes = self.size[at_unit].astype(np.int64)
        totals = np.zeros(n, dtype=np.int64)
        np.add.at(totals, text, sizes) if len(odd) else None
        if not len(odd):
            per = np.concatenate(([0], np.cumsum(sizes)))
            totals = per[np.searchsorted(text, np.arange(n), side="right")] - per[np.searchsorted(text, np.arange(n))]
            return self.ids[textkit.runs(self.at[at_unit], sizes)], np.concatenate(([0], np.cumsum(totals)))
        whole = self._whole([data[at[i] : at[i + 1]].tobytes().decode() for i in odd.tolist()])
        totals[odd] = [len(w) for w in whole]
        offsets = np.concatenate(([0], np.cumsum(totals)))
        out = np.empty(int(offsets[-1]), dtype=self.dtype)
        mine = np.ones(n, dtype=bool)
        mine[odd] = False
        out[textkit.runs(offsets[:-1][mine], totals[mine])] = self.ids[textkit.runs(self.at[at_unit], sizes)]
        for i, w in zip(odd.tolist(), whole, strict=True):
            out[offsets[i] : offsets[i + 1]] = w
        return out, offsets


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
