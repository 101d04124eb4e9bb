"""Token counts by a Viterbi pass that carries only the best score and its number of pieces.

An Aho-Corasick automaton lists the vocabulary's pieces at each place of a text; the best path follows the unigram
model's rules: scores are added in double precision; of paths with equal scores to one place, the one whose last piece
begins first wins; a character that is no piece by itself costs the lowest score less 10 and counts as its UTF-8 bytes
where the vocabulary has byte pieces, else as one unknown piece (neighbouring unknown characters are one).

No piece goes on past a space or a line feed that follows another character (checked when the vocabulary is loaded), so
a text is the sum of its units, and units met before are not searched again. If some piece did, whole texts are searched.

Nulls and ties: a null or empty text has no pieces; repeated rows each get a row; extra columns stay, and a column named
n_tokens is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lakefold.llm import textkit

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_UNITS = 800_000
LOWEST = float("-inf")


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_pieces = byte_pieces
        self.whole = any(SPACE in p.lstrip(SPACE) or "\n" in p for p, _ in pieces)
        self.units: dict[str, int | None] = {"": None}

    def search(self, text: str) -> int:
        """Pieces on the best path over a text in which spaces are SPACE."""
        n = len(text)
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done = 0  # ends below are final
        high, pieces, single = LOWEST, 0, False
        for end, (size, score) in self.automaton.iter(text):
            if done < end:
                if single:
                    best[done + 1], count[done + 1] = high, pieces
                else:
                    self._close(text, done, high, pieces, single, best, count, unknown)
                done, high, single = done + 1, LOWEST, False
                while done < end:
                    self._close(text, done, high, pieces, single, best, count, unknown)
                    done += 1
            total = best[end + 1 - size] + score  # longest first: a later one must be higher
            if total > high:
                high, pieces = total, count[end + 1 - size] + 1
            if size == 1:
                single = True
        while done < n:
            self._close(text, done, high, pieces, single, best, count, unknown)
            done, high, single = done + 1, LOWEST, False
        return count[n]

    def _close(self, text, end, high, pieces, single, best, count, unknown) -> None:
        if not single:
            total = best[end] + self.unknown
            if total > high:
                best[end + 1] = total
                unknown[end + 1] = True
                if self.byte_pieces:
                    count[end + 1] = count[end] + len(text[end].encode())
                else:
                    count[end + 1] = count[end] + (0 if unknown[end] else 1)
                return
        best[end + 1], count[end + 1] = high, pieces

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.whole or SPACE in text:
            return self.search(SPACE + text.replace(" ", SPACE))
        units = self.units
        parts = text.replace("\n", " \n").split(" ")
        try:
            return sum(map(units.__getitem__, parts))
        except KeyError:
            pass
        except TypeError:
            return self._runs(text)
        if len(units) > CACHED_UNITS:
            self.units = units = dict(list(units.items())[: CACHED_UNITS // 2])
            units[""] = None
        for p in parts:
            if p not in units:
                units[p] = self.search(p if p[0] == "\n" else SPACE + p)
        return self._runs(text) if "" in parts else sum(map(units.__getitem__, parts))

    def _runs(self, text: str) -> int:
        """As count(), for texts with runs of spaces."""
        total = 0
        for unit in re.findall(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*", SPACE + text.replace(" ", SPACE)):
            found = self.units.get(unit[1:]) if unit[0] == SPACE and len(unit) > 1 and unit[1] not in (SPACE, "\n") else None
            total += self.search(unit) if found is None else found
        return total


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of a sentencepiece vocabulary (pieces and their scores), one for each worker process."""
    if path not in _COUNTERS:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(size) if not special(i)]
        _COUNTERS[path] = Counter(pieces, sum(model.is_byte(i) for i in range(size)) == 256)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with n_tokens in place of the text."""
    kept = [f for f in docs.schema if f.name not in (text, "n_tokens")]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = counter(path)
        for piece in textkit.pieces(batches, text):
            counts = [one.count(t or "") for t in textkit.column(piece, text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(textkit.column(piece, f.name) for f in kept), pa.array(counts, pa.int64())], names=[*(f.name for f in kept), "n_tokens"])

    return docs.select(*(f"`{f.name}`" for f in kept), text).mapInArrow(run, ddl)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
