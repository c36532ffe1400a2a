"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a Viterbi search.

The automaton reads a text once; at each position its output links name every piece that ends there, and each
of them relaxes the best score of that position. Characters without a piece fall back to byte pieces. No
piece joins a word to the white space after it, so the best path of a text is that of its words in a row, and
words seen recently are not searched again.

A file of the BPE kind holds merge ranks, not log-probabilities; the search then takes the probability of a
piece from its rank by Zipf's law. Scores of unigram files are used as they are.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from vitrine.llm.common import text_of

MODEL = "piece_bpe_32k.model"
SPACE = "▁"


class Pieces(dict):
    """Ids of units (white space before a word, and the word) as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, keep: int = 300_000):
        super().__init__()
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.keep, self.old = keep, {}
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.bytes = {int(pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        ranks = all(model.get_score(i) == -n for n, i in enumerate(plain))
        self.score = {i: -math.log(n + 2) if ranks else model.get_score(i) for n, i in enumerate(plain)}
        self.byte_score = min(self.score.values()) - 10  # of each byte of a character without a piece
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(pieces[i], (i, len(pieces[i]), self.score[i]))
        self.automaton.make_automaton()
        self.raw = [p.replace(SPACE, " ").encode() for p in pieces]
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])

    def best_path(self, unit: str) -> list[int]:
        """Ids of the best segmentation; of equal scores the one whose last piece is found first, the longest."""
        n = len(unit)
        best = [0.0] + [-math.inf] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        done = 0

        def settle(upto: int) -> None:
            nonlocal done
            while done < upto:
                done += 1
                score = best[done - 1] + self.byte_score * len(unit[done - 1].encode("utf-8", "replace"))
                if score > best[done]:
                    best[done], back[done] = score, (done - 1, -1)

        for end, (i, size, score) in self.automaton.iter(unit):
            start = end + 1 - size
            settle(start)
            if best[start] + score > best[end + 1]:
                best[end + 1], back[end + 1] = best[start] + score, (start, i)
        settle(n)
        ids: list[int] = []
        at = n
        while at:
            start, i = back[at]
            if i < 0:
                ids.extend(self.bytes[b] for b in reversed(unit[start:at].encode("utf-8", "replace")))
            else:
                ids.append(i)
            at = start
        return ids[::-1]

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit)
        if ids is None:
            ids = array("I", self.best_path(unit)).tobytes()
        self[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text; a space is put in front, as these models expect, unless the text is empty."""
        if not text:
            return b""
        if len(self) > self.keep:
            self.old = dict(self)
            self.clear()
        if SPACE in text:
            return self._with_marks(text)
        words = text.split(" ")
        if "" not in words:
            return b"".join([self[SPACE + w] for w in words])
        out, spaces = [], 0
        for w in words:
            spaces += 1
            if w:
                out.append(self[SPACE * spaces + w])
                spaces = 0
        if spaces:
            out.append(array("I", self.best_path(SPACE * spaces)).tobytes())
        return b"".join(out)

    def _with_marks(self, text: str) -> bytes:
        """A text that holds the mark for spaces itself: the mark is spelled in bytes, so decoding is exact."""
        mark = array("I", [self.bytes[b] for b in SPACE.encode()]).tobytes()
        parts = text.replace(" ", "\0 ").split(SPACE)
        out = []
        for k, part in enumerate(parts):
            unit = part.replace("\0 ", SPACE)
            unit = SPACE + unit if k == 0 else unit
            out.append(array("I", self.best_path(unit)).tobytes() if unit else b"")
        return mark.join(out)

    def decode(self, ids: bytes) -> str:
        numbers = array("I")
        numbers.frombytes(ids)
        return b"".join(map(self.raw.__getitem__, numbers))[1:].decode("utf-8", "replace")


_LOADED: dict[str, Pieces] = {}


def pieces(path: str | None) -> Pieces:
    """The encoder of this Python worker; its cache lives on between tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id and ``ids``; null and empty texts have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces(path)
        for batch in batches:
            ids = [memoryview(encoder.encode(x)).cast("I") if x else [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([list(x) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )

    source = docs.select(docs[id_col].alias("doc_id"), text_of(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = pieces(path)
        for batch in batches:
            texts = [decoder.decode(array("I", x).tobytes()) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encoding_report(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_pieces, n_byte_pieces, ids_crc32, and whether decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(path)
        low, high = min(coder.bytes.values()), max(coder.bytes.values())
        for batch in batches:
            n, spelled, crc, same = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = coder.encode(text)
                numbers = memoryview(ids).cast("I")
                n.append(len(numbers))
                spelled.append(_between(ids, low, high))
                crc.append(zlib.crc32(ids))
                same.append(coder.decode(ids) == text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(spelled, pa.int64()), pa.array(crc, pa.int64()),
                 pa.array(same, pa.bool_())],
                names=["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"],
            )

    source = docs.select(docs[id_col].alias("doc_id"), text_of(text_col).alias("text"))
    return source.mapInArrow(
        run, "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean"
    )


def _between(ids: bytes, low: int, high: int) -> int:
    import numpy as np

    numbers = np.frombuffer(ids, "<u4")
    return int(((numbers >= low) & (numbers <= high)).sum())
