"""Token counts by finite-state transducers compiled from a byte-pair piece model.

A text's encoding ends in exactly one piece at each of its positions, and two pieces may follow each other when the
merges of their own joint text leave them apart. So the last piece is all that a state has to hold: an arc leads from it
to a piece that may follow, reads the characters of that piece and is annotated with its number of tokens (one; bytes where no
piece holds a character). Arcs are found in the tree of pieces, built when first met and kept. Of all ways through the
arcs at most one reads a text to its end, and it is the encoding: the longest arc is tried first, and what leads
nowhere is taken back. The sum along the way is the count. Spaces after other characters, marks after letters, and
characters that no piece holds start anew from everywhere.

Long texts are cut into chunks that are read in parallel. A chunk is a map from the state before it to the state
behind it and a count: only its head, up to the first place where all states meet, has to be read from the state
before. Maps compose associatively, 64 at a time, until one is left per text.
"""

from __future__ import annotations

import re
import struct
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import parts, text_of

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
CHUNK = 65_536
FAN_IN = 64
LIMIT = 4096
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
OPEN_ARCS = 256
_NONE = float("-inf")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


class PieceModel:
    """Pieces and scores of a model file of the BPE kind with byte fallback and no normalisation.

    Other kinds are refused by name, so that no count is silently wrong.
    """

    def __init__(self, path: str):
        import sentencepiece

        raw = sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto()
        self.score: dict[str, float] = {}
        trainer: dict[int, int | bytes] = {}
        normal: dict[int, int | bytes] = {}
        kinds = set()
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                kind = piece.get(3, 1)
                kinds.add(kind)
                if kind == 1:
                    self.score[piece[1].decode()] = struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        wanted = {
            "BPE": trainer.get(3) == 2,
            "byte fallback": 6 in kinds,
            "no user-defined or unused pieces": not kinds & {4, 5},
            "no character map": not normal.get(2),
            "spaces kept": normal.get(4) == 0,
            "spaces escaped": normal.get(5, 1) == 1,
            "white space before words": not trainer.get(24),
        }
        if missing := [k for k, there in wanted.items() if not there]:
            raise ValueError(f"{path}: not supported without: {', '.join(missing)}")
        self.dummy_prefix = normal.get(3, 1) == 1

    def merges_to(self, left: str, right: str) -> bool:
        """Whether the encoding of left + right is these two pieces; with an empty left, whether it is the right one.

        The best neighbours merge first, of equals those on the left. A merge over the seam ends the matter.
        """
        out, get = list(left + right), self.score.get
        scores = [get(a + b, _NONE) for a, b in zip(out, out[1:], strict=False)]
        seam = len(left)
        while scores:
            best = max(scores)
            if best == _NONE:
                break
            i = scores.index(best)
            if seam and i == seam - 1:
                return False
            if i < seam:
                seam -= 1
            out[i : i + 2] = [out[i] + out[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = get(out[i - 1] + out[i], _NONE)
            if i < len(scores):
                scores[i] = get(out[i] + out[i + 1], _NONE)
        return len(out) == (2 if left else 1)


class _Words(dict):
    """Tokens of the units met last: those of this generation, and those of the one before until they are met again."""

    def __init__(self, read: Callable[[str], int], keep: int):
        super().__init__()
        self.read, self.keep, self.old = read, keep, {}

    def __missing__(self, unit: str) -> int:
        n = self.old.get(unit)
        if n is None:
            n = self.read(unit)
        if len(unit) <= 64:
            self[unit] = n
        return n

    def turn(self) -> None:
        if len(self) > self.keep:
            self.old.clear()  # before the copy, so that no third table is held
            self.old = dict(self)
            self.clear()


class Transducer:
    """Counts tokens of texts whose spaces are ``▁``.

    ``keep`` bounds what is remembered: twice as many pairs of pieces, and twice as many words in each of two generations.
    What is forgotten is built again when met; counts do not depend on it.
    """

    def __init__(self, model: PieceModel, keep: int = 100_000):
        self.model, self.keep = model, keep
        self.alphabet = set().union(*model.score) if model.score else set()
        # all states meet at a space behind another character if no piece reaches over such a place
        self.meets = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in model.score)
        lone = [c for c in "\n\t\r" if c not in self.alphabet]
        self.lone = "".join(lone)
        inner = re.escape(self.lone)
        if self.meets:
            stop = f"[{inner}]|" if lone else ""
            # the same holds for a mark behind a letter, so that a word is one unit whatever mark follows it
            if not any(re.search(f"[{LETTERS}][^\\w{SPACE}]", p) for p in model.score):
                stop += f"{SPACE}*[{LETTERS}]++(?=\\W)|"
            self.units = re.compile(f"{stop}{SPACE}*[^{SPACE}{inner}]+|{SPACE}+")
            behind = f"|(?<=[{inner}])" if lone else ""
            self.meeting = re.compile(f"(?<=[^{SPACE}])(?={SPACE}){behind}")
        else:
            self.units = re.compile(f"[{inner}]|[^{inner}]+" if lone else "(?s:.)+")
            self.meeting = re.compile(f"(?<=[{inner}])" if lone else "(?!)")
        self.longest = max(map(len, model.score), default=1)
        # a node's children by character; under "" the pieces on the way to it, longest first
        self.tree: dict[str, dict | tuple[str, ...]] = {"": ()}
        for p in sorted(model.score, key=len):  # so that the pieces a piece begins with are there before it
            node = self.tree
            for c in p:
                if c not in node:  # a character that only longer pieces hold is read as its bytes
                    node[c] = {"": node[""] if node is not self.tree else () if c in model.score else (c,)}
                node = node[c]
            node[""] = (p, *node[""])
        self.apart: dict[tuple[str | None, str], bool] = {}
        self.words = _Words(self.read, 2 * keep)

    def _follows(self, last: str | None, piece: str) -> bool:
        """Whether ``piece`` can stand behind ``last`` in an encoding."""
        key = (last, piece)
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) >= 2 * self.keep:
                self.apart.clear()
            found = self.apart[key] = self.model.merges_to(last or "", piece)
        return found

    def _arcs(self, text: str, at: int) -> tuple[str, ...]:
        """The pieces that ``text`` holds at a place, longest first, or the one character that none of them is."""
        node = self.tree
        for char in text[at : at + self.longest]:
            child = node.get(char)
            if child is None:
                break
            node = child
        return node[""] or (text[at],)

    def read(self, text: str) -> int:
        """Tokens of a text read from the start state, piece by piece."""
        path: list[str] = []
        untried: deque[Iterator[str]] = deque(maxlen=OPEN_ARCS)  # of the last places; those before are looked up again
        apart, last, at = self.apart, None, 0
        while at < len(text):
            arcs = iter(self._arcs(text, at))
            while True:
                for piece in arcs:
                    fits = apart.get((last, piece))
                    if fits or fits is None and self._follows(last, piece):
                        break
                else:  # no way on: the last piece is taken back
                    at -= len(path.pop())
                    if untried:
                        arcs = untried.pop()
                    else:
                        arcs = iter([p for p in self._arcs(text, at) if len(p) < len(last)])
                    last = path[-1] if path else None
                    continue
                break
            path.append(piece)
            untried.append(arcs)
            at += len(piece)
            last = piece
        total, score = len(path), self.model.score
        if not all(map(score.__contains__, path)):
            total += sum(len(p.encode("utf-8", "replace")) - 1 for p in path if p not in score)
        return total

    def count(self, text: str) -> int:
        """The same, with whole units between two meeting places as single transitions once they are known."""
        self.words.turn()
        return sum(map(self.words.__getitem__, self.units.findall(text)))

    def tokens(self, text: str) -> int:
        """Tokens of a text as the library gives them."""
        if not text:
            return 0
        return self.count(self.prefixed(text))

    def prefixed(self, text: str) -> str:
        return (SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE)

    def chunk_map(self, chunk: str) -> tuple[str, int, str | None]:
        """The map of a chunk: its head, the tokens behind it, and what follows the last meeting place.

        Without a meeting place the head is the whole chunk and there is no tail.
        """
        first = last = None
        for m in self.meeting.finditer(chunk):
            if m.start():
                first, last = (m.start() if first is None else first), m.start()
        if first is None:
            return chunk, 0, None
        return chunk[:first], self.count(chunk[first:]), chunk[last:]

    def composed(self, f: tuple[str, int, str | None], g: tuple[str, int, str | None]) -> tuple[str, int, str | None]:
        """The map of two neighbouring chunks from their maps."""
        if f[2] is None:
            head, n, tail = self.chunk_map(f[0] + g[0])
            if tail is None:
                return head, g[1], g[2]
            return self.composed((head, n, tail), ("", g[1], g[2]))
        seam = f[2] + g[0]
        total = f[1] - self.count(f[2]) + self.count(seam) + g[1]
        if g[2] is not None:
            return f[0], total, g[2]
        _, _, tail = self.chunk_map(seam)
        return f[0], total, seam if tail is None else tail

    def applied(self, f: tuple[str, int, str | None]) -> int:
        """Tokens of a text whose map is ``f``, from the start state."""
        return self.count(f[0]) + f[1]


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    """The transducer of a model file, compiled once in each Python worker."""
    return Transducer(PieceModel(path))


_MAPS = "rid bigint, k bigint, doc_id bigint, n_bytes bigint, head string, n bigint, tail string"
_SCHEMA = pa.schema(
    [("rid", pa.int64()), ("k", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()),
     ("head", pa.string()), ("n", pa.int64()), ("tail", pa.string())]
)


def _long_counts(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    """Counts of texts of more than one chunk: maps of the chunks, composed in a tree."""
    spark = docs.sparkSession
    cut = "rid bigint, k bigint, doc_id bigint, n_bytes bigint, chunk string"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            for row in batch.to_pylist():
                text = machine.prefixed(row["text"])
                for k, at in enumerate(range(0, len(text), chunk)):
                    one = {"rid": row["rid"], "k": k, "doc_id": row["doc_id"], "n_bytes": row["n_bytes"], "chunk": text[at : at + chunk]}
                    yield pa.RecordBatch.from_pylist([one], cut_schema)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                row["head"], row["n"], row["tail"] = machine.chunk_map(row.pop("chunk"))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    def merge(group: pa.Table) -> pa.Table:
        machine = transducer(path)
        rows = group.sort_by("k").to_pylist()
        whole = (rows[0]["head"], rows[0]["n"], rows[0]["tail"])
        for row in rows[1:]:
            whole = machine.composed(whole, (row["head"], row["n"], row["tail"]))
        kept = {c: rows[0][c] for c in ("rid", "doc_id", "n_bytes")}
        one = kept | {"k": rows[0]["k"] // FAN_IN, "head": whole[0], "n": whole[1], "tail": whole[2]}
        return pa.Table.from_pylist([one], _SCHEMA)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            totals = [machine.applied((r["head"], r["n"], r["tail"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    cut_schema = pa.schema([*list(_SCHEMA)[:4], ("chunk", pa.string())])
    longest = docs.agg(F.max(F.length("text"))).first()[0]
    width = -(-(longest + 1) // chunk) if longest else 1
    chunks = docs.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(split, cut)
    # the chunks of one text spread over all tasks
    maps = chunks.repartition(parts(spark), "rid", "k").mapInArrow(mapped, _MAPS)
    while width > 1:
        maps = maps.groupBy("rid", F.floor(F.col("k") / FAN_IN)).applyInArrow(merge, _MAPS)
        width = -(-width // FAN_IN)
    return maps.mapInArrow(finish, "doc_id bigint, n_bytes bigint, n_tokens bigint")


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    Counts equal those of the sentencepiece library for the model file at ``path``, without begin, end or other added
    tokens; names of special tokens inside a text are ordinary text. A null text counts as empty and has no tokens.
    Rows that repeat an id, or have none, are kept as they are. Texts of more than ``chunk`` characters are read in
    chunks. Other columns are not read, whatever their names; an empty table gives an empty result.
    """
    known = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    known = known.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    long = F.length("text") > chunk

    @F.arrow_udf("bigint")
    def counted(texts: pa.Array) -> pa.Array:
        tokens = transducer(path).tokens
        return pa.array([tokens(x) for x in texts.to_pylist()], pa.int64())

    found = known.where(~long).select("doc_id", "n_bytes", counted("text").alias("n_tokens"))
    found = found.unionByName(_long_counts(known.where(long), path, chunk))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
