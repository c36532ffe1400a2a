"""Best-fit packing of token sequences by bin completion.

Documents are tokenized and cut on Spark; of the pieces only the histogram of lengths, at most
``capacity`` rows for any amount of data, decides how sequences are filled. The search runs on that histogram:
around the largest piece left it enumerates fillings that no other filling dominates, takes them in order of
waste, prunes what the waste bound of the incumbent rules out, and starts from best-fit solutions. Its result,
patterns and how often each is used, is turned back into places by the rank of each piece among those of its
length; ranks come from per-task counters and one sum over (length, task), so no piece is sorted or collected.
"""

from __future__ import annotations

import codecs
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import text_of
from vitrine.session import bound_batches, landed

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"

# -- tokens ----------------------------------------------------------------------------------------------


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 as is, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
#: the same as a decoding table of bytes
_STAND_INS = "".join(_LETTERS[b] for b in range(256))
#: letters of ASCII and Latin-1 in UTF-8, then ASCII marks; the tokenizer keeps the two apart, but for the apostrophe
_SIMPLE = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@[-`{-~]*)")
#: lower case of those letters in UTF-8, where no other byte follows \xc3, and of Latin-1
_LOWER_UTF8 = bytes(b + 32 if 65 <= b <= 90 or 0x80 <= b <= 0x9E else b for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 or 0xC0 <= b <= 0xDE and b != 0xD7 else b for b in range(256))


def _kind(b: int) -> str:
    c = chr(b)
    if c in ".,":
        return ","
    if c in " \t\n\r\x0b\x0c":
        return " "
    return "a" if (b < 128 or b >= 0xC0) and c.isalnum() else "!"


#: kinds of Latin-1 characters: white space, comma or full stop, letter or digit, all else
_KINDS = "".join(map(_kind, range(256))).encode("ascii")


def _split(text: str) -> list[bytes]:
    """Units of a text in UTF-8, brought to fewer different ones where its ids stay the same.

    In Latin-1 nothing composes, so letters can be lower-cased before the tokenizer does it. A comma or full stop before
    a space stands alone unless it ends a run of marks, which the tokenizer takes as one. Names of special tokens
    depend on case.
    """
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").split()
    if b"<|" not in raw:
        raw = raw.translate(_LOWER)
        kinds = raw.translate(_KINDS)
        if b"!, " not in kinds and b",, " not in kinds:
            raw = raw.replace(b", ", b" , ").replace(b". ", b" . ")
    return (raw if raw.isascii() else raw.decode("latin-1").encode()).split()


class Units(dict):
    """Ids (little-endian unsigned 32-bit) of units between white space, kept for the most recent ones.

    The vocabulary never joins across white space, so the ids of a text are those of its units in a row. Most
    units are letters, some with marks behind them; their letters go straight to the model, all else through the
    whole tokenizer. Up to ``keep`` units and what one text adds are kept in each of three generations.
    """

    def __init__(self, path: str, keep: int = 200_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.keep, self.old, self.older = keep, {}, {}

    def _encode(self, unit: bytes) -> bytes:
        m = _SIMPLE.fullmatch(unit)
        if not m:
            text = unit.decode("utf-8", "replace")
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        letters, marks = m.groups()
        letters = letters.translate(_LOWER_UTF8)
        if letters != unit:
            return self[letters] + self[marks] if marks else self[letters]
        letters = codecs.charmap_decode(letters, "strict", _STAND_INS)[0]
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def __missing__(self, unit: bytes) -> bytes:
        ids = self.old.get(unit)
        if ids is None:
            ids = self.older.get(unit)
            if ids is None:
                ids = self._encode(unit)
        self[unit] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if len(self) > self.keep:
            self.older.clear()  # before the copy, so that no fourth table is held
            self.older, self.old = self.old, dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, _split(text)))


_UNITS: dict[str, Units] = {}


def units(path: str | None) -> Units:
    """The encoder of this Python worker; its cache lives on between tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _UNITS:
        _UNITS[path] = Units(path)
    return _UNITS[path]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of each document (doc_id, text), with their number ``nth`` among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        encoder, end = units(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.ids(text) + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc_id, i, at // 4, n, zlib.crc32(part), task, int(seen[n])))
                    seen[n] += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = [x.split()[0] for x in _PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names
            )

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", text_of("text").alias("text")).mapInArrow(run, _PIECES)


# -- the search ------------------------------------------------------------------------------------------

Pattern = tuple[int, ...]


class _Left:
    """Lengths left, ascending, with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: v for k, v in counts.items() if v}
        self.order = sorted(self.count)

    def take(self, pattern: Pattern, times: int) -> None:
        for x in pattern:
            self.count[x] -= times
            if not self.count[x]:
                del self.count[x]
                del self.order[bisect_left(self.order, x)]

    def give(self, pattern: Pattern, times: int) -> None:
        for x in pattern:
            if x not in self.count:
                self.count[x] = 0
                self.order.insert(bisect_left(self.order, x), x)
            self.count[x] += times

    def fit(self, room: int, used: Pattern) -> int:
        """The largest length within ``room`` that is left besides ``used``; 0 if none."""
        i = bisect_right(self.order, room) - 1
        while i >= 0 and self.count[self.order[i]] <= used.count(self.order[i]):
            i -= 1
        return self.order[i] if i >= 0 else 0

    def times(self, pattern: Pattern) -> int:
        return min(self.count[x] // pattern.count(x) for x in set(pattern))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """Largest piece first, each gap filled with the piece that fits it best, repeated while pieces last."""
    left, out = _Left(counts), []
    while left.order:
        pattern: Pattern = (left.order[-1],)
        room = capacity - pattern[0]
        while x := left.fit(room, pattern):
            pattern += (x,)
            room -= x
        times = left.times(pattern)
        left.take(pattern, times)
        out.append((times, pattern))
    return out


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and the bound that pieces above half a bin cannot share one."""
    number = np.zeros(capacity + 1, np.int64)
    for k, v in counts.items():
        number[k] = v
    size = np.arange(capacity + 1)
    volume, pieces_up_to = np.cumsum(number * size), np.cumsum(number)
    best = -(-int(volume[-1]) // capacity)
    half = capacity // 2
    for k in range(0, half + 1):
        huge = int(pieces_up_to[-1] - pieces_up_to[capacity - k])
        large = int(pieces_up_to[capacity - k] - pieces_up_to[half])
        room = large * capacity - int(volume[capacity - k] - volume[half])
        small = int(volume[half] - (volume[k - 1] if k else 0))
        best = max(best, huge + large + max(0, -(-(small - room) // capacity)))
    return best


def fillings(left: _Left, capacity: int, width: int, waste: int) -> list[tuple[int, Pattern]]:
    """Up to ``width`` undominated fillings (waste, pattern) around the largest piece, least waste first.

    A filling is dominated if two of its pieces can be exchanged for one piece that is left, at least as long
    as both and within the room: then the small ones stay free for other bins.
    """
    first = left.order[-1]
    room = capacity - first
    found: dict[Pattern, int] = {}

    def add(pattern: Pattern) -> bool:
        gap = capacity - sum(pattern)
        if gap <= waste and pattern not in found:
            rest = pattern[1:]
            for i in range(len(rest)):
                for j in range(i):
                    x = left.fit(rest[i] + rest[j] + gap, pattern)
                    if x >= rest[i] + rest[j]:
                        return False
            found[pattern] = gap
        return sum(1 for g in found.values() if g == 0) >= width

    x = left.fit(room, (first,))
    if not x:
        return [(room, (first,))] if room <= waste else []
    if add((first, x)) and width == 1:
        return [(found[(first, x)], (first, x))]
    tried = 0
    for i in range(bisect_right(left.order, room) - 1, -1, -1):
        a = left.order[i]
        if left.count[a] <= (a == first):
            continue
        b = left.fit(min(a, room - a), (first, a))
        tried += 1
        if b:
            full = add((first, a, b))
            if not full and room - a - b:
                c = left.fit(min(b, room - a - b), (first, a, b))
                pattern: Pattern = (first, a, b)
                while c:
                    pattern += (c,)
                    c = left.fit(min(c, capacity - sum(pattern)), pattern)
                full = add(pattern)
            if full:
                break
        if tried >= 64 and found and min(found.values()) == 0 or tried >= 120:
            break
    if not found:  # all dominated: best fit is always allowed
        pattern, gap = (first,), room
        while x := left.fit(gap, pattern):
            pattern += (x,)
            gap -= x
        if gap <= waste:
            found[pattern] = gap
    return sorted((g, p) for p, g in found.items())[:width]


def complete_bins(
    counts: dict[int, int], capacity: int = CAPACITY, nodes: int = 3_000, width: int = 4
) -> list[tuple[int, Pattern]]:
    """Patterns (times, lengths in descending order) that use up ``counts``, with as few bins as found.

    Depth-first over fillings of the largest piece left, each used as often as pieces last. A branch ends when
    its waste exceeds what the incumbent leaves for one bin less; the search ends at the lower bound or after
    ``nodes`` fillings. The incumbent starts as best fit, and best fit completes the open branch every 256 nodes.
    """
    best = best_fit(counts, capacity)
    bins, bound = sum(t for t, _ in best), lower_bound(counts, capacity)
    total = sum(k * v for k, v in counts.items())
    left = _Left(counts)
    path: list[tuple[int, Pattern]] = []
    wasted, used = [0], 0
    stack: list[Iterator[tuple[int, Pattern]]] = []

    def allowance() -> int:
        return (bins - 1) * capacity - total - wasted[-1]

    stack.append(iter(fillings(left, capacity, width, allowance())) if left.order else iter(()))
    while stack and bins > bound and nodes > 0:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path and stack:
                times, pattern = path.pop()
                left.give(pattern, times)
                used -= times
                wasted.pop()
            continue
        nodes -= 1
        gap, pattern = step
        times = left.times(pattern)
        if gap and gap * times > allowance():
            times = allowance() // gap
            if times < 1:
                continue
        left.take(pattern, times)
        path.append((times, pattern))
        wasted.append(wasted[-1] + gap * times)
        used += times
        if not left.order:
            if used < bins:
                best, bins = list(path), used
            stack.append(iter(()))
            continue
        if nodes % 256 == 0:
            rest = best_fit(left.count, capacity)
            if used + sum(t for t, _ in rest) < bins:
                best, bins = path + rest, used + sum(t for t, _ in rest)
        stack.append(iter(fillings(left, capacity, width, allowance())))
    return best


# -- places ----------------------------------------------------------------------------------------------


def _places(plan: list[tuple[int, Pattern]]) -> dict[str, np.ndarray]:
    """For each run of equal pieces in a pattern: its first rank, bins, copies per bin and offset, by (length, rank)."""
    start: dict[int, int] = {}
    rows, sequence = [], 0
    for times, pattern in plan:
        offset, i = 0, 0
        ordered = sorted(pattern, reverse=True)
        while i < len(ordered):
            n, length = ordered.count(ordered[i]), ordered[i]
            at = start.get(length, 0)
            rows.append((length, at, n, sequence, offset))
            start[length] = at + times * n
            offset += n * length
            i += n
        sequence += times
    rows.sort()
    names = ("length", "rank", "copies", "sequence", "offset")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    path: str | None = None,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    nodes: int = 3_000,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text has the end id alone. Ids may be null or repeated: every row is packed for itself.
    Only documents above ``capacity`` tokens are cut. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    found = landed(
        pieces(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), capacity, path, end_id),
        "pieces",
    )
    counted = landed(found.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(complete_bins(histogram, capacity, nodes)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counted.select("length", "task", F.coalesce(before, F.lit(0)).cast("bigint").alias("first"))
    ranked = found.join(offsets, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        keys = p["length"] * (1 << 48) + p["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1
            nth = rank - p["rank"][at]
            copies = p["copies"][at]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")],
                    pa.array(p["sequence"][at] + nth // copies),
                    pa.array(p["offset"][at] + nth % copies * length),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
