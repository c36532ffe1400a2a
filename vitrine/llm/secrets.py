"""Secrets: key patterns, and values in a credential context that are hard to guess.

A value after a credential word is judged by the number of guesses an informed attacker needs: dynamic
programming finds the cheapest segmentation into dictionary words, dates, repeats, keyboard walks and
brute-force characters. Values above the limit are secrets; "changeme2020" or "aaaaaaaaaaaa" are not.
The dictionary is the list of common password words and, after it, the frequent words of the corpus itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import text_of
from vitrine.llm.spans import Cover, Span, span_column

KINDS = ("assign", "access", "hex", "guess")

_ASSIGN = re.compile(
    r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
# equal to the open-ended patterns with a length test: runs are maximal and shorter ones hold no match
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_WORDS = re.compile(r"passw(?:or)?d|secret|token|api_?key", re.I | re.A)
_CONTEXT = re.compile(
    r"(?:password|passwd|passphrase|pwd|passcode|secret|token|credentials?|(?:api|access|private|client|auth)[_-]?key)"
    r"[\"']?(?:\x20*(?:=>|:=|[:=])\x20*|\x20+is\x20+)([\"']?)([^\s\"'<>]{8,})",
    re.I | re.A,
)

# Words that passwords are commonly made of, most common first.
COMMON = (
    "password pass admin welcome letmein login monkey dragon master hello freedom whatever qwerty trustno "
    "iloveyou sunshine princess football baseball superman batman shadow michael jordan secret change me "
    "changeme default root user test guest demo temp example sample my your the this here none null true "
    "false key token value string word summer winter spring autumn monday friday love money server system "
    "access public private database company account placeholder insert enter"
).split()
KEYBOARD = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "qazwsxedcrfvtgbyhnujmikolp", "abcdefghijklmnopqrstuvwxyz")

_NEAR = {pair for row in KEYBOARD for a, b in zip(row, row[1:], strict=False) for pair in (a + b, b + a)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?"
                   r"|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d", re.A)  # fmt: skip
_LEET = str.maketrans("430157$@", "aeoistsa")
_LONGEST = 24
LEARNED = 20_000  # words learned from a corpus; beyond, a word saves few bits against brute force


class _Run:
    """Cheapest span of at least ``shortest`` inside an open run: cost where it starts, ``fixed``, ``gain`` of its length.

    ``gain`` is concave: of two starts, once the earlier one is cheaper it stays cheaper, so the later one is
    forgotten; where the earlier one also began dearer it never comes back. Few starts are left at any time,
    however long the run. A start enters when its shortest span ends, so none is weighed that the run cuts off.
    """

    def __init__(self, fixed: float, shortest: int, gain):
        self.fixed, self.shortest, self.gain = fixed, shortest, gain
        self.starts: list[tuple[int, float]] = []

    def cheapest(self, j: int, since: int, best: list[float]) -> float:
        """Cost of the best span from ``since`` or later to ``j``."""
        first = j - self.shortest
        if first < since:
            self.starts = []
            return math.inf
        if self.starts and self.starts[0][0] < since:
            self.starts = []
        low, kept = math.inf, []
        for start, cost in (*self.starts, (first, best[first])):
            here = cost + self.gain(j - start)
            if here < low:
                low = here
                while kept and kept[-1][1] >= cost:
                    kept.pop()
                kept.append((start, cost))
        self.starts = kept
        return low + self.fixed

    def least(self) -> float:
        return min((c for _, c in self.starts), default=math.inf)


def _ranks(words: Sequence[str]) -> dict[str, int]:
    return {w: i for i, w in reversed(list(enumerate(words, 1)))}


def guess_bits(value: str, words: Sequence[str] = COMMON) -> float:
    """Bits of the cheapest segmentation. Each position looks at the words that begin there and at the few
    useful starts of the runs it is in, so the time grows with the length of the value, not with its square."""
    return _guess_bits(value, _ranks(words))


def _guess_bits(value: str, rank: dict[str, int], enough: float = math.inf) -> float:
    """Ends early, with ``enough``, once no segmentation can cost less than that."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    leet = low.translate(_LEET)
    alphabet = 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value)
    alphabet += 10 * any(c.isdigit() for c in value) + 33 * any(not c.isalnum() for c in value)
    brute = math.log2(max(alphabet, 10))
    n = len(value)
    best = [0.0] + [math.inf] * n
    same = _Run(brute + 1, 3, math.log2)
    walk = _Run(math.log2(47) + 1, 3, lambda k: 2 * math.log2(k))
    # a block of 2, 3 or 4 characters said again and again; one run for each place in the block
    blocks = [(w, [_Run(w * brute + 1, 2 * w, lambda k, w=w: math.log2(k // w)) for _ in range(w)]) for w in (2, 3, 4)]
    same_since = walk_since = 0
    block_since = {w: 0 for w, _ in blocks}
    forms = ((low, 0.0), (leet, 2.0)) if leet != low else ((low, 0.0),)
    for i in range(n):
        here = best[i]
        # the spans that begin here: words and dates, whose length is bounded
        for form, extra in forms:
            for j in range(i + 3, min(n, i + _LONGEST) + 1):
                r = rank.get(form[i:j])
                if r is not None:
                    case = 0.0 if value[i:j].islower() else 2.0
                    best[j] = min(best[j], here + math.log2(r + 1) + extra + case + 1)
        m = _DATE.match(value, i)
        if m:
            best[m.end()] = min(best[m.end()], here + math.log2(366 * 120) * min(1, (m.end() - i) / 8) + 1)
        # the runs that character i continues or breaks
        j = i + 1
        if i and low[i] != low[i - 1]:
            same_since = i
        if i and low[i - 1 : j] not in _NEAR:
            walk_since = i
        cost = min(best[j], here + brute)
        if j - same_since >= 3:
            cost = min(cost, same.cheapest(j, same_since, best))
        if j - walk_since >= 3:
            cost = min(cost, walk.cheapest(j, walk_since, best))
        for width, runs in blocks:
            if i >= width and low[i] != low[i - width]:
                block_since[width] = j - width
            elif j - block_since[width] >= 2 * width:
                cost = min(cost, runs[j % width].cheapest(j, block_since[width], best))
        best[j] = cost
        # a span over this place starts among the last characters or at an open start
        if cost >= enough and j % 16 == 0 and min(best[max(0, j - _LONGEST) : j]) >= enough:
            if all(r.least() >= enough for r in (same, walk, *(r for _, runs in blocks for r in runs))):
                return enough
    return best[n]


def _base(text: str) -> list[tuple[str, int, int]]:
    out = []
    if _WORDS.search(text):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def secret_finder(min_bits: float = 45.0, words: Sequence[str] = COMMON):
    """A function from a text to its spans by start, then kind as listed."""
    rank = _ranks(words)

    def find(text: str) -> list[Span]:
        base = _base(text)
        taken = Cover((a, b) for _, a, b in base)
        spans = [(k, s, e, True) for k, s, e in base]
        for m in _CONTEXT.finditer(text):
            value = m[2] if m[1] else m[2].rstrip(".,;:!?)]}")
            start, end = m.start(2), m.start(2) + len(value)
            if len(value) < 8 or taken.meets(start, end):
                continue
            if _guess_bits(value, rank, min_bits) >= min_bits:
                spans.append(("guess", start, end, False))
        return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))

    return find


def frequent_words(docs: DataFrame, text_col: str = "text", count: int = LEARNED, min_docs: int = 3) -> list[str]:
    """The words of three letters or more in most documents, most frequent first, then by the alphabet.

    At most ``count`` words, each in ``min_docs`` documents at least, so the driver holds a bounded list. Values
    after a credential word are taken out before: a secret that is repeated does not become a word.
    """
    bare = F.regexp_replace(text_of(text_col), f"(?i){_CONTEXT.pattern}", " ")
    words = F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit(r"\p{L}{3,}"), 0))
    seen = docs.select(F.explode(words).alias("word")).where(F.length("word") <= _LONGEST)
    often = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    return [r.word for r in often.orderBy(F.desc("n"), "word").limit(count).collect()]


def secrets(
    docs: DataFrame,
    min_bits: float = 45.0,
    text_col: str = "text",
    out: str = "spans",
    words: Sequence[str] | None = None,
) -> DataFrame:
    """``docs`` with a column of spans; null and empty texts have none, all other columns and rows stay.

    A column that is already named ``out`` is replaced. ``words`` is the dictionary, most common first; without it, COMMON and the frequent words of ``docs``.
    """
    if words is None:
        words = list(dict.fromkeys([*COMMON, *frequent_words(docs, text_col)]))
    return docs.withColumn(out, span_column(secret_finder(min_bits, words), text_of(text_col)))
