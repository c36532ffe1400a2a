"""Personal data with offset-preserving deobfuscation.

Base detectors run on the text as it is. Then transducers rewrite disguises into what they stand for:
homoglyphs and full-width forms to ASCII, bracketed or spelled "at" and "dot" to their signs, runs of spelled
digits to digits. Each character of the rewritten text keeps the source span it came from, so what the same
detectors find there is mapped back to offsets of the source. Only finds that touch a rewritten character
are added; base spans are never changed.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import text_of
from vitrine.llm.spans import Cover, Span, span_column
from vitrine.session import bound_batches

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits, so the lookbehind changes nothing but the time on long runs
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Letters of other scripts that look like ASCII ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "А": "A", "В": "B", "С": "C", "Е": "E",
    "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "Α": "A", "Β": "B",
    "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-",
}
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")

_GLYPHS = {ord(k): v for k, v in HOMOGLYPHS.items()}
_GLYPHS |= {c: unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFF5F)}
_STRANGE = re.compile("[" + "".join(re.escape(chr(c)) for c in _GLYPHS) + "]")
_DIGIT = "|".join((*DIGIT_WORDS, "oh"))
_VALUE = {w: str(i) for i, w in enumerate(DIGIT_WORDS)} | {"oh": "0"}
_RULES = re.compile(
    r"\s*[\[({<]\s*(?P<at>at|@)\s*[\])}>]\s*"
    r"|\s*[\[({<]\s*(?P<dot>dot|\.)\s*[\])}>]\s*"
    # plain words only in the shape of an address: name at host dot domain
    r"|(?<=[a-z0-9])\s+(?P<at2>at)\s+(?=[a-z0-9-]+(?:\s+dot\s+|\s*[\[({<]\s*dot\s*[\])}>]\s*|\.)[a-z]{2})"
    r"|(?<=[a-z0-9])\s+(?P<dot2>dot)\s+(?=[a-z]{2})"
    rf"|(?<![^\W_])(?P<spelled>(?:plus[\s.-]+)?(?:{_DIGIT})(?:[\s.-]+(?:{_DIGIT})){{6,}})(?![^\W_])",
    re.I | re.A,
)
_SPELLED = re.compile(rf"{_DIGIT}|plus", re.I | re.A)
# matches wherever one of _RULES does, as every form of them holds one of these
_CHEAP = re.compile(
    rf"[\[({{<]\s*(?:at|@|dot|\.)\s*[\])}}>]|\sdot\s|\sat\s+[a-z0-9-]+\.[a-z]{{2}}"
    rf"|\b(?:{_DIGIT})[\s.-]+(?:{_DIGIT})[\s.-]+(?:{_DIGIT})\b",
    re.I | re.A,
)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def detect(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches per kind that do not overlap; failing ones are dropped."""
    out = []
    limit, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > limit and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            limit = m.end()
        at = text.find("@", max(at + 1, limit))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def deobfuscate(text: str) -> tuple[str, list[int], list[int], list[bool]]:
    """Rewritten text; for each of its characters the source start and end, and whether it was rewritten."""
    chars: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    changed: list[bool] = []

    def put(c: str, start: int, end: int, new: bool) -> None:
        chars.append(c)
        starts.append(start)
        ends.append(end)
        changed.append(new)

    plain = text.translate(_GLYPHS)  # one character each, so offsets stay
    at = 0
    for m in _RULES.finditer(plain):
        for i in range(at, m.start()):
            put(plain[i], i, i + 1, plain[i] != text[i])
        if m["spelled"]:
            for w in _SPELLED.finditer(plain, m.start(), m.end()):
                put(_VALUE.get(w[0].lower(), "+"), w.start(), w.end(), True)
        else:
            put("@" if m["at"] or m["at2"] else ".", m.start(), m.end(), True)
        at = m.end()
    for i in range(at, len(plain)):
        put(plain[i], i, i + 1, plain[i] != text[i])
    return "".join(chars), starts, ends, changed


def find_personal_data(text: str) -> list[Span]:
    """All spans by start, then kind as listed."""
    base = detect(text)
    spans = [(k, s, e, True) for k, s, e in base]
    if not text.isascii() and _STRANGE.search(text) or _CHEAP.search(text):
        taken = {kind: Cover((a, b) for k, a, b in base if k == kind) for kind in KINDS}
        plain, starts, ends, changed = deobfuscate(text)
        for kind, s, e in detect(plain):
            if any(changed[s:e]):
                start, end = starts[s], ends[e - 1]
                if not taken[kind].meets(start, end):
                    spans.append((kind, start, end, False))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def personal_data(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with a column of spans; null and empty texts have none, all other columns and rows stay.

    A column that is already named ``out`` is replaced.
    """
    bound_batches(docs.sparkSession)
    return docs.withColumn(out, span_column(find_personal_data, text_of(text_col)))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; ``n_chars`` is counted anew if there.

    Overlapping spans are replaced together by the kind of the first. Null texts stay null.
    """
    bound_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else redacted(x) for x in texts.to_pylist()], pa.string())

    done = docs.withColumn(text_col, run(F.col(text_col)))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length(text_col).cast("bigint"))
    return done


def redacted(text: str) -> str:
    spans = find_personal_data(text)
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]
