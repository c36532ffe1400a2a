"""Porter stemming (M. F. Porter, "An algorithm for suffix stripping", 1980), with its author's later
rules for ``bli`` and ``logi``.

Applied to distinct words only; see ``plans.text_index.stem_words``.
"""

from __future__ import annotations

import re
from functools import lru_cache

# The suffix lists of the published algorithm.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
    "iti", "ous", "ive", "ize",
]

_WORD = re.compile(r"[a-z]+")


def _shape(word: str) -> str:
    """Word as a string of c (consonant) and v (vowel)."""
    out = []
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, table: dict[str, str]) -> str:
    for size in range(min(7, len(word)), 1, -1):
        tail = word[-size:]
        if tail in table:
            stem = word[:-size]
            return stem + table[tail] if _measure(stem) > 0 else word
    return word


def _plural(w: str) -> str:
    if w.endswith(("sses", "ies")):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _participle(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for tail in ("ed", "ing"):
        if w.endswith(tail) and _has_vowel(w[: -len(tail)]):
            w = w[: -len(tail)]
            if w.endswith(("at", "bl", "iz")):
                return w + "e"
            if _double(w) and w[-1] not in "lsz":
                return w[:-1]
            return w + "e" if _measure(w) == 1 and _cvc(w) else w
    return w


def _residual(w: str) -> str:
    best = max((t for t in STEP_4 if w.endswith(t)), key=len, default="")
    if best:
        stem = w[: -len(best)]
        if _measure(stem) > 1 and (best != "ion" or stem.endswith(("s", "t"))):
            w = stem
    return w


def _tidy(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _cvc(stem)):
            w = stem
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Stem of a folded word; words of other scripts or of one or two letters are left alone."""
    if len(word) < 3 or not _WORD.fullmatch(word):
        return word
    w = _participle(_plural(word))
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    return _tidy(_residual(_swap(_swap(w, STEP_2), STEP_3)))
