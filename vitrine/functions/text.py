"""Text columns: cleaning, joining, slugs, tokens.

All of it runs inside the JVM. Lengths count code points.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping
from functools import lru_cache

from pyspark.sql import Column, functions as F

# whitespace in the wide sense: ASCII blanks, Unicode separators, byte order mark
BLANKS = r"[\s\p{Z}\x{FEFF}]+"
NON_WORD = r"[^\p{L}\p{N}]+"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def nonblank(c: Column) -> Column:
    """Empty string becomes null."""
    return F.nullif(c, F.lit(""))


def first_nonblank(*cols: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[nonblank(c) for c in cols])


def squeeze(c: Column) -> Column:
    """Collapse every run of whitespace to one space and trim."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def trim_to(c: Column | str, n: int) -> Column:
    """Cut to ``n`` characters, the last one an ellipsis when something was cut."""
    return F.regexp_replace(as_col(c), r"(?s)^(.{%d}).{2,}$" % (n - 1), "$1…")


def clean(c: Column | str, max_len: int | None = None) -> Column:
    """Strip tags, decode the basic entities (ampersand first), squeeze, empty to null; cut only where asked."""
    t = F.regexp_replace(as_col(c).cast("string"), r"<[^>]+>", " ")
    for entity, char in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = squeeze(t)
    return nonblank(t if max_len is None else trim_to(t, max_len))


def join_unique(arr: Column | str, sep: str = "; ", max_len: int | None = None, part_len: int | None = None) -> Column:
    """Clean each element, drop blanks and case-insensitive repeats (first spelling wins), join."""
    cleaned = F.filter(F.transform(as_col(arr), lambda x: clean(x, part_len)), lambda x: x.isNotNull())

    def distinct(values: Column) -> Column:
        lowered = F.transform(values, F.lower)
        return F.filter(values, lambda x, i: F.array_position(lowered, F.lower(x)) == (i + 1).cast("bigint"))

    return clean(F.array_join(let(cleaned, distinct), sep), max_len)


def join_parts(*parts: Column, sep: str = " | ") -> Column:
    """Join the parts that are neither null nor empty; empty string when none is left."""
    return F.concat_ws(sep, *[nonblank(p.cast("string")) for p in parts])


@lru_cache(maxsize=None)
def _letters(form: str) -> tuple[str, str]:
    """Translate tables dropping diacritics, derived from the Unicode decompositions."""
    source, target, dropped = [], [], []
    for cp in [*range(0xA0, 0xD800), *range(0xF900, 0x10000)]:
        ch = chr(cp)
        if 0x300 <= cp <= 0x36F:
            dropped.append(ch)
            continue
        plain = [x for x in unicodedata.normalize(form, ch) if not 0x300 <= ord(x) <= 0x36F]
        if len(plain) == 1 and plain[0] != ch:
            source.append(ch)
            target.append(plain[0])
    # characters of the first table without a partner in the second are deleted
    return "".join(source + dropped), "".join(target)


@lru_cache(maxsize=None)
def _expansions() -> tuple[list[str], list[str]]:
    """Compatibility characters that stand for several, with at least one ASCII letter or digit."""
    source, target = [], []
    for cp in [*range(0xA0, 0x3400), *range(0xFB00, 0x10000)]:
        plain = unicodedata.normalize("NFKD", chr(cp))
        kept = "".join(x for x in plain if not 0x300 <= ord(x) <= 0x36F)
        if len(kept) > 1 and any(x.isascii() and x.isalnum() for x in kept):
            source.append(chr(cp))
            target.append(kept)
    return source, target


def _ranges(chars: list[str], gap: int = 24) -> str:
    """Pattern of a few wide ranges around the characters; a class of hundreds is slow to test."""
    codes, spans = sorted(map(ord, chars)), []
    for cp in codes:
        if spans and cp - spans[-1][1] <= gap:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    return "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in spans) + "]"


def fold(c: Column | str) -> Column:
    """Lower case without diacritics, as the text index sees a value."""
    source, target = _letters("NFD")
    lowered = F.lower(as_col(c))
    ascii_only = F.length(lowered) == F.octet_length(lowered)
    return F.when(ascii_only, lowered).otherwise(F.translate(lowered, source, target))


def slug(c: Column | str, max_len: int | None = 60) -> Column:
    """ASCII slug: decompose, drop marks, lower, runs of anything else to one dash, cut (not at all with None)."""
    source, target = _letters("NFKD")
    many, expanded = _expansions()
    table = F.map_from_arrays(F.lit(many), F.lit(expanded))

    def plain_letters(text: Column) -> Column:
        has_many = text.rlike(_ranges(many))
        # the set test spares the other characters a walk through the table
        spell = lambda x: F.when(x.isin(many), F.try_element_at(table, x)).otherwise(x)
        spelled = F.array_join(F.transform(F.split(text, ""), spell), "")
        ascii_only = F.length(text) == F.octet_length(text)
        return F.when(ascii_only, text).otherwise(F.translate(F.when(has_many, spelled).otherwise(text), source, target))

    plain = F.lower(let(F.coalesce(as_col(c).cast("string"), F.lit("")), plain_letters))
    dashed = F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(nonblank(dashed if max_len is None else F.substring(dashed, 1, max_len)), F.lit("untitled"))


def ext_of(c: Column | str) -> Column:
    """Lower-case extension of a URL or file name (2 to 5 characters), else null."""
    return nonblank(F.lower(F.regexp_extract(as_col(c), r"^[^?#]*\.([A-Za-z0-9]{2,5})(?:[?#](?s:.*))?$", 1)))


def to_int(c: Column | str) -> Column:
    """Number truncated to a bigint; anything that is not a finite number becomes null."""
    t = F.trim(as_col(c).cast("string"))
    numeric = t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(numeric, t.try_cast("double")).try_cast("bigint")


def tokens(c: Column | str) -> Column:
    """Folded words of a value, in order."""
    return F.array_remove(F.split(fold(F.coalesce(as_col(c), F.lit(""))), NON_WORD), "")


# Bounds of a public site's query string, for callers that want them.
SITE_QUERY = {"max_words": 12, "shorter_than": 40}


def query_tokens(c: Column | str, max_words: int | None = None, shorter_than: int | None = None) -> Column:
    """Search words of a query string, all of them unless the caller sets bounds (``SITE_QUERY``)."""
    words = F.split(F.regexp_replace(F.lower(as_col(c)), "[“”\"'‘’`]", " "), NON_WORD)
    words = F.array_remove(words, "")
    if shorter_than is not None:
        words = F.filter(words, lambda w: F.length(w) < shorter_than)
    return words if max_words is None else F.slice(words, 1, max_words)


def tokenize_query(q: str | None, max_words: int | None = None, shorter_than: int | None = None) -> list[str]:
    """Driver-side twin of :func:`query_tokens` for one query string."""
    out, word = [], []
    for ch in (q or "").lower() + " ":
        if unicodedata.category(ch)[0] in "LN":
            word.append(ch)
        elif word:
            out.append("".join(word))
            word = []
    return [w for w in out if shorter_than is None or len(w) < shorter_than][:max_words]


def fold_word(word: str) -> str:
    """Driver-side twin of :func:`fold` for one word."""
    source, target = _letters("NFD")
    table = {ord(s): (target[i] if i < len(target) else None) for i, s in enumerate(source)}
    return word.lower().translate(table)


def rewrite_page_title(c: Column | str) -> Column:
    """``Image from page 12 of "Book" (1884)`` becomes ``Book (1884) — p. 12``."""
    pattern = r'^Image from page (\d+) of ["“](.+?)["”]?[\s\p{Z}]*\(?(\d{4})?\)?$'

    def rewrite(t: Column) -> Column:
        year = nonblank(F.regexp_extract(t, pattern, 3))
        return F.when(
            t.rlike(pattern),
            F.concat(
                F.coalesce(clean(F.regexp_extract(t, pattern, 2), 160), F.lit("")),
                F.coalesce(F.concat(F.lit(" ("), year, F.lit(")")), F.lit("")),
                F.lit(" — p. "),
                F.regexp_extract(t, pattern, 1),
            ),
        ).otherwise(t)

    return let(as_col(c), rewrite)


def tag_terms(terms: Column, fallback: Column) -> Column:
    """Terms joined by spaces when present, else the pipe-separated fallback."""
    return F.coalesce(F.array_join(terms, " "), F.translate(F.coalesce(fallback, F.lit("")), "|", " "))


def caption(creator: Column, date: Column, source_name: Column, public_domain: Column, rights: Column) -> Column:
    """Two-line caption of a contact sheet cell."""
    second = F.when(F.coalesce(public_domain, F.lit(False)), F.concat(source_name, F.lit(" · "), rights)).otherwise(source_name)
    return F.struct(join_parts(creator, date, sep=" · ").alias("line1"), second.alias("line2"))


def download_name(source: Column, item_id: Column, title: Column, ext: Column) -> Column:
    """``source-id-title.ext`` with slugged parts."""
    return F.concat(
        source, F.lit("-"), slug(F.regexp_replace(item_id, r"^[^:]+:", ""), 40),
        F.lit("-"), slug(title, 50), F.lit("."), ext,
    )


MAX_DICTIONARY = 20000


def _dictionary(words: Mapping[str, str]) -> Column:
    """Word table as a constant map; its size is checked because it ships with every task."""
    known = {k: v for k, v in words.items() if v}
    if len(known) > MAX_DICTIONARY:
        raise ValueError(f"more than {MAX_DICTIONARY} words: use translate_terms with a DataFrame")
    if not known:
        return F.lit(None).cast("map<string,string>")
    return F.map_from_arrays(F.lit(list(known)), F.lit(list(known.values())))


def english_terms(c: Column, dictionary: Mapping[str, str], keep_apostrophes: bool = False) -> Column:
    """Distinct English terms of the words found in a dictionary, in the order met."""
    words = F.split(F.lower(c), r"[^\p{L}']+" if keep_apostrophes else r"[^\p{L}]+")
    table = _dictionary(dictionary)
    known = [k for k, v in dictionary.items() if v]
    # a set lookup drops the many other words before the few known ones are translated
    found = F.array_distinct(F.filter(words, lambda w: w.isin(known))) if known else F.array().cast("array<string>")
    return F.array_join(F.array_distinct(F.transform(found, lambda w: F.try_element_at(table, w))), " ")


def english_type(c: Column, dictionary: Mapping[str, str]) -> Column:
    """First English word of a known type name, else the name itself."""
    return F.coalesce(F.substring_index(F.try_element_at(_dictionary(dictionary), F.lower(c)), " ", 1), c)
